"""The pipeline's stages on a small corpus, each judged on its own input."""

import random

import corpus_pipeline
import __spark_entry__


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")}


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + "".join(rng.choice("aeiourstln") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20)
    clean = [text(120) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0] + " extra", "en", "s", 1), (101, text(40) + " " + item + " " + text(40), "en", "s", 1), (102, "too short", "en", "s", 9), (103, None, None, None, None)]
    shared = "\n".join(text(30) for _ in range(4))
    rows += [(104, text(70) + "\n" + shared, "en", "s", 1), (105, text(70) + "\n" + shared, "en", "s", 1)]
    rows += [(106, shared, "en", "s", len(shared))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert shared in texts[104] and shared.split("\n")[1] not in texts[105] and texts[0] == clean[0]
    every = {*range(60), 100, 101, 104, 105}
    assert ids[0] == every | {106} and ids[1] == every  # nothing was left of 106
    assert ids[2] == every - {100}
    assert ids[3] == ids[4] == every - {100, 101}
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_stages_stand_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("aeioubcdfg") for _ in range(5)) for _ in range(n))
    long, twice = text(20_000), text(90)
    rows = [(1, long), (2, twice), (2, twice), (2, text(80)), (3, twice + " end"), (None, text(70)), (4, None), (5, ""), (6, "  \n\n ")]
    odd = spark.createDataFrame([(i, t, "en", "s", 1, "k", "g", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, _gone string, kept int")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, text(12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == odd.columns
            got = sorted((str(r.doc_id), len(r.text)) for r in docs.collect())
    assert [i for i, _ in got] == ["1", "2", "2", "2", "None"] and docs.count() == 5
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
