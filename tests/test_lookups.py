"""Context lookups, sets of keys, tables changed by key, strict training sheets, model verbs."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import cli, errors
from quarry.operators import context as C
from quarry.operators import evaluation as E
from quarry.operators import query as Q
from quarry.sources import tables as T


def test_lookups_of_odd_keys(spark):
    e = spark.createDataFrame([("p", "a.B", "e1", 1, "x.py"), ("p", "a.B", "e2", 2, "x.py"), ("q", "a.B", "e3", 1, "y.py"), ("p", None, "e4", 1, None)], "project string, qualified_name string, entity_id string, seq int, path string")
    wanted = spark.createDataFrame([("p", "a.B", 1), ("p", "none", 1), ("p", "a.B", 2)], "project string, qualified_name string, seq int")
    assert sorted((r.qualified_name, r.entity_id) for r in C.by_qualified_name(wanted, e, "seq").collect()) == [("a.B", "e2"), ("none", None)]
    facts = spark.createDataFrame([("e1", ["f"], {"a": "b"}, 3)], "entity_id string, references array<string>, imports map<string,string>, n int")
    got = {r.entity_id: r for r in C.facts_of(e, facts).collect()}
    assert len(got) == 4 and (got["e1"].references, got["e1"].n) == (["f"], 3) and (got["e3"].references, got["e3"].imports, got["e3"].n) == ([], {}, None)
    imports = spark.createDataFrame([("x.py", "np", "numpy"), ("x.py", "np", "nope")], "path string, alias string, origin string")
    seen = {r.entity_id: r.imports for r in C.imports_for(e, e, imports).collect()}
    assert seen == {"e1": {"np": "numpy"}, "e2": {"np": "numpy"}, "e3": {}, "e4": {}}
    names = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "dst string, name string")
    uses = spark.createDataFrame([("A", "x"), ("C", "x"), ("C", "x"), ("B", "y")], "src string, name string")
    assert sorted(tuple(r) for r in C.referencing_classes(names.where("dst = 'B'"), uses, names).collect()) == [("B", "A"), ("B", "C")]
    assert C.classes_named(names.select(F.lit("p").alias("project"), "name").limit(0), names.select(F.lit("p").alias("project"), "name", F.col("dst").alias("entity_id"))).count() == 0


def test_edges_are_not_shuffled(spark):
    names = spark.createDataFrame([(f"d{i}", n) for i in range(300) for n in (["x"] if i % 3 else ["x", "y"])] + [("d1", None), (None, "x"), ("d2", "x")], "dst string, name string")
    uses = spark.createDataFrame([(f"{'d' if i % 2 else 's'}{i}", n) for i in range(300) for n in ("x", "y", "z")] + [(None, "x"), ("s0", None)], "src string, name string")
    got = C.referencing_classes(names.where("dst <> 'd7' or dst is null"), uses, names)
    want = {(d.dst, u.src) for d in names.collect() for u in uses.collect() if d.name and d.name == u.name and d.dst and u.src and d.dst not in ("d7", u.src)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    top = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in top.split("Aggregate")[0]  # no distinct above the join that makes the edges


def test_tables_changed_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    Q.replace_keys(rows((1, "a"), (2, "b"), (2, "c"), (None, "n")), path, "k")
    Q.replace_keys(rows((2, "d"), (3, "e")), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([(1, "a"), (2, "d"), (3, "e"), (None, "n")], key=str)
    Q.replace_keys(rows((None, "m")), path, "k")
    assert Q.delete_keys(spark, path, "k", [1, 9]) == 1 and Q.delete_keys(spark, path, "k", [9]) == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([(2, "d"), (3, "e"), (None, "m")], key=str)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_strict_training_sheets(spark, tmp_path):
    sheet = tmp_path / "s.csv"
    sheet.write_text("task_id,feature__loc,feature__cc\nt1, 1.5 ,\nt2,x,2\nt3,NaN,1e999\n", encoding="utf-8-sig")
    loose = {r.task_id: (r.loc, r.cc) for r in T.read_training(spark, str(sheet), ("task_id",)).collect()}
    assert loose == {"t1": (1.5, None), "t2": (None, 2.0), "t3": (None, None)}
    with pytest.raises(errors.QuarryError) as e:
        T.read_training(spark, str(sheet), ("task_id",), strict=True)
    assert sorted((c["row"], c["feature"], c["cell"]) for c in e.value.details["cells"]) == [("t2", "feature__loc", "x"), ("t3", "feature__cc", "1e999"), ("t3", "feature__loc", "NaN")]
    sheet.write_text("task_id,feature__loc\nt1,1\nt2,\n")
    assert T.read_training(spark, str(sheet), ("task_id",), strict=True).count() == 2


def test_model_verbs(spark, tmp_path, capsys):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "a double, y int")
    where, registry = str(tmp_path / "m"), str(tmp_path / "registry")
    sha = T.save_model(E.fit_tree(df, ["a"], "y", "decision_tree"), where, {"features": ["a"], "smell_type": "long_method", "model": "decision_tree"})

    def said(*argv):
        code = cli.main(list(argv), spark)
        out = capsys.readouterr()
        return code, json.loads(out.out or out.err)

    assert said("model-register", registry, where)[1]["model_sha256"] == sha
    said("model-register", registry, where)
    assert said("model-verify", registry) == (0, {"models": 1, "changed": [], "valid": True})
    assert said("model-delete", registry, "none")[0] == 2
    assert said("model-delete", registry, sha) == (0, {"deleted": sha})
    assert said("model-verify", registry)[1]["models"] == 0
