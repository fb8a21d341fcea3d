"""Environments told by prefixes, and cohesion of large classes by bitmaps."""

import itertools
import random
import time

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.sources import inventory as I


def outside(spark, paths):
    df = spark.createDataFrame([(p, b"x", "clash") for p in paths], "path string, content binary, roots string")
    return sorted(r.path for r in I.without_virtualenvs(df).collect())


def test_environments_are_told_by_whole_folders(spark):
    paths = ["env1/pyvenv.cfg", "env1/a.py", "env10/a.py", "env1.py", "a/env1/b.py", "x/y/pyvenv.cfg", "x/y/z/pyvenv.cfg", "x/y/z/w.py", "x/y/k.py", "x/ya/k.py", "x/y-b/k.py", "q/bin/activate", "q/lib/p.py", "q/m.py", "r/bin/activate", "r/m.py"]
    assert outside(spark, paths) == sorted(["env10/a.py", "env1.py", "a/env1/b.py", "x/ya/k.py", "x/y-b/k.py", "r/bin/activate", "r/m.py"])
    assert outside(spark, ["a.py", "b/c.py"]) == ["a.py", "b/c.py"]
    assert outside(spark, ["pyvenv.cfg", "a.py"]) == []


def test_many_environments_and_the_join_beyond_their_number(spark, monkeypatch):
    rng = random.Random(2)
    roots = {f"p{rng.randrange(400)}/v{rng.randrange(9)}" for _ in range(300)}
    paths = [f"{r}/pyvenv.cfg" for r in roots] + [f"p{rng.randrange(400)}/v{rng.randrange(12)}/f{i}.py" for i in range(2000)]
    want = sorted(p for p in paths if not any(p.startswith(r + "/") for r in roots))
    assert outside(spark, paths) == want
    monkeypatch.setattr(I, "MAX_VIRTUALENVS", 10)
    assert outside(spark, paths) == want


def test_no_shuffle_of_contents(spark):
    df = spark.createDataFrame([("v/pyvenv.cfg", b"x"), ("a.py", b"y")], "path string, content binary")
    plan = I.without_virtualenvs(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_cohesion_equals_counted_pairs(spark):
    rng = random.Random(3)
    rows = [(c, f"m{i}", rng.sample("abcdefgh", rng.randrange(4)) if rng.random() < 0.9 else None) for c in range(12) for i in range(rng.randrange(9))]
    got = {r.c: r.lcom1 for r in G.lcom1(spark.createDataFrame(rows, "c int, m string, f array<string>"), "c", "m", "f").collect()}
    for c in {r[0] for r in rows}:
        sets = [set(f or ()) for k, _, f in rows if k == c]
        share = sum(bool(a & b) for a, b in itertools.combinations(sets, 2))
        assert got[c] == max(0, len(sets) * (len(sets) - 1) // 2 - 2 * share)


def test_a_class_of_three_thousand_methods(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("c", f"m{i}", [f"f{rng.randrange(400)}" for _ in range(3)]) for i in range(3000)], "c string, m string, f array<string>").coalesce(1).cache()
    df.count()
    G.lcom1(df.limit(5), "c", "m", "f").collect()
    began = time.time()
    assert G.lcom1(df, "c", "m", "f").select(F.col("lcom1")).first().lcom1 > 4_000_000
    assert time.time() - began < 20
