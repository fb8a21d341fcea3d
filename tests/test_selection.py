"""Percentiles selected by cells against those of the ordered values."""

import random

import numpy as np
import pytest

from quarry.operators import rules as R

QS = [0, 1, 25, 33.3, 50, 90, 99.9, 100]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "p string, m double, cell string, n int")
    got = {(r.p, r.q): (r.n, r.threshold) for r in R.percentiles(df, [("m", q) for q in QS], ["p"], 1).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == {(k, float(q)) for k in groups for q in QS}
    for (k, q), (n, threshold) in got.items():
        assert n == len(groups[k]) and threshold == pytest.approx(np.percentile(groups[k], q), rel=1e-9, abs=1e-12)


def test_many_values_few_values_ties_and_outliers(spark):
    rng = random.Random(1)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(4000)] + [("few", float(rng.randrange(5))) for _ in range(3000)]
    rows += [("wide", 10 ** rng.uniform(-9, 12)) for _ in range(3000)] + [(None, 1.0)] * 20 + [("one", 1.0), ("none", None), ("none", None)]
    rows += [("half ties", 0.0)] * 500 + [("half ties", float(i)) for i in range(700)] + [("low", -5.0), ("low", 1e18), ("low", -1e18)]
    check(spark, rows)


def test_empty_and_small_samples(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)], "p string, m double")
    assert [r.threshold for r in R.percentiles(df, [("m", 50)], ["p"], 6).collect()] == [None]
    assert R.percentiles(df.where("m < 0"), [("m", 50)], ["p"]).count() == 0


def test_cells_of_very_many_values(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 4)
    rng = random.Random(2)
    check(spark, [("a", rng.uniform(0, 1)) for _ in range(3000)] + [("b", float(i // 900)) for i in range(2700)])
