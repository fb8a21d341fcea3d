"""Shapley values of trees against all subsets, and against what fitted models return."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import attribution as T
from quarry.operators import evaluation as E
from quarry.operators import explain as X


def tree(rng, depth, features, missing=0.2):
    if depth == 0 or rng.random() < missing:
        return T.Leaf(round(rng.uniform(-1, 1), 3), rng.randrange(1, 40))
    return T.Split(rng.randrange(features), round(rng.uniform(-1, 1), 1), tree(rng, depth - 1, features), tree(rng, depth - 1, features))


def known(node, x, subset):
    """The tree's mean over what is not in the subset."""
    if isinstance(node, T.Leaf):
        return node.value
    if node.feature in subset:
        return known(node.left if x[node.feature] <= node.threshold else node.right, x, subset)
    return (node.left.count * known(node.left, x, subset) + node.right.count * known(node.right, x, subset)) / node.count


def enumerated(ensemble, x):
    n, out = len(x), []
    v = {s: sum(w * known(t, x, s) for w, t in ensemble.trees) for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
    for i in range(n):
        out.append(sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n) * (v[s | {i}] - v[s]) for s in v if i not in s))
    return out, v[frozenset()], v[frozenset(range(n))]


@pytest.mark.parametrize("features", [1, 2, 5, 8])
def test_values_are_those_of_all_subsets(features):
    rng = random.Random(features)
    ensemble = T.Ensemble(tuple((rng.choice([0.25, 1.0, 2.0]), tree(rng, 5, features)) for _ in range(4)) + ((1.0, T.Leaf(0.5, 3)),))
    x = np.round(np.random.default_rng(features).uniform(-1.2, 1.2, (25, features)), 1)  # values on thresholds too
    got = T.values(x, ensemble.paths(), features)
    for row, mine in zip(x, got, strict=True):
        want, base, output = enumerated(ensemble, row)
        assert np.allclose(mine, want, atol=1e-12) and base == pytest.approx(ensemble.base) and base + mine.sum() == pytest.approx(output, abs=1e-9)


def test_missing_values_go_right():
    one = T.Ensemble(((1.0, T.Split(0, 0.0, T.Leaf(1.0, 1), T.Leaf(3.0, 3))),))
    assert T.values(np.array([[np.nan]]), one.paths(), 1)[0][0] + one.base == 3.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = []
    for i in range(300):
        x = [round(rng.uniform(-1, 1), 2) for _ in range(4)]
        data.append((i, *x, int(x[0] + x[1] * x[2] > rng.uniform(-0.3, 0.3)), "clash", 0.0))
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, label int, base string, output double")


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest", "gradient_boosting"])
def test_base_and_contributions_add_up_to_what_the_model_returns(spark, rows, kind):
    names = ["a", "b", "c", "d"]
    model = E.fit_tree(rows, names, "label", kind)
    out = X.explain(model, names, rows, k=4)
    p = {r.id: r.p for r in E.positive_probability(model, rows).select("id", "p").collect()}
    for r in out.collect():
        assert r.method == "tree_shapley"
        raw = 1 / (1 + math.exp(-r.output_value)) if kind == "gradient_boosting" else r.output_value
        assert raw == pytest.approx(p[r.id], abs=1e-9)
        assert r.base_value + sum(t.contribution for t in r.top_features) == pytest.approx(r.output_value, abs=1e-9)
        assert all((t.contribution >= 0) == (t.direction == "increases_smell_risk") for t in r.top_features)
    # the values themselves, for the model's own trees
    ensemble = T.of_model(model)
    some = rows.limit(5).collect()
    got = T.values(np.array([[r[n] for n in names] for r in some]), ensemble.paths(), 4)
    for r, mine in zip(some, got, strict=True):
        assert np.allclose(mine, enumerated(ensemble, [r[n] for n in names])[0], atol=1e-9)


def test_empty_rows_and_other_columns(spark, rows):
    one = T.Ensemble(((1.0, T.Split(0, 0.0, T.Leaf(1.0, 1), T.Leaf(3.0, 3))),))
    x = F.array("a", "b")
    assert T.explained(rows.where("id < 0"), x, one, 2).count() == 0
    got = T.explained(rows.limit(3), x, one, 2).first()
    assert got.base == 2.5 and got.output in (1.0, 3.0)
