"""Regressions fitted together against the same ones fitted one after the other; folds, forests, held-out projects."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import folds as V
from quarry.operators import learning as L
from quarry.settings import Training


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(240):
        p = rng.choice("aaaabbcdee")
        x = [rng.gauss(0, 2), rng.uniform(0, 50), 7.0]
        smell = "long_method" if i % 3 else "deep_nesting"
        out.append((f"t{i}", f"p{p}", smell, "method", int(x[0] + x[1] / 25 + rng.gauss(0, 1) > 1), *x, rng.uniform(-1, 1) if smell == "deep_nesting" else None, "clash"))
    return spark.createDataFrame(out, "task_id string, project_fingerprint string, smell_type string, entity_type string, label int, feature__a double, feature__b double, feature__same double, feature__c double, x_ string").repartition(3).cache()


@pytest.mark.parametrize("sizes, k, want", [
    ({"a": 5, "b": 3, "c": 3, "d": 2, "e": 1}, 3, {"a": 0, "c": 1, "b": 2, "d": 1, "e": 2}),
    ({"a": 2, "b": 2, "c": 2, "d": 2}, 2, {"d": 0, "c": 1, "b": 0, "a": 1}),
    ({"a": 100, "b": 1, "c": 1}, 2, {"a": 0, "c": 1, "b": 1}),
])
def test_groups_go_to_the_lightest_fold(sizes, k, want):
    assert V.group_folds(sizes, k) == want


def test_coefficients_equal_those_of_single_fits(rows):
    names = {"long_method": ["feature__a", "feature__b", "feature__same"], "deep_nesting": ["feature__a", "feature__b", "feature__same", "feature__c"]}
    every = names["deep_nesting"]
    data = V.with_x(rows, every)
    models = [V.Model(s, c, frozenset([p]), frozenset([p])) for s in names for p in ("pa", "pc", "pe") for c in (0.1, 10.0)]
    V.prepare(models, V.project_sums(rows, every), {s: np.array([n in fs for n in every]) for s, fs in names.items()})
    assert V.fit_many(data.select("smell_type", "project_fingerprint", "label", "x"), models, len(every)) < 30
    for m in models[::3]:
        train = rows.where((F.col("smell_type") == m.smell) & ~F.col("project_fingerprint").isin(list(m.without)))
        one = E.fit_logistic(train, names[m.smell], "label", m.c).stages[-1]
        mine = [m.beta[1 + every.index(n)] for n in names[m.smell]]
        assert np.allclose(mine, one.coefficients.toArray(), atol=1e-6) and m.beta[0] == pytest.approx(one.intercept, abs=1e-6)
        assert all(m.beta[1 + i] == 0 for i, n in enumerate(every) if n not in names[m.smell])


def test_held_out_projects_are_scored_by_models_of_the_others(rows):
    run = L.leave_one_out(rows, Training(models=("logistic",)), ("long_method", "deep_nesting", "none"))
    done = run.of("evaluated")
    assert len(done) == 10 and {r["smell_type"] for r in run.of("skipped")} == {"none"}
    got = {r.task_id: (float(r.p), r.held_out_project) for r in run.predictions.collect()}
    assert len(got) == 240
    for r in done[:3]:
        mine = rows.where(F.col("smell_type") == r["smell_type"])
        names = L.features_of_smell(mine, r["smell_type"])
        model = E.fit_logistic(mine.where(F.col("project_fingerprint") != r["held_out_project"]), names, "label", r["tuning"]["selected_parameters"]["c"])
        for x in E.positive_probability(model, mine.where(F.col("project_fingerprint") == r["held_out_project"])).collect():
            assert got[x.task_id] == (pytest.approx(x.p, abs=1e-6), r["held_out_project"])
        assert r["train_rows"] + r["test_rows"] == mine.count() and r["tuning"]["status"] == "selected" and len(r["tuning"]["candidates"]) == 3


def test_jobs_do_not_grow_with_projects(spark, rows):
    tracker = spark.sparkContext.statusTracker()

    def jobs(projects):
        group = f"folds-{len(projects)}"
        spark.sparkContext.setJobGroup(group, group)
        mine = rows.where(F.col("smell_type") == "long_method")
        L.logistic_folds(mine, [("long_method", p) for p in projects], {"long_method": ["feature__a", "feature__b"]}, Training())
        spark.sparkContext.setJobGroup("none", "none")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(["pa", "pb", "pc", "pd", "pe"]) <= jobs(["pa"]) + 12


def test_forests_choose_among_four_settings(rows):
    mine = rows.where(F.col("smell_type") == "long_method")
    model, record = L.tuned_forest(mine, ["feature__a", "feature__b"], Training(trees=3))
    assert record["status"] == "selected" and len(record["candidates"]) == 4 and record["selected_parameters"] in [dict(g) for g in L.FOREST_GRID]
    best = max(c["selection_score"] for c in record["candidates"])
    assert next(c["parameters"] for c in record["candidates"] if c["selection_score"] == best) == record["selected_parameters"]
    assert model.stages[-1].getNumTrees == 3
    alone = L.tuned_forest(mine.where("project_fingerprint = 'pa'"), ["feature__a"], Training(trees=2))[1]
    assert alone["status"] == "skipped" and alone["selected_parameters"] == dict(L.FOREST_GRID[0])


def test_one_class_everywhere_falls_back(rows):
    mine = rows.where("smell_type = 'long_method' AND label = 1")
    out = L.logistic_folds(mine, [("long_method", None)], {"long_method": ["feature__a"]}, Training())
    model, record = out["long_method", None]
    assert not model.usable and record["status"] == "fallback"


def test_all_registered_models_score_in_one_scan(rows):
    mine = rows.where("smell_type = 'long_method'")
    names = ["feature__a", "feature__b"]
    kinds = ["logistic", "decision_tree", "random_forest", "gradient_boosting"]
    models = [E.fit_logistic(mine, names, "label") if k == "logistic" else E.fit_tree(mine, names, "label", k) for k in kinds]
    cards = [{"smell_type": "long_method", "features": names, "model_sha256": k, "threshold": 0.4} for k in kinds]
    entities = mine.select(F.col("task_id").alias("entity_id"), "entity_type", F.col("feature__a").alias("a"), F.col("feature__b").alias("b")).withColumn("x", F.lit("clash"))
    got = L.registered_scores(entities, list(zip(models, cards, strict=True)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1
    found = {(r.entity_id, r.model_id): r for r in got.collect()}
    assert len(found) == 4 * mine.count()
    for model, kind in zip(models, kinds, strict=True):
        for r in E.positive_probability(model, mine).select("task_id", "p").collect():
            one = found[r.task_id, kind]
            assert one.probability == pytest.approx(r.p, abs=1e-9) and one.prediction == int(r.p >= 0.4) and one.threshold == 0.4
    assert L.registered_scores(entities.drop("b").withColumn("entity_type", F.lit("class")), [(models[0], cards[0])]).count() == 0
