"""Training and scoring runs: plans, holdout and leave-one-project-out runs, prediction rows, aggregates (ML-1..13, AGG-16..18, AGG-22, PRJ-11)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import require
from quarry.operators import attribution as A
from quarry.operators import bundles as B
from quarry.operators import evaluation as E
from quarry.operators import folds as V
from quarry.operators import rules as R
from quarry.settings import Training

PREFIX = "feature__"
#: Measures that are averaged over folds.
MEASURES = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "mcc", "roc_auc", "pr_auc", "brier")


def significant(p: Column) -> Column:
    """A probability as text with twelve significant digits and no zeros at its end, small ones with an exponent (PRJ-11)."""
    cut = lambda x: F.regexp_replace(x, r"\.?0+$", "")
    out = F.when(p == 0, "0")
    for least, digits in ((0.1, 12), (0.01, 13), (0.001, 14), (0.0001, 15)):
        out = out.when(p >= least, cut(F.format_string(f"%.{digits}f", p)))
    return out.otherwise(F.regexp_replace(F.format_string("%.11e", p), r"\.?0+e", "e"))


def measures(rows: DataFrame, by: list[str], truth: str = "label", predicted: str = "prediction", score: str = "p") -> DataFrame:
    """Per group support, class counts, confusion matrix, its measures, and those of the ranking (AGG-17, ML-9)."""
    c = E.binary_metrics(rows, by, truth, predicted)
    n, pos = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")
    c = c.withColumns({"support": n, "positives": pos, "negatives": F.col("fp") + F.col("tn"), "positive_rate": F.when(n > 0, pos / F.when(n > 0, n)), "predicted_positives": F.col("tp") + F.col("fp")})
    r = E.ranking(rows, by, truth, score)
    if by:
        return c.join(r, by)
    # one row each
    return c.crossJoin(F.broadcast(r))


def training_plan(rows: DataFrame, config: Training = Training(), smells: tuple[str, ...] | None = None) -> DataFrame:
    """(smell_type, n_rows, projects, classes, skip): why a smell cannot be trained, null where it can (ML-6).

    smells: those asked for; one without rows is skipped as absent.
    """
    have = rows.groupBy("smell_type").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("project_fingerprint").alias("projects"), F.countDistinct("label").alias("classes"))
    if smells is not None:
        asked = rows.sparkSession.createDataFrame([(s,) for s in smells], "smell_type string")
        have = asked.join(have, "smell_type", "left").fillna(0)
    skip = (
        F.when(F.col("n_rows") == 0, "smell is absent from the dataset")
        .when(F.col("n_rows") < config.min_samples, f"fewer than {config.min_samples} rows")
        .when(F.col("projects") < config.min_projects, f"fewer than {config.min_projects} projects")
        .when(F.col("classes") < 2, "only one class is present")
    )
    return have.withColumn("skip", skip)


def features_of_smell(rows: DataFrame, smell: str, prefix: str = PREFIX) -> list[str]:
    """The feature columns that every row of a smell fills (FLT-22)."""
    names = [c for c in rows.columns if c.startswith(prefix)]
    r = rows.where(F.col("smell_type") == smell).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if r["_n"] and r[c] == r["_n"]]


def classes_by_project(rows: DataFrame) -> dict[str, set[int]]:
    """Project to its labels; a bounded list of projects."""
    return {r[0]: set(r[1]) for r in rows.groupBy("project_fingerprint").agg(F.collect_set("label")).collect()}


#: Settings that grouped inner folds choose from; the first of equals.
GRID_C = (0.1, 1.0, 10.0)
FOREST_GRID = tuple({"maxDepth": depth, "minInstancesPerNode": leaf} for depth in (30, 12) for leaf in (1, 2))
INNER_FOLDS = 3


def _candidates(scored_: DataFrame, threshold: float) -> dict[int, tuple[tuple[float, float, float], dict]]:
    """Per candidate of validation rows (candidate, label, p): what it is chosen by (mcc, f1, pr_auc), and its measures."""
    rows = scored_.withColumn("prediction", (F.col("p") >= threshold).cast("int"))
    got = {r["candidate"]: r.asDict() for r in measures(rows, ["candidate"]).collect()}
    return {k: (tuple(float(r[m] or 0.0) for m in ("mcc", "f1", "pr_auc")), r) for k, r in got.items()}


def _chosen(grid: list[dict], found: list, projects: list[str], folds: int) -> tuple[int, dict]:
    """(place in the grid, record of the choice): the best candidate, of equals the first; the first where none could be judged."""
    best = max((k for k in range(len(grid)) if found[k] is not None), key=lambda k: (found[k][0], -k), default=None)
    at = 0 if best is None else best
    status = "skipped" if len(projects) < 2 else "fallback" if best is None else "selected"
    return at, {"status": status, "inner_splits": folds, "training_projects": projects, "selected_parameters": grid[at], "candidates": [{"parameters": g, "status": "evaluated" if f else "invalid", "selection_score": list(f[0]) if f else None} for g, f in zip(grid, found, strict=True)]}


def logistic_folds(rows: DataFrame, outer: list[tuple[str, str | None]], features: dict[str, list[str]], config: Training) -> dict[tuple[str, str | None], tuple[V.Model, dict]]:
    """Per (smell, held-out project or None): the tuned regression of the other projects, and how it was chosen (ML-4, ML-5, ML-7).

    Inner folds are balanced by rows, and every fold, setting and final model takes its steps in the same jobs; so jobs do
    not grow with projects, smells or settings.
    """
    names = sorted(set().union(*features.values()))
    data = V.with_x(rows, names).select("smell_type", "project_fingerprint", F.col("label").cast("int").alias("label"), "x").cache()
    sums = V.project_sums(rows, names)
    used = {s: np.array([n in features[s] for n in names]) for s in features}
    inner, final, plans = [], [], []
    for smell, held in outer:
        without = frozenset([held] if held is not None else [])
        sizes = {p: int(v[0]) for p, v in sums[smell].items() if p not in without}
        k = min(INNER_FOLDS, len(sizes)) if len(sizes) > 1 else 0
        of = V.group_folds(sizes, k) if k else {}
        parts = [frozenset(p for p in of if of[p] == i) for i in range(k)]
        at = len(inner)
        inner += [V.Model(smell, c, without | part, part) for c in GRID_C for part in parts]
        final += [V.Model(smell, c, without, without) for c in GRID_C]
        plans.append((at, k, sorted(sizes)))
    V.prepare(inner + final, sums, used)
    V.fit_many(data, inner + final, len(names))
    found: dict[int, tuple] = {}
    if any(m.usable for m in inner):
        # of inner model i of an outer one, the candidate is its place among the outer ones and the settings
        place = {}
        for o, (at, k, _) in enumerate(plans):
            place |= {at + j: o * len(GRID_C) + j // k for j in range(k * len(GRID_C))}
        of = rows.sparkSession.createDataFrame(sorted(place.items()), "model int, candidate int")
        judged = data.select("label", F.explode(V.tested(inner, len(names))).alias("t")).select("label", "t.*").join(F.broadcast(of), "model")
        found = _candidates(judged, config.threshold)
    out = {}
    for o, ((smell, held), (_, k, projects)) in enumerate(zip(outer, plans, strict=True)):
        at, record = _chosen([{"c": c} for c in GRID_C], [found.get(o * len(GRID_C) + i) for i in range(len(GRID_C))], projects, k)
        out[smell, held] = (final[o * len(GRID_C) + at], record)
    data.unpersist()
    return out


def tuned_forest(train: DataFrame, features: list[str], config: Training) -> tuple[object, dict]:
    """A random forest with the settings that grouped, balanced inner folds choose; fits of folds and settings run side by side (ML-4)."""
    sizes = {r[0]: r[1] for r in train.groupBy("project_fingerprint").count().collect()}
    k = min(INNER_FOLDS, len(sizes)) if len(sizes) > 1 else 0
    of = V.group_folds(sizes, k) if k else {}

    def judged(job: tuple[int, int]) -> DataFrame | None:
        candidate, fold = job
        test = [p for p in of if of[p] == fold]
        rest = train.where(~F.col("project_fingerprint").isin(test))
        if rest.select("label").distinct().count() < 2:
            return None
        model = E.fit_tree(rest, features, "label", seed=config.seed + candidate, numTrees=config.trees, **FOREST_GRID[candidate])
        return E.positive_probability(model, train.where(F.col("project_fingerprint").isin(test))).select(F.lit(candidate).alias("candidate"), "label", "p")

    jobs = [(c, f) for c in range(len(FOREST_GRID)) for f in range(k)]
    with ThreadPool(4) as pool:
        parts = [p for p in pool.map(judged, jobs) if p is not None] if jobs else []
    found = _candidates(reduce(DataFrame.union, parts), config.threshold) if parts else {}
    at, record = _chosen([dict(g) for g in FOREST_GRID], [found.get(i) for i in range(len(FOREST_GRID))], sorted(sizes), k)
    return E.fit_tree(train, features, "label", seed=config.seed, numTrees=config.trees, **FOREST_GRID[at]), record


def estimator(kind: str, train: DataFrame, features: list[str], config: Training) -> tuple[object, dict]:
    """(model, how it was tuned): grouped folds choose C of a logistic regression and the settings of a forest; the others have no grid (ML-3..5)."""
    if kind == "logistic":
        smell = train.withColumn("smell_type", F.lit(""))
        model, record = logistic_folds(smell, [("", None)], {"": features}, config)["", None]
        return E.fit_logistic(train, features, "label", model.c), record
    if kind == "random_forest":
        return tuned_forest(train, features, config)
    return E.fit_tree(train, features, "label", kind, config.seed), {"status": "none", "candidates": []}


def scored(model, rows: DataFrame, threshold: float) -> DataFrame:
    """rows with p, prediction by the threshold, confidence and uncertainty."""
    return _decided(E.positive_probability(model, rows).select(*rows.columns, "p"), threshold)


def _decided(rows: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("p") >= threshold
    sure = F.when(hit, F.col("p")).otherwise(1 - F.col("p"))
    return rows.select("*", hit.cast("int").alias("prediction"), sure.alias("confidence"), (1 - sure).alias("uncertainty"))


def prediction_rows(scored_: DataFrame, split: str, held_out: str | Column, model: str) -> DataFrame:
    """Scored rows as prediction rows (PRJ-11); columns that the rows lack are empty."""
    fixed = {"probability": significant(F.col("p")), "split": F.lit(split), "held_out_project": F.lit(held_out) if isinstance(held_out, str) else held_out, "model": F.lit(model)}
    have = set(scored_.columns)
    return scored_.select(*[fixed[c].alias(c) if c in fixed else (F.col(c) if c in have else F.lit("").alias(c)) for c in B.PREDICTION_COLUMNS], "p")


@dataclass
class Run:
    """What a training run gives: a result for each smell and model, or why there is none; predictions; models by (smell, kind)."""

    results: list[dict] = field(default_factory=list)
    predictions: DataFrame | None = None
    models: dict[tuple[str, str], object] = field(default_factory=dict)

    def add(self, rows: DataFrame) -> None:
        self.predictions = rows if self.predictions is None else self.predictions.unionByName(rows)

    def of(self, status: str) -> list[dict]:
        return [r for r in self.results if r["status"] == status]


def _skipped(plan: DataFrame, run: Run, **more: str) -> list[str]:
    """Notes the smells that cannot be trained; the others, in order."""
    go = []
    for r in sorted(plan.collect(), key=lambda r: r["smell_type"]):
        if r["skip"]:
            run.results.append({"status": "skipped", "smell_type": r["smell_type"], "reason": r["skip"], **more})
        else:
            go.append(r["smell_type"])
    return go


def _one(df: DataFrame) -> dict:
    row = df.first()
    return {} if row is None else {k: v for k, v in row.asDict().items() if k not in ("smell_type", "model")}


def holdout(rows: DataFrame, config: Training = Training(), smells: tuple[str, ...] | None = None) -> Run:
    """Every model of every smell, trained on some projects and tested on the others (ML-6).

    rows: smell_type, project_fingerprint, label, features with the prefix. The loop is over smells and model kinds; each
    fit and each evaluation is a distributed job.
    """
    run = Run()
    for smell in _skipped(training_plan(rows, config, smells), run):
        mine = rows.where(F.col("smell_type") == smell).cache()
        classes = classes_by_project(mine)
        train_on, test_on = E.split_projects(list(classes), classes, config.test_size, config.seed, config.tries)
        features = features_of_smell(mine, smell)
        train, test = (mine.where(F.col("project_fingerprint").isin(p)) for p in (train_on, test_on))
        if len(set().union(*(classes[p] for p in train_on))) < 2:
            run.results.append({"status": "skipped", "smell_type": smell, "reason": "training projects contain only one class"})
            continue
        for kind in config.models:
            model, tuning = estimator(kind, train, features, config)
            out = scored(model, test, config.threshold)
            balance = lambda d: {str(r["label"]): r["count"] for r in d.groupBy("label").count().collect()}
            run.results.append({
                "status": "trained", "smell_type": smell, "model": kind, "threshold": config.threshold, "features": features, "training_projects": train_on, "test_projects": test_on,
                "test_has_both_classes": set().union(*(classes[p] for p in test_on)) >= {0, 1}, "class_balance_train": balance(train), "class_balance_test": balance(test), "tuning": tuning, "metrics": _one(measures(out, [])),
            })
            run.models[smell, kind] = model
            run.add(prediction_rows(out, "test", "|".join(test_on), kind))
    return run


def leave_one_out(rows: DataFrame, config: Training = Training(), smells: tuple[str, ...] | None = None) -> Run:
    """Every project in turn is tested by models that the others trained (ML-7).

    Logistic regressions of all projects, smells, inner folds and settings are fitted together (operators.folds); trees
    are fitted for one project after the other.
    """
    run = Run()
    plan = training_plan(rows, config, smells)
    plan = plan.withColumn("skip", F.when(F.col("skip") == "only one class is present", None).otherwise(F.col("skip")))
    go = _skipped(plan, run, held_out_project="")
    mine = rows.where(F.col("smell_type").isin(go)).cache()
    features = {s: features_of_smell(mine, s) for s in go}
    have = {s: classes_by_project(mine.where(F.col("smell_type") == s)) for s in go}
    outer = []
    for smell in go:
        for project in sorted(have[smell]):
            if len(set().union(*(v for k, v in have[smell].items() if k != project))) < 2:
                run.results.append({"status": "skipped", "smell_type": smell, "held_out_project": project, "reason": "training projects contain only one class"})
            else:
                outer.append((smell, project))
    if not outer:
        return run
    sizes = {(r[0], r[1]): r[2] for r in mine.groupBy("smell_type", "project_fingerprint").count().collect()}
    for kind in config.models:
        tuning: dict[tuple[str, str], dict] = {}
        if kind == "logistic":
            every = sorted(set().union(*features.values()))
            fitted = logistic_folds(mine, outer, features, config)
            tuning = {k: r for k, (_, r) in fitted.items()}
            out = V.with_x(mine, every).withColumn("_t", F.explode(V.tested([m for m, _ in fitted.values()], len(every)))).withColumn("p", F.col("_t.p")).drop("x", "_t")
            out = _decided(out, config.threshold)
        else:
            parts = []
            for smell, project in outer:
                own = mine.where(F.col("smell_type") == smell)
                model, tuning[smell, project] = estimator(kind, own.where(F.col("project_fingerprint") != project), features[smell], config)
                parts.append(scored(model, own.where(F.col("project_fingerprint") == project), config.threshold))
            out = reduce(DataFrame.unionByName, parts)
        found = {(r["smell_type"], r["project_fingerprint"]): {k: v for k, v in r.asDict().items() if k not in ("smell_type", "project_fingerprint")} for r in measures(out, ["smell_type", "project_fingerprint"]).collect()}
        for smell, project in outer:
            n = sum(v for (s, _), v in sizes.items() if s == smell)
            run.results.append({"status": "evaluated", "smell_type": smell, "model": kind, "held_out_project": project, "train_projects": len(have[smell]) - 1, "train_rows": n - sizes[smell, project], "test_rows": sizes[smell, project], "tuning": tuning[smell, project], "metrics": found[smell, project]})
        run.add(prediction_rows(out, "test", F.col("project_fingerprint"), kind))
    return run


def aggregate_folds(predictions: DataFrame, fold: str = "held_out_project", by: tuple[str, ...] = ("smell_type", "model")) -> DataFrame:
    """Per smell and model: folds, micro measures of all predictions pooled, macro means over folds; folds without a measure do not count (AGG-18)."""
    rows = predictions.withColumn("label", F.col("label").cast("int")).withColumn("prediction", F.col("prediction").cast("int"))
    keys = list(by)
    micro = measures(rows, keys).select(*keys, *[F.col(m).alias(f"micro_{m}") for m in MEASURES])
    per = measures(rows, [*keys, fold])
    macro = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(f"macro_{m}") for m in MEASURES], *[F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m)).alias(f"std_{m}") for m in MEASURES])
    return macro.join(micro, keys)


def run_totals(predictions: DataFrame) -> DataFrame:
    """Per smell and over all: predictions and positive ones (AGG-22). The total's smell is null."""
    return predictions.rollup("smell_type").agg(F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("prediction") == 1).alias("positive"))


def registered_scores(entities: DataFrame, models: list[tuple[object, dict]]) -> DataFrame:
    """Predictions of registered models (model, card) over feature rows: every entity of the smell's type; a feature that an
    entity lacks counts 0 (ML-11).

    All models' coefficients and trees go to the tasks together, and an entity is scored by every model of its type at
    once: one scan, whatever the number of models.
    """
    require(models, "ml_error", "there is no enabled model")
    kinds = []
    for _, card in models:
        kind = next((k for k, names in B.SMELLS.items() if card["smell_type"] in names), None)
        require(kind, "ml_error", "unknown smell", smell=card["smell_type"])
        kinds.append(kind)
    plain = [{f: f.removeprefix(PREFIX) for f in card["features"]} for _, card in models]
    names = sorted({m for p in plain for m in p.values()})
    value = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in entities.columns else F.lit(0.0)
    keep = [c for c in ("project", "entity_id", "entity_type", "qualified_name", "path", "start_line", "end_line") if c in entities.columns]
    scorers = [A.scorer(model, [names.index(m) for m in p.values()]) for (model, _), p in zip(models, plain, strict=True)]
    rows = entities.where(F.col("entity_type").isin(*kinds)).select(*keep, F.array(*map(value, names)).alias("x"))
    rows = rows.select("*", F.explode(A.scores(F.col("entity_type"), F.col("x"), kinds, scorers, len(names))).alias("s")).withColumn("p", F.col("s.p"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("s.model"))
    limit = of([float(card.get("threshold", 0.5)) for _, card in models])
    inputs = F.get(F.array(*[F.struct(*[F.get("x", names.index(m)).alias(m) for m in p.values()]).cast("string") for p in plain]), F.col("s.model"))
    hit = F.col("p") >= limit
    sure = F.when(hit, F.col("p")).otherwise(1 - F.col("p"))
    smell, sha = of([c["smell_type"] for _, c in models]), of([c.get("model_sha256", "") for _, c in models])
    return rows.select(*keep, smell.alias("smell_type"), sha.alias("model_id"), F.col("p").alias("probability"), hit.cast("int").alias("prediction"), limit.alias("threshold"), sure.alias("confidence"), (1 - sure).alias("uncertainty"), inputs.alias("inputs"))


def demo_rows(spark: SparkSession, rule: R.Rule, n: int = 30) -> DataFrame:
    """Made-up rows around a rule's thresholds, half of them beyond: for trying models out, never a result (ML-13)."""
    i = F.col("id")
    beyond = (i % 2) == 0
    columns = []
    for k, c in enumerate(rule.conditions):
        up = c.op in (">", ">=")
        step = 1 + (i * (k + 3) % 7) / 10
        high, low = F.lit(c.absolute + 1) * step, F.lit(c.absolute) / (step + 1)
        columns.append((F.when(beyond == up, high).otherwise(low) if up else F.when(beyond, low).otherwise(high)).cast("double").alias(PREFIX + c.metric))
    return spark.range(n).select(F.concat(F.lit("demo-"), i).alias("task_id"), F.concat(F.lit("p"), i % 5).alias("project_fingerprint"), F.lit(rule.smell).alias("smell_type"), F.lit(rule.entity_type).alias("entity_type"), beyond.cast("int").alias("label"), *columns)


def demo_models(spark: SparkSession, rules: tuple[R.Rule, ...] | None = None, kind: str = "decision_tree") -> list[tuple[object, dict]]:
    """A model for each rule from demo_rows; the cards say that they are made up and hold no measures (ML-13)."""
    out = []
    for rule in rules or R.built_in():
        rows = demo_rows(spark, rule)
        features = [c for c in rows.columns if c.startswith(PREFIX)]
        model = E.fit_logistic(rows, features, "label") if kind == "logistic" else E.fit_tree(rows, features, "label", kind)
        out.append((model, {"smell_type": rule.smell, "model": kind, "features": features, "threshold": 0.5, "synthetic": True, "metrics": None}))
    return out
