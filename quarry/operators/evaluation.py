"""Evaluation of scores, project splits, folds, attributions, research aggregates (ML-2..10, AGG-17..19, XAI-1..5, RES-1)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import scores as S


#: Ranges of scores that a ranking is summed in.
RANGES = 64


def confusion(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def binary_metrics(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """Per group the confusion matrix and its measures (AGG-17)."""
    c = confusion(rows, by, truth, predicted)
    measures = S.binary_metrics(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    return c.select(*by, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in measures.items()])


def ranking(rows: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """Per group roc_auc, pr_auc (average precision) and brier; ties share a threshold, one class gives null (T12).

    Rows are reduced to one for each distinct score. These are dealt into ranges of scores; sums run within a range and
    start from the totals of the ranges above it, so no task sorts all scores of a group.
    """
    s = rows.groupBy(*by, score).agg(F.sum(F.col(truth).cast("double")).alias("_p"), F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.pow(F.col(score) - F.col(truth), 2)).alias("_b"))
    ends = sorted(set(rows.where(F.col(score).isNotNull()).approxQuantile(score, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    s = s.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: F.col(score) > e)) if ends else F.lit(0))
    down = W.partitionBy(*by, "_range").orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = s.groupBy(*by, "_range").agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    start = totals.select(*by, "_range", *[F.coalesce(F.sum(t).over(above), F.lit(0.0)).alias(a) for t, a in (("_tp", "_ap"), ("_tn", "_an"))])
    c = s.withColumn("_cp", F.sum("_p").over(down)).withColumn("_cn", F.sum("_n").over(down)).join(start, [*by, "_range"])
    c = c.withColumn("_cp", F.col("_cp") + F.col("_ap")).withColumn("_cn", F.col("_cn") + F.col("_an"))
    neg = F.col("_n") - F.col("_p")
    area = F.sum(neg * (F.col("_cp") - F.col("_p") / 2))
    ap = F.sum(F.col("_p") * F.col("_cp") / F.col("_cn"))
    out = c.groupBy(*by).agg(F.sum("_p").alias("pos"), F.sum(neg).alias("neg"), area.alias("a"), ap.alias("ap"), (F.sum("_b") / F.sum("_n")).alias("brier"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return out.select(*by, F.when(both, F.col("a") / (F.when(both, F.col("pos") * F.col("neg")))).alias("roc_auc"), F.when(both, F.col("ap") / F.when(both, F.col("pos"))).alias("pr_auc"), "brier")


def split_projects(projects: list[str], positive: dict[str, set[int]], test_size: float = 0.25, seed: int = 42, tries: int = 256) -> tuple[list[str], list[str]]:
    """(train, test) projects: a seeded shuffle whose test part has both classes if one of the tries gives it (ML-2).

    The project list is a bounded driver-side value; rows join the assignment by broadcast.
    """
    names = sorted(projects)
    if len(names) < 2:
        raise ValueError("two projects at least are needed")
    count = max(1, min(len(names) - 1, round(len(names) * test_size)))
    rng, first = random.Random(seed), None
    for _ in range(tries):
        order = names[:]
        rng.shuffle(order)
        test, train = sorted(order[:count]), sorted(order[count:])
        first = first or (train, test)
        if all(set().union(*(positive.get(p, set()) for p in part)) >= {0, 1} for part in (train, test)):
            return train, test
    return first


def hash_split(rows: DataFrame, project: str, test_percent: int, seed: str) -> DataFrame:
    """(project, split): projects fall by a hash, for lists too long for a driver."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col(project).cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return rows.select(project).distinct().withColumn("split", F.when(h % 100 < test_percent, "test").otherwise("train"))


def folds(rows: DataFrame, project: str, truth: str) -> DataFrame:
    """Leave-one-project-out folds: per project its rows and positives, and whether training has both classes (ML-7)."""
    p = rows.groupBy(project).agg(F.count(F.lit(1)).alias("n"), F.sum(truth).alias("pos"))
    # the totals are one row
    t = p.agg(F.sum("n").alias("tn"), F.sum("pos").alias("tp"))
    j = p.join(F.broadcast(t), F.lit(True))
    rest_p, rest_n = F.col("tp") - F.col("pos"), F.col("tn") - F.col("n") - (F.col("tp") - F.col("pos"))
    return j.select(project, "n", F.col("pos").cast("bigint").alias("pos"), F.when((rest_p > 0) & (rest_n > 0), "ok").otherwise("one class").alias("state"))


def macro(per_fold: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean of each measure over folds; undefined folds do not count (AGG-18)."""
    return per_fold.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(m).alias(m) for m in measures])


def confidence(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd and half-width of the 95 % interval; one value has sd 0 (AGG-19, RES-1)."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    sd = F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd"))
    return out.select(*by, "n", "mean", sd.alias("sd"), (1.96 * sd / F.sqrt(F.when(F.col("n") > 0, F.col("n")))).alias("ci95"))


def fit_logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Scaled, class-balanced logistic regression as a pipeline model (ML-3)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.lit(1.0)
    for k, v in n.items():
        weight = F.when(F.col(label) == k, total / (len(n) * v)).otherwise(weight)
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", regParam=1 / (c * max(1, total)), standardization=False, tol=1e-12, maxIter=1000)]
    return Pipeline(stages=stages).fit(train.withColumn("weight", weight))


def fit_tree(train: DataFrame, features: list[str], label: str, kind: str = "random_forest", seed: int = 42, **settings):
    """Tree estimators: random_forest, gradient_boosting or decision_tree, with settings of pyspark.ml by name (ML-3)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = {"random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier, "decision_tree": DecisionTreeClassifier}[kind](featuresCol="x", labelCol=label, seed=seed, **settings)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), made]).fit(train)


def positive_probability(model, rows: DataFrame) -> DataFrame:
    """Adds probability of class 1, predicted at 0.5, confidence and uncertainty (ML-8, ML-10, PRJ-7)."""
    from pyspark.ml.functions import vector_to_array

    p = F.get(vector_to_array("probability"), 1)
    out = model.transform(rows).withColumn("p", p)
    sure = F.when(F.col("p") >= 0.5, F.col("p")).otherwise(1 - F.col("p"))
    return out.withColumn("predicted", (F.col("p") >= 0.5).cast("int")).withColumn("confidence", sure).withColumn("uncertainty", 1 - sure)


def direction(contribution: Column) -> Column:
    """What a contribution does to the risk; none at all counts with the increases."""
    return F.when(contribution >= 0, "increases_smell_risk").otherwise("decreases_smell_risk")


def top_attributions(rows: DataFrame, key: list[str], contributions: Column, k: int = 8) -> DataFrame:
    """Long rows (key, feature number, contribution, direction, rank) of the k largest by size; ties by number (XAI-4).

    contributions is an array; each row's array is sorted on its own, so nothing is shuffled.
    """
    pairs = F.transform(contributions, lambda c, i: F.struct((-F.abs(c)).alias("o"), i.alias("feature"), c.alias("contribution")))
    ranked = rows.select(*key, F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("r", "t"))
    return ranked.select(*key, F.col("t.feature").alias("feature"), F.col("t.contribution").alias("contribution"), direction(F.col("t.contribution")).alias("direction"), (F.col("r") + 1).alias("rank"))


def linear_contributions(x: Column, coef: list[float]) -> Column:
    return F.zip_with(x, F.array(*map(F.lit, coef)), lambda a, b: a.cast("double") * b)


def tree_contributions(x: Column, importance: list[float]) -> Column:
    """Importance times distance from the row's median."""
    values = F.array_sort(F.transform(x, lambda a: a.cast("double")))
    n = F.size(values)
    median = (F.element_at(values, ((n + 1) / 2).cast("int")) + F.element_at(values, (n / 2).cast("int") + 1)) / 2
    return F.zip_with(x, F.array(*map(F.lit, importance)), lambda a, b: b * (a.cast("double") - median))


def priority(probability: Column) -> Column:
    return F.when(probability >= 0.85, "high").when(probability >= 0.65, "medium").otherwise("low")


#: What to do about a smell.
ACTIONS = {
    "god_class": "Extract cohesive groups of methods into classes of their own",
    "large_class": "Split the class along its responsibilities",
    "data_class": "Move behaviour to the data it works on",
    "lazy_class": "Inline the class into its users",
    "long_method": "Extract steps of the method into named methods",
    "complex_method": "Replace nested conditions by guard clauses or polymorphism",
    "long_parameter_list": "Introduce a parameter object",
    "deep_nesting": "Flatten control flow with early returns",
    "feature_envy": "Move the method to the class whose data it uses",
    "message_chain": "Hide the navigation behind a delegating method",
}


def recommend(predictions: DataFrame, smell: str, probability: str) -> DataFrame:
    pairs = [F.lit(x) for kv in ACTIONS.items() for x in kv]
    return predictions.withColumn("priority", priority(F.col(probability))).withColumn("action", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(smell)), F.lit("Review the entity and refactor where it helps")))
