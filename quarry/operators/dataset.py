"""Review datasets: sampling, ids, validation, final labels, agreement (DST-1..5, DQ-1..4, AGG-12..16, SET-1..3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ("present", "absent", "uncertain")
REQUIRED = ("task_id", "project", "smell", "entity_id", "path", "source_sha256")
#: Columns of the blinded sheet that must not tell where a task comes from.
HIDDEN = ("source", "evidence", "severity_by_rule", "excess")


def stable_id(*parts: Column, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of the parts, each followed by NUL (DST-3)."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.char(F.lit(0)))]), 256), 1, length)


def controls(entities: DataFrame, positives: DataFrame, key: str, group: list[str], ratio: float, minimum: int, seed: str) -> DataFrame:
    """Entities without a finding, drawn per group: max(minimum, ceil(ratio * positives)), at most all (DST-2).

    The draw is by hash order, so it does not depend on partitioning. Candidates are counted by the first digits of their
    hashes: those before the bucket in which a group's number is reached are taken, and only that bucket is ranked.
    Findings grow with the entities, so they are met by a shuffle also where their compressed rows look small.
    """
    wanted = positives.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) * ratio).alias("w")).select(*group, F.greatest("w", F.lit(minimum)).alias("w"))
    return drawn(entities.join(positives.select(key, *group).distinct().hint("merge"), [key, *group], "left_anti"), wanted, key, group, seed)


def drawn(candidates: DataFrame, wanted: DataFrame, key: str, group: list[str], seed: str) -> DataFrame:
    """The first w candidates of each group in the order of their hashes; wanted: group, w.

    Groups are few (rules): what is broadcast is at most 4,096 rows for each, never the candidates.
    """
    order = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(g).cast("string") for g in group], F.col(key).cast("string")), 256)
    rest = candidates.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    counted = rest.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n")).join(wanted, group)
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    left = counted.withColumn("_left", F.col("w") - before).where("_left > 0").select(*group, "_b", "_left", (F.col("_n") <= F.col("_left")).alias("_all"))
    met = rest.join(F.broadcast(left), [*group, "_b"])
    ranked = met.where("not _all").withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy("_h", key))).where("_r <= _left").drop("_r")
    return met.where("_all").union(ranked).drop("_h", "_b", "_left", "_all")


def bundle(positives: DataFrame, drawn: DataFrame) -> DataFrame:
    """Tasks from rule findings and controls, with their source (DST-1, SET-1)."""
    return positives.withColumn("source", F.lit("rule")).unionByName(drawn.withColumn("source", F.lit("control")), allowMissingColumns=True)


def blind(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review sheet, evidence): two column sets that share task_id (DST-4)."""
    seen = [c for c in tasks.columns if c not in HIDDEN]
    return tasks.select(*seen), tasks.select("task_id", *[c for c in tasks.columns if c in HIDDEN])


def validate_review(rows: DataFrame, order: str, required: tuple[str, ...], complete: bool = False) -> DataFrame:
    """Issues (row_number, task_id, field, message) of a review sheet (DQ-1).

    Checks: blank or repeated task_id, blank required fields, labels outside the domain, a label without reviewer,
    a severity that does not fit its label, and, if complete is asked for, missing labels.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    issue = lambda when, name, text: F.when(when, F.struct(F.lit(name).alias("field"), F.lit(text).alias("message")))
    label, severe = F.coalesce("label", F.lit("")), F.coalesce("severity", F.lit(""))
    checks = [
        issue(blank("task_id"), "task_id", "blank"),
        issue(~blank("task_id") & (F.col("_again")), "task_id", "duplicate"),
        *[issue(blank(c), c, "blank") for c in required if c != "task_id"],
        issue((label != "") & ~label.isin(*LABELS), "label", "unknown"),
        issue((label != "") & blank("reviewer"), "reviewer", "missing"),
        issue((label == "present") & severe.isin("", "none"), "severity", "missing for present"),
        issue((label == "absent") & ~severe.isin("", "none"), "severity", "given for absent"),
    ]
    if complete:
        checks.append(issue(label == "", "label", "missing"))
    # blank ids are no group, and of an id only the first row's number is needed
    named = rows.where(~blank("task_id"))
    first = named.groupBy("task_id").agg(F.min(order).alias("_first"))
    marked = named.join(first, "task_id").withColumn("_again", F.col(order) > F.col("_first")).drop("_first").select(*rows.columns, "_again")
    marked = marked.union(rows.where(blank("task_id")).withColumn("_again", F.lit(False)))
    return marked.select(F.col(order).alias("row_number"), "task_id", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("row_number", "task_id", "i.field", "i.message")


def label_counts(rows: DataFrame, *by: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("label") == v)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), n("present").alias("n_present"), n("absent").alias("n_absent"), n("uncertain").alias("n_uncertain"), F.count_if(F.coalesce("label", F.lit("")) == "").alias("n_open"))


def finalise(rows: DataFrame) -> DataFrame:
    """Decided labels as 0 or 1; severity none where absent; uncertain rows go (DST-5)."""
    y = F.when(F.col("label") == "present", 1).when(F.col("label") == "absent", 0)
    return rows.withColumn("y", y).where("y is not null").withColumn("severity", F.when(F.col("y") == 1, F.col("severity")).otherwise("none"))


def agreement(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """One row: common, only_first, only_second, conflicts, agreement, kappa (AGG-14, DQ-2).

    Only joint counts of label pairs leave the join; kappa is null without common rows and 1 where chance is certain.
    """
    a, b = first.select(key, F.col(label).alias("a")), second.select(key, F.col(label).alias("b"))
    joint = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer").groupBy("a", "b", "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    n = joint.withColumn("row", F.sum(F.when(both, F.col("n"))).over(W.partitionBy("a"))).withColumn("col", F.sum(F.when(both, F.col("n"))).over(W.partitionBy("b")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    # a label on the diagonal may never be given by both: its marginals then meet in other cells
    rows = n.where(both).groupBy(F.col("a").alias("l")).agg(F.max("row").alias("ra"))
    cols = n.where(both).groupBy(F.col("b").alias("l")).agg(F.max("col").alias("cb"))
    chance = rows.join(cols, "l").agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("cb")), F.lit(0.0)).alias("e"))
    sums = joint.agg(total(both).alias("common"), total(F.col("_b").isNull()).alias("only_first"), total(F.col("_a").isNull()).alias("only_second"), total(both & (F.col("a") != F.col("b"))).alias("conflicts"))
    out = sums.join(chance, F.lit(True))
    po, pe = 1 - F.col("conflicts") / F.when(F.col("common") > 0, F.col("common")), F.col("e") / F.when(F.col("common") > 0, F.col("common") * F.col("common"))
    return out.select("common", "only_first", "only_second", "conflicts", po.alias("agreement"), F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / F.when(pe != 1, 1 - pe)).alias("kappa"))


def conflicts(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """Rows on which two reviewers differ (PRJ-10, SNK-7)."""
    return first.select(key, F.col(label).alias("first_label")).join(second.select(key, F.col(label).alias("second_label")), key).where("first_label <> second_label")


def feature_integrity(labels: DataFrame, features: DataFrame, key: str, sha: str) -> DataFrame:
    """Per label row its problem or ok: missing entity, changed source, or features given twice (DQ-3, ML-1)."""
    f = features.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(sha).alias("_sha"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(F.col("_sha") != F.col(sha), "changed").otherwise("ok")
    return labels.join(f, key, "left").withColumn("state", state).drop("_n", "_sha")


def validate_training(rows: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(key, problem) for labels outside 0 and 1, and features that are no finite numbers (DQ-4)."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    checks = [F.when(F.col(label).isNull() | ~F.col(label).isin(0, 1), F.lit("label")), *[F.when(bad(c), F.lit(c)) for c in features]]
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem"))
