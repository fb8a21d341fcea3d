"""Result queries: pages, ranks, filters, views, jobs, reports (FLT-15..19, SRT-*, LIM-*, VIEW-*, JOB-*, SNK-8..10, LKP, DEL, UPD)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.errors import require
from quarry.functions import scores as S
from quarry.functions import text as T


def page(rows: DataFrame, order: list[Column | str], limit: int = 100, offset: int = 0, max_limit: int = 500) -> tuple[DataFrame, int]:
    """(items, total) (LIM-1)."""
    if not 1 <= limit <= max_limit or offset < 0:
        raise ValueError("limit or offset out of range")
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def filtered(rows: DataFrame, equal: dict | None = None, contains: dict | None = None, ignore_case: bool = False) -> DataFrame:
    """Rows that match every given value; None values do not filter (FLT-15, FLT-19)."""
    for c, v in (equal or {}).items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        if v:
            rows = rows.where(F.lower(c).contains(v.lower()) if ignore_case else F.col(c).contains(v))
    return rows


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key (LKP-1, LKP-2)."""
    return rows.where(F.col(key) == value)


def top(rows: DataFrame, metric: str, k: int, ties: str, default: str = "loc") -> DataFrame:
    """k rows by a metric, largest first; an unknown metric means default (SRT-1, SRT-2)."""
    by = metric if metric in rows.columns else default
    return rows.orderBy(F.col(by).desc_nulls_last(), ties).limit(k)


def missing(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requested.join(known, key, "left_anti")


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have, once (SET-2)."""
    return a.select(key).intersect(b.select(key))


def in_either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that one or both have, once (SET-2)."""
    return a.select(key).union(b.select(key)).distinct()


def counts(rows: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Counts by value, largest first, ties by value (AGG-20)."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)
    return out if k is None else out.limit(k)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def health(findings: DataFrame, group: str, severity: str) -> DataFrame:
    """Per group: findings, dashboard score and grade, debt (VIEW-1)."""
    sev = lambda *s: F.count_if(F.col(severity).isin(*s))
    c = findings.groupBy(group).agg(F.count(F.lit(1)).alias("n"), sev("critical", "high").alias("high"), sev("medium").alias("medium"))
    score = half_up(F.greatest(F.lit(35.0), 100 - F.least(F.lit(65.0), 3 * F.col("high") + 1.5 * F.col("medium") + 0.2 * F.col("n"))))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D")
    return c.select(group, "n", "high", "medium", score.alias("score"), half_up(1.5 * F.col("n")).alias("debt")).withColumn("grade", grade)


def rule_vs_model(entities: DataFrame, by_rule: DataFrame, by_model: DataFrame, key: str) -> DataFrame:
    """One row: tp, fp, fn, tn of model positives against rule findings; nothing is made up where a cell is 0 (VIEW-3)."""
    r = by_rule.select(key).distinct().withColumn("r", F.lit(True))
    m = by_model.select(key).distinct().withColumn("m", F.lit(True))
    j = entities.select(key).join(r, key, "left").join(m, key, "left").select(F.coalesce("r", F.lit(False)).alias("r"), F.coalesce("m", F.lit(False)).alias("m"))
    return j.agg(F.count_if(F.expr("r and m")).alias("tp"), F.count_if(F.expr("m and not r")).alias("fp"), F.count_if(F.expr("r and not m")).alias("fn"), F.count_if(F.expr("not r and not m")).alias("tn"))


# jobs: status queued, running, succeeded, failed, cancelled


def claim(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """The oldest claimable job becomes running (JOB-2, FLT-18). One global minimum; no row is ordered."""
    open_ = (F.col("status") == "queued") & ~F.col("cancelled") & (F.col("attempts") < F.col("max_attempts"))
    first = jobs.where(open_).agg(F.min(F.struct("queued_at", "job_id")).alias("f")).select(F.col("f.job_id").alias("_claimed"))
    j = jobs.join(F.broadcast(first), F.col("job_id") == F.col("_claimed"), "left")
    hit = F.col("_claimed").isNotNull()
    return j.withColumns({"status": F.when(hit, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + F.when(hit, 1).otherwise(0), "worker": F.when(hit, worker).otherwise(F.col("worker")), "heartbeat_at": F.when(hit, now).otherwise(F.col("heartbeat_at"))}).drop("_claimed")


def recover(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs whose heartbeat is before cutoff are queued again, or failed after their last attempt (JOB-3)."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < cutoff)
    return jobs.withColumn("status", F.when(stale & (F.col("attempts") >= F.col("max_attempts")), "failed").when(stale, "queued").otherwise(F.col("status")))


def cancel(jobs: DataFrame, job_id) -> DataFrame:
    """A queued job is cancelled, a running one marked (JOB-4)."""
    hit = F.col("job_id") == job_id
    return jobs.withColumn("cancelled", F.col("cancelled") | (hit & F.col("status").isin("queued", "running"))).withColumn("status", F.when(hit & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status")))


def retry(jobs: DataFrame) -> DataFrame:
    """Failed and cancelled jobs are queued again from attempt 0; exhausted ones may try three times more (JOB-4)."""
    hit = F.col("status").isin("failed", "cancelled")
    limit = F.when(hit & (F.col("attempts") >= F.col("max_attempts")), F.col("max_attempts") + 3).otherwise(F.col("max_attempts"))
    return jobs.withColumns({"max_attempts": limit, "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "cancelled": F.col("cancelled") & ~hit, "status": F.when(hit, "queued").otherwise(F.col("status"))})


def delete_by(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is doomed (DEL-1)."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def guarded_delete(tables: dict[str, DataFrame], root: str, doomed: DataFrame, key: str, cascade: dict[str, str], in_use: DataFrame | None = None) -> dict[str, DataFrame]:
    """tables without the doomed rows of root, and without what hangs on them by cascade (table to its column); an error where one is in use (DEL-1).

    in_use holds keys that must not go: projects with open jobs, models with predictions.
    """
    if in_use is not None:
        held = doomed.select(key).join(in_use.select(key), key, "left_semi").distinct().limit(5).collect()
        require(not held, "conflict", "rows are in use", keys=[r[0] for r in held])
    out = {**tables, root: delete_by(tables[root], doomed, key)}
    for name, column in cascade.items():
        out[name] = delete_by(tables[name], doomed.select(F.col(key).alias(column)), column)
    return out


def active(jobs: DataFrame, by: str = "project_id") -> DataFrame:
    """Keys with a job that is queued or runs (AGG-21)."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def update_users(users: DataFrame, user_id, changes: dict) -> DataFrame:
    """A user's row changed; the last enabled administrator can neither be disabled nor demoted (UPD-1)."""
    out = patched(users, F.col("user_id") == user_id, {c: F.lit(v) for c, v in changes.items()})
    before, after = (d.where((F.col("role") == "admin") & F.col("enabled")).count() for d in (users, out))
    require(not (before and not after), "conflict", "the last administrator stays")
    return out


def found(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none is an error (LKP-1)."""
    out = lookup(rows, key, value)
    require(not out.isEmpty(), "not_found", "there is no such row", key=str(value))
    return out


def within(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the keys (JOIN-4)."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def explanations_of(explanations: DataFrame, predictions: DataFrame, job_id) -> DataFrame:
    """Explanations of a job's predictions (JOIN-3)."""
    return explanations.join(predictions.where(F.col("job_id") == job_id).select("prediction_id"), "prediction_id", "left_semi")


def reports_of(reports: DataFrame, jobs: DataFrame, project_id) -> DataFrame:
    """Reports of a project's jobs that have a file (JOIN-3)."""
    return reports.where("path is not null").join(jobs.where(F.col("project_id") == project_id).select("job_id"), "job_id", "left_semi")


def analysis_health(rows: DataFrame, group: str, priority: str) -> DataFrame:
    """Per group: recommendations or findings, those of high priority, score and grade (VIEW-2)."""
    c = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(priority) == "high").alias("high"))
    score = F.greatest(F.lit(15), half_up(98 - 1.8 * F.col("n") - 3.5 * F.col("high")).cast("bigint"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D")
    return c.withColumn("score", score).withColumn("grade", grade)


def by_role(users: DataFrame, roles: tuple[str, ...] = ("admin", "analyst", "viewer")) -> DataFrame:
    """Users of each role, enabled and in all; a role without users counts 0 (VIEW-4)."""
    domain = users.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    n = users.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("enabled"))
    return domain.join(n, "role", "left").fillna(0)


#: Orders of result lists (SRT-3, SRT-5, SRT-6): column and whether the largest comes first.
ORDERS = {
    "findings": (("path", False), ("start_line", False), ("smell", False)),
    "metrics": (("path", False), ("start_line", False), ("qualified_name", False)),
    "events": (("created_at", False), ("event_id", False)),
    "predictions": (("probability", True), ("prediction_id", False)),
    "explanations": (("explanation_id", False),),
    "recommendations": (("priority", True), ("recommendation_id", False)),
    "projects": (("created_at", True), ("project_id", False)),
    "jobs": (("queued_at", True), ("job_id", False)),
    "reports": (("created_at", True), ("report_id", False)),
    "audit": (("created_at", True), ("event_id", False)),
    "models": (("smell_type", False), ("model_kind", False)),
    "users": (("email", False),),
}


def in_order(rows: DataFrame, what: str, ranks: bool = True) -> list[Column]:
    """The order of a result list, of those of its columns that rows has. Priorities go by rank, or as text where ranks is off."""
    out = []
    for c, down in ORDERS[what]:
        if c in rows.columns:
            x = F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col(c)) if c == "priority" and ranks else F.col(c)
            out.append(x.desc() if down else x.asc())
    return out


def listed(rows: DataFrame, what: str, limit: int = 100, offset: int = 0, ranks: bool = True) -> tuple[DataFrame, int]:
    """A page of a result list in its order, and the number of all rows (LIM-1, SRT-6)."""
    return page(rows, in_order(rows, what, ranks), limit, offset)


def patched(rows: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Columns rewritten where a condition holds (UPD-1)."""
    return rows.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows in place of the partitions that they name (SNK-8)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _put(rows: DataFrame, path: str) -> None:
    """Rows made from a Parquet table in its place: written beside it, then two renames."""
    spark = rows.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    rows.write.parquet(f"{path}.new-{mark}")
    where, aside, new = to(path), to(f"{path}.old-{mark}"), to(f"{path}.new-{mark}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.rename(where, aside) and fs.rename(new, where)):
        raise OSError(f"{path} could not be replaced; its rows are there as they were, or in {path}.old-{mark}")
    fs.delete(aside, True)


def replace_keys(rows: DataFrame, path: str, key: str) -> None:
    """Writes rows in place of those of their keys in a Parquet table, whatever its layout (SNK-8).

    A failure before the renames leaves the old table as it was, one between them leaves it beside with its mark.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows.write.parquet(path)
        return
    keys = rows.select(F.col(key).alias("_key")).distinct()
    _put(spark.read.parquet(path).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(rows), path)


def delete_keys(spark: SparkSession, path: str, key: str, values: list) -> int:
    """Takes the rows of some keys out of a Parquet table; how many keys it had of them."""
    old = spark.read.parquet(path)
    there = old.where(F.col(key).isin(values)).select(key).distinct().count()
    if there:
        _put(old.where(~F.coalesce(F.col(key).isin(values), F.lit(False))), path)
    return there


def section(rows: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, bool]:
    """(rows of a report section, whether some were left out) (LIM-2)."""
    return rows.orderBy(*order).limit(limit), len(rows.select(order[0]).take(limit + 1)) > limit


def csv_cells(rows: DataFrame) -> DataFrame:
    """Every cell as text, safe for spreadsheets (SNK-10)."""
    plain = lambda c, t: F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")
    return rows.select(*[T.guarded(F.coalesce(plain(c, t), F.lit(""))).alias(c) for c, t in rows.dtypes])


def findings_order() -> list[Column]:
    return [S.severity_rank(F.col("severity")).desc(), F.col("path"), F.col("start_line"), F.col("smell")]


def running_totals(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    return rows.withColumn("running", F.sum(value).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
