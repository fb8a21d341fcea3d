"""Jobs as tables: enqueue, progress, ends, the worker's loop, orchestration (JOB-1, JOB-5..8, SNK-17, PLT-6)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import QuarryError, require
from quarry.operators import query as Q

JOBS = (
    "job_id string, project_id string, kind string, mode string, min_severity string, model_ids array<string>, status string, progress int, message string, queued_at timestamp, heartbeat_at timestamp, completed_at timestamp, "
    "attempts int, max_attempts int, cancelled boolean, worker string, error_code string, error_message string, summary string"
)
EVENTS = "event_id string, job_id string, kind string, message string, details string, created_at timestamp"
REPORTS = "report_id string, job_id string, format string, status string, path string, sha256 string, error string, created_at timestamp"
AUDIT = "event_id string, actor string, action string, subject string, details string, created_at timestamp"
KINDS = ("rule", "ml", "hybrid")


class Cancelled(Exception):
    """A running job was asked to stop."""


class Store:
    """Small state tables as numbered Parquet versions; the highest complete number is the table. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v") and done(s))

    def read(self, name: str, schema: str) -> DataFrame:
        have = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{have[-1]}") if have else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> None:
        """The table's next version; older ones but the last go."""
        have = self._versions(name)
        rows.coalesce(1).write.parquet(f"{self.root}/{name}/v{(have or [0])[-1] + 1}")
        for old in have[:-1]:
            fs, p = self._fs(f"{self.root}/{name}/v{old}")
            fs.delete(p, True)


def event(job_id: Column, kind: str, message: str, at: Column, details: Column | None = None) -> list[Column]:
    return [F.uuid().alias("event_id"), job_id.alias("job_id"), F.lit(kind).alias("kind"), F.lit(message).alias("message"), (F.lit(None).cast("string") if details is None else details).alias("details"), at.alias("created_at")]


def enqueue(jobs: DataFrame, events: DataFrame, requests: DataFrame, at: Column, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(jobs, events) with the requests (job_id, project_id, kind, mode, min_severity, model_ids) queued and noted (JOB-1)."""
    fresh = {"status": F.lit("queued"), "progress": F.lit(0), "message": F.lit("queued"), "queued_at": at, "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "cancelled": F.lit(False)}
    rows = requests.select(*[fresh[f.name].cast(f.dataType).alias(f.name) if f.name in fresh else F.col(f.name) if f.name in requests.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema])
    return jobs.unionByName(rows), events.unionByName(requests.select(*event(F.col("job_id"), "queued", "analysis queued", at)))


def progressed(jobs: DataFrame, job_id: str, progress: int, message: str, at: Column) -> DataFrame:
    """A job's progress and heartbeat (JOB-6)."""
    return Q.patched(jobs, F.col("job_id") == job_id, {"progress": F.lit(progress), "message": F.lit(message), "heartbeat_at": at})


def ended(jobs: DataFrame, when: Column, status: str, at: Column, code: Column | None = None, message: Column | None = None, summary: Column | None = None) -> DataFrame:
    """Jobs marked succeeded, failed or cancelled where the condition holds; the worker lets go of them (JOB-8)."""
    require(status in ("succeeded", "failed", "cancelled"), "conflict", "no end of a job", status=status)
    values = {"status": F.lit(status), "completed_at": at, "worker": F.lit(None).cast("string"), "message": F.lit(f"analysis {status}")}
    if status == "succeeded":
        values |= {"progress": F.lit(100), "heartbeat_at": at}
    if summary is not None:
        values["summary"] = summary
    if status == "failed":
        values |= {"error_code": F.substring(code if code is not None else F.lit("internal_error"), 1, 120), "error_message": F.substring(message if message is not None else F.lit(""), 1, 4000)}
    return Q.patched(jobs, when, values)


def selected(jobs: DataFrame, project_id: str | None = None, status: str | None = None) -> DataFrame:
    """Jobs of a project and status, the latest first (JOB-5)."""
    return Q.filtered(jobs, {"project_id": project_id, "status": status}).orderBy(F.col("queued_at").desc(), "job_id")


def usable_models(models: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The enabled models, or those asked for; one that is missing or disabled is an error (FLT-16, JOIN-4)."""
    enabled = models.where("enabled")
    if wanted:
        asked = models.sparkSession.createDataFrame([(m,) for m in wanted], "model_id string")
        lost = [r[0] for r in asked.join(enabled.select("model_id"), "model_id", "left_anti").collect()]
        require(not lost, "ml_error", "models are missing or disabled", models=sorted(lost))
        enabled = enabled.join(F.broadcast(asked), "model_id", "left_semi")
    require(not enabled.isEmpty(), "ml_error", "there is no enabled model")
    return enabled


def orchestrate(kind: str, analysed: Callable[[], DataFrame], by_rule: Callable[[DataFrame], DataFrame], by_model: Callable[[DataFrame], DataFrame], step: Callable[[int, str], None] = lambda *_: None) -> dict[str, DataFrame | None]:
    """Features, findings and predictions of a job of kind rule, ml or hybrid (JOB-7); step is told the progress and may raise Cancelled."""
    require(kind in KINDS, "configuration_error", "unknown kind of analysis", kind=kind)
    step(5, "opening the source")
    features = analysed()
    step(70, "measured")
    findings = by_rule(features) if kind in ("rule", "hybrid") else None
    step(78, "rules done")
    predictions = by_model(features) if kind in ("ml", "hybrid") else None
    step(95, "models done")
    return {"features": features, "findings": findings, "predictions": predictions}


def work_once(store: Store, worker: str, run: Callable[[dict, Callable[[int, str], None]], str], now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> str | None:
    """Claims the oldest job, runs it and marks its end (JOB-6); its status, or None where no job is open.

    run gets the job and a function for progress, which also raises Cancelled once the job is asked to stop, and returns a
    summary. An error marks the job failed with its code.
    """
    at = lambda: F.lit(now()).cast("timestamp")
    jobs = store.read("jobs", JOBS)
    claimed = Q.claim(jobs, worker, at())
    mine = claimed.where((F.col("worker") == worker) & (F.col("status") == "running")).orderBy("queued_at", "job_id").limit(1).collect()
    if not mine:
        return None
    store.write("jobs", claimed)
    job = mine[0].asDict()
    own = F.col("job_id") == job["job_id"]

    def noted(kind: str, message: str, details: str | None = None) -> None:
        row = store.spark.range(1).select(*event(F.lit(job["job_id"]), kind, message, at(), F.lit(details).cast("string")))
        store.write("events", store.read("events", EVENTS).unionByName(row))

    def step(progress: int, message: str) -> None:
        if store.read("jobs", JOBS).where(own & F.col("cancelled")).count():
            raise Cancelled
        store.write("jobs", progressed(store.read("jobs", JOBS), job["job_id"], progress, message, at()))
        noted("progress", message, str(progress))

    try:
        summary = run(job, step)
        status, more = "succeeded", {"summary": F.lit(summary)}
    except Cancelled:
        status, more = "cancelled", {}
    except Exception as e:
        status, more = "failed", {"code": F.lit(e.code if isinstance(e, QuarryError) else "internal_error"), "message": F.lit(str(e))}
    store.write("jobs", ended(store.read("jobs", JOBS), own, status, at(), **more))
    noted(status, f"analysis {status}")
    return status


def audited(audit: DataFrame, actor: str, action: str, subject: str, at: Column, details: str | None = None) -> DataFrame:
    """The audit table with an event appended (PLT-6)."""
    row = audit.sparkSession.range(1).select(F.uuid().alias("event_id"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(subject).alias("subject"), F.lit(details).cast("string").alias("details"), at.alias("created_at"))
    return audit.unionByName(row)


def audit_page(audit: DataFrame, action: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """Audit events, the latest first (PLT-6)."""
    return Q.page(Q.filtered(audit, {"action": action}), [F.col("created_at").desc(), "event_id"], limit, offset)
