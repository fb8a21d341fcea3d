"""Command line over the plans: python -m quarry.cli VERB ... (PLT-1..5). Every verb prints one JSON value."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.errors import QuarryError, require
from quarry.operators import bundles as B
from quarry.operators import dataset as D
from quarry.operators import learning as L
from quarry.operators import query as Q
from quarry.operators import rules as R
from quarry.plans import analyze as A
from quarry.session import local_session
from quarry.settings import Registry, Sampling, Settings, Training
from quarry.sources import exports as W
from quarry.sources import intake as N
from quarry.sources import inventory as I
from quarry.sources import tables as T

VERSION = "2.0"
VERBS = Registry("verb")
#: Names of a review sheet's columns as the sheet has them, and as the checks know them.
SHEET = {"human_label": "label", "human_severity": "severity", "reviewer_id": "reviewer"}


def verb(name: str, *arguments: tuple) -> Callable:
    """Registers a function (session, arguments) under a name; arguments are those of add_argument."""

    def keep(f: Callable) -> Callable:
        VERBS.add(name, (f, arguments))
        return f

    return keep


def arg(*names: str, **options) -> tuple:
    return names, options


SOURCE = arg("source", help="folder, zip archive, file or address")
OUT, OVER = arg("output"), arg("--overwrite", action="store_true")
MODE, FLOOR = arg("--mode", choices=("absolute", "percentile"), default="absolute"), arg("--floor", default="low")
RULES, COMPAT = arg("--rules", help="a YAML file of rules"), arg("--compatible", action="store_true", help="constants for what other languages do not measure")
MODELS = arg("--models", nargs="+", default=list(Training.models))


def _rules(a: argparse.Namespace) -> tuple[R.Rule, ...]:
    return R.load_rules(open(a.rules, encoding="utf-8").read(), A.SCHEMA) if getattr(a, "rules", None) else R.built_in()


def _json(rows, order: list, limit: int | None = None) -> list:
    import json

    return json.loads(W.emit(rows, order, limit))


@verb("version")
def version(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"version": VERSION, "wiring": A.wiring()}


@verb("config", arg("--environment", default="development"))
def config(spark: SparkSession, a: argparse.Namespace) -> dict:
    from dataclasses import asdict

    return asdict(Settings(environment=a.environment))


@verb("ingest", SOURCE, arg("--work"), arg("--largest", type=int, default=10))
def ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    opened = N.open_source(spark, a.source, a.work)
    files, rejected = I.inventory(opened.files)
    named = files.withColumn("project", F.lit(opened.name))
    totals = I.quality_warnings(I.totals(named, "project", "size_bytes", "line_count")).first()
    return {
        "name": opened.name, "kind": opened.kind, "origin": opened.origin, "warnings": [*opened.warnings, *filter(None, (totals["warnings"] if totals else "").split(","))],
        "files": totals["file_count"] if totals else 0, "languages": _json(I.census(named, "project", "language", "size_bytes").drop("project"), [F.desc("n_bytes"), "language"]),
        "fingerprint": I.fingerprint(named, "project", "path", "sha256").first()["fingerprint"] if totals else None,
        "largest": _json(Q.top(files.drop("text"), "line_count", a.largest, "path"), [F.desc("line_count"), "path"]), "rejected": _json(I.rejections_in_order(opened.rejected.unionByName(rejected), 200), ["reason", "path"]),
    }


@verb("analyze", SOURCE, arg("--metric", default="loc"), arg("--top", type=int, default=20), COMPAT)
def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    features = A.analyze(spark, a.source, compatible=a.compatible)[2]
    by = a.metric if a.metric in A.ALL_FEATURES else "loc"
    counts = _json(Q.counts(features, "entity_type"), ["entity_type"])
    return {"entities": counts, "metric": by, "top": _json(Q.top(features, by, a.top, "entity_id").select("entity_id", "entity_type", by), [F.desc(by), "entity_id"])}


@verb("detect", SOURCE, MODE, FLOOR, RULES, COMPAT, arg("--limit", type=int))
def detect(spark: SparkSession, a: argparse.Namespace) -> dict:
    from quarry.operators.query import findings_order

    found = A.detect(spark, a.source, a.mode, a.floor, a.compatible, _rules(a)).cache()
    return {"by_severity": _json(R.by_severity(found), ["rank"]), "by_smell": _json(R.by_smell(found), ["smell"]), "findings": _json(found, findings_order(), a.limit)}


@verb("dataset-create", SOURCE, OUT, MODE, RULES, OVER, arg("--ratio", type=float, default=1.0), arg("--minimum", type=int, default=10), arg("--seed", type=int, default=42))
def dataset_create(spark: SparkSession, a: argparse.Namespace) -> dict:
    files, _, features = A.analyze(spark, a.source)
    rules, sampling = _rules(a), Sampling(a.ratio, a.minimum, a.seed)
    mark = I.fingerprint(files.withColumn("project", F.lit("p")), "project", "path", "sha256").first()["fingerprint"]
    found = R.detect(features, rules, a.mode, "project")
    tasks = B.bundle(features, found, files, {"name": N.safe_name(a.source.rstrip("/").rsplit("/", 1)[-1]), "fingerprint": mark}, rules, sampling, a.mode)
    return W.write_bundle(tasks, a.output, rules, sampling, a.overwrite)


def _sheet(spark: SparkSession, path: str):
    return T.read_sheet(spark, path, B.REVIEW_COLUMNS)


@verb("dataset-validate", arg("sheet"), arg("--complete", action="store_true"))
def dataset_validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _sheet(spark, a.sheet).withColumnsRenamed(SHEET)
    return B.report(D.validate_review(rows, "task_id", ("task_id",), a.complete), rows=rows.count())


@verb("dataset-finalize", arg("sheet"), OUT, OVER)
def dataset_finalize(spark: SparkSession, a: argparse.Namespace) -> dict:
    return W.write_labels(_sheet(spark, a.sheet), "task_id", a.output, a.overwrite)


@verb("dataset-agreement", arg("first"), arg("second"), arg("--conflicts"))
def dataset_agreement(spark: SparkSession, a: argparse.Namespace) -> dict:
    one, two = (_sheet(spark, p).withColumnsRenamed(SHEET) for p in (a.first, a.second))
    if a.conflicts:
        rows = D.conflicts(one, two, "task_id", "label")
        T.write_sheet(rows, a.conflicts, tuple(rows.columns))
    return B.compare_reviews(one, two, "task_id").first().asDict()


@verb("ml-prepare", arg("labels"), SOURCE, OUT, OVER)
def ml_prepare(spark: SparkSession, a: argparse.Namespace) -> dict:
    labels = T.read_sheet(spark, a.labels, B.LABEL_COLUMNS)
    files, _, features = A.analyze(spark, a.source)
    mark = I.fingerprint(files.withColumn("project", F.lit("p")), "project", "path", "sha256").first()["fingerprint"]
    rows = features.withColumn("project_fingerprint", F.lit(mark)).withColumn("relative_path", F.col("path"))
    sources = files.select(F.lit(mark).alias("project_fingerprint"), F.col("path").alias("relative_path"), "sha256")
    states = B.join_states(labels, rows.withColumn("vector", F.lit(True)), sources)
    wrong = {r["state"]: r["n"] for r in Q.counts(states.where("state <> 'ok'"), "state").collect()}
    if wrong:
        raise QuarryError("ml_error", "labels and sources do not fit", states=wrong)
    return W.write_training(labels, rows, list(A.ALL_FEATURES), a.output, a.overwrite)


def _training(spark: SparkSession, path: str):
    rows = T.read_training(spark, path, ("task_id", "project_fingerprint", "smell_type", "entity_type", "label"), strict=True)
    rows = rows.select(*[F.col(c).alias(c if c in ("task_id", "project_fingerprint", "smell_type", "entity_type") else "label" if c == "label" else L.PREFIX + c) for c in rows.columns]).withColumn("label", F.col("label").cast("int"))
    issues = B.report(B.training_issues(rows, [c for c in rows.columns if c.startswith(L.PREFIX)]))
    if not issues["valid"]:
        raise QuarryError("ml_error", "the training table is not valid", **issues)
    return rows


@verb("ml-split", arg("training"), OUT, OVER, arg("--test-size", type=float, default=0.2), arg("--seed", type=int, default=42))
def ml_split(spark: SparkSession, a: argparse.Namespace) -> dict:
    return W.write_splits(_training(spark, a.training), a.output, Training(test_size=a.test_size, seed=a.seed), overwrite=a.overwrite)


@verb("ml-train", arg("training"), OUT, OVER, MODELS)
def ml_train(spark: SparkSession, a: argparse.Namespace) -> dict:
    return W.write_run(L.holdout(_training(spark, a.training), Training(models=tuple(a.models))), a.output, spark, "project_holdout", a.overwrite)


@verb("ml-logo", arg("training"), OUT, OVER, MODELS)
def ml_logo(spark: SparkSession, a: argparse.Namespace) -> dict:
    return W.write_run(L.leave_one_out(_training(spark, a.training), Training(models=tuple(a.models))), a.output, spark, "leave_one_project_out", a.overwrite)


@verb("ml-predict", arg("model"), SOURCE, arg("--sha"))
def ml_predict(spark: SparkSession, a: argparse.Namespace) -> list:
    card = T.read_card(a.model)
    model, card = T.load_model(a.model, card["features"], a.sha)
    return _json(L.registered_scores(A.analyze(spark, a.source)[2], [(model, card)]).drop("inputs"), [F.desc("probability"), "entity_id"])


@verb("report", SOURCE, OUT, arg("--format", choices=W.FORMATS, default="json"), MODE, FLOOR)
def report(spark: SparkSession, a: argparse.Namespace) -> dict:
    features = A.analyze(spark, a.source)[2]
    found = R.at_least(R.detect(features, mode=a.mode, project="project"), a.floor)
    job = {"job_id": "cli", "status": "succeeded", "mode": a.mode, "min_severity": a.floor}
    return W.generate(W.payload(job, {"name": N.safe_name(a.source.rstrip("/").rsplit("/", 1)[-1])}, {"findings": found, "metrics": features}, Settings().report_rows), a.format, a.output)


@verb("research", arg("holdout"), arg("logo"), OUT, OVER)
def research(spark: SparkSession, a: argparse.Namespace) -> dict:
    return W.research_bundle(spark, a.holdout, a.logo, a.output, a.overwrite)


@verb("model-register", arg("registry", help="a Parquet table of registered models"), arg("model", help="a model folder"))
def model_register(spark: SparkSession, a: argparse.Namespace) -> dict:
    card = T.read_card(a.model)
    T.load_model(a.model, card.get("features", []))
    row = {"model_sha256": card["model_sha256"], "path": a.model, "smell_type": card.get("smell_type", ""), "model": card.get("model", ""), "threshold": float(card.get("threshold", 0.5))}
    Q.replace_keys(spark.createDataFrame([tuple(row.values())], "model_sha256 string, path string, smell_type string, model string, threshold double"), a.registry, "model_sha256")
    return row


@verb("model-verify", arg("registry"))
def model_verify(spark: SparkSession, a: argparse.Namespace) -> dict:
    registry = spark.read.parquet(a.registry)
    changed = T.verified(registry)
    return {"models": registry.count(), "changed": changed, "valid": not changed}


@verb("model-delete", arg("registry"), arg("sha", help="the digest of a model's files"))
def model_delete(spark: SparkSession, a: argparse.Namespace) -> dict:
    require(Q.delete_keys(spark, a.registry, "model_sha256", [a.sha]), "not_found", "no such model", model_sha256=a.sha)
    return {"deleted": a.sha}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in VERBS:
        one = verbs.add_parser(name)
        for names, options in VERBS.get(name)[1]:
            one.add_argument(*names, **options)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a verb and prints its result, or an error with its code; 0 where all went well."""
    a = parser().parse_args(argv)
    try:
        print(T.plain_json(VERBS.get(a.verb)[0](spark or local_session(), a)))
        return 0
    except QuarryError as e:
        print(T.plain_json({"error": e.as_dict()}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
