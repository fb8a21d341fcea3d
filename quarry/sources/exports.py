"""Written results: review bundles, label and training sheets, runs, reports, research tables, JSON (SNK-1..6, SNK-10..13, SNK-15..17, SRC-15)."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import uuid
import zipfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import require
from quarry.operators import bundles as B
from quarry.operators import dataset as D
from quarry.operators import learning as L
from quarry.operators import query as Q
from quarry.operators import rules as R
from quarry.settings import Sampling
from quarry.sources import tables as T

SECTIONS = ("findings", "metrics", "predictions", "explanations", "recommendations", "models")
FORMATS = ("json", "csv", "html")


def _text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small text as one file, on any file system that Spark knows."""
    fs, p = T._children(spark, path)
    require(overwrite or not fs.exists(p), "dataset_error", "the output exists already", path=path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def empty_folder(spark: SparkSession, path: str, overwrite: bool) -> None:
    """A folder to write to; one with contents is an error, or emptied where overwrite is set."""
    fs, p = T._children(spark, path)
    if fs.exists(p) and len(fs.listStatus(p)):
        require(overwrite, "dataset_error", "the output folder is not empty", path=path)
        fs.delete(p, True)
    fs.mkdirs(p)


def write_bundle(tasks: DataFrame, path: str, rules: tuple[R.Rule, ...], sampling: Sampling = Sampling(), overwrite: bool = False) -> dict:
    """A review bundle (SNK-1): the sheet, the hidden evidence, snippets, a guide and a manifest, which is returned.

    Sheets are folders of one CSV in task order. Snippets are rows of (snippet_path, snippet), as one file for each
    would be millions of small files.
    """
    spark = tasks.sparkSession
    empty_folder(spark, path, overwrite)
    tasks = tasks.cache()
    seen, hidden = B.sheets(B.in_order(tasks))
    T.write_sheet(seen, f"{path}/review_tasks", B.REVIEW_COLUMNS)
    T.write_sheet(hidden, f"{path}/candidate_evidence", B.EVIDENCE_COLUMNS)
    B.snippets(tasks).write.parquet(f"{path}/snippets")
    by = {r["smell_type"]: r["tasks"] for r in B.counters(tasks, "smell_type").orderBy("smell_type").collect()}
    total = B.counters(tasks).first()
    manifest = {
        "purpose": "blinded labelling by people", "ruleset_sha256": R.ruleset_hash(rules), "sampling": {"ratio": sampling.ratio, "minimum": sampling.minimum, "seed": sampling.seed, "snippet_lines": sampling.snippet_lines},
        "review_sheet_has_features": False, "review_sheet_has_verdicts": False, "tasks": total["tasks"], "rule_candidates": total["rule_candidates"], "sampled_controls": total["sampled_controls"], "tasks_by_smell": by,
        "sheet_digest": T.digest(tasks, list(B.REVIEW_COLUMNS)),
    }
    _text(spark, f"{path}/guide.md", B.guide(rules))
    _text(spark, f"{path}/manifest.json", T.plain_json(manifest))
    tasks.unpersist()
    return manifest


def write_labels(review: DataFrame, order: str, path: str, overwrite: bool = False) -> dict:
    """Final labels of a complete review sheet with a manifest of counts and digest (SNK-2)."""
    sheet = review.withColumnsRenamed({"human_label": "label", "human_severity": "severity", "reviewer_id": "reviewer"})
    B.validated(sheet, order, ("task_id", *D.REQUIRED[1:]) if set(D.REQUIRED) <= set(sheet.columns) else ("task_id",), "the review sheet")
    labels = B.final_labels(review)
    T.write_sheet(labels, path, B.LABEL_COLUMNS, overwrite)
    totals = B.label_totals(review).first().asDict()
    manifest = {**totals, "labels_digest": T.digest(labels, list(B.LABEL_COLUMNS)), "feature_policy": "features are measured again from the sources"}
    _text(review.sparkSession, f"{path}.manifest.json", T.plain_json(manifest))
    return manifest


def write_training(labels: DataFrame, features: DataFrame, names: list[str], path: str, overwrite: bool = False) -> dict:
    """Labels with their features as a sheet, and a manifest (SNK-3)."""
    rows = B.training_rows(labels, features, names)
    columns = rows.columns
    T.write_sheet(rows, path, tuple(columns), overwrite)
    by = {r["smell_type"]: r["n_rows"] for r in B.training_balance(rows).collect()}
    manifest = {"rows": sum(by.values()), "by_smell": dict(sorted(by.items())), "projects": rows.select("project_fingerprint").distinct().count(), "features": names, "training_digest": T.digest(rows, columns)}
    _text(labels.sparkSession, f"{path}.manifest.json", T.plain_json(manifest))
    return manifest


def write_splits(rows: DataFrame, path: str, config, smells: tuple[str, ...] | None = None, overwrite: bool = False) -> dict:
    """Which task is for training and which for testing, for each smell, and the projects of each side (SNK-4)."""
    from quarry.operators import evaluation as E

    spark, out, notes = rows.sparkSession, None, []
    for smell in smells or tuple(r[0] for r in rows.select("smell_type").distinct().orderBy("smell_type").collect()):
        mine = rows.where(F.col("smell_type") == smell)
        classes = L.classes_by_project(mine)
        if len(classes) < 2:
            notes.append({"status": "skipped", "smell_type": smell, "reason": "two projects at least are needed"})
            continue
        train, test = E.split_projects(list(classes), classes, config.test_size, config.seed, config.tries)
        part = mine.select("task_id", "smell_type", "project_fingerprint", F.when(F.col("project_fingerprint").isin(test), "test").otherwise("train").alias("split"))
        out = part if out is None else out.unionByName(part)
        notes.append({"status": "created", "smell_type": smell, "train_projects": train, "test_projects": test, "test_has_both_classes": set().union(*(classes[p] for p in test)) >= {0, 1}})
    if out is not None:
        T.write_sheet(out, path, ("task_id", "smell_type", "project_fingerprint", "split"), overwrite)
    _text(spark, f"{path}.json", T.plain_json({"splits": notes}))
    return {"splits": notes}


def write_run(run: L.Run, path: str, spark: SparkSession, mode: str, overwrite: bool = False) -> dict:
    """A training run: models with cards, predictions as a sheet, a report (SNK-5, SNK-6)."""
    empty_folder(spark, path, overwrite)
    for r in run.of("trained"):
        r["model_sha256"] = T.save_model(run.models[r["smell_type"], r["model"]], f"{path}/{r['smell_type']}/{r['model']}", {k: v for k, v in r.items() if k != "status"})
    if run.predictions is not None:
        write_predictions(run.predictions, f"{path}/predictions")
    report = {"mode": mode, "done": len(run.results) - len(run.of("skipped")), "skipped": len(run.of("skipped")), "results": run.results}
    if mode == "leave_one_project_out" and run.predictions is not None:
        report["aggregate"] = [r.asDict() for r in L.aggregate_folds(run.predictions).orderBy("smell_type", "model").collect()]
    _text(spark, f"{path}/report.json", T.plain_json(report))
    return report


def write_predictions(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Prediction rows as a sheet (SNK-15)."""
    T.write_sheet(rows, path, B.PREDICTION_COLUMNS, overwrite)


#: Rows that one JSON text may hold where no limit is given.
EMITTED = 100_000


def emit(rows: DataFrame, order: list, limit: int | None = None) -> str:
    """Rows as a JSON list, keys sorted (SNK-16): the first limit ones, or all of them, which must be EMITTED at most."""
    part = rows.orderBy(*order).limit(EMITTED + 1 if limit is None else limit).collect()
    require(limit is not None or len(part) <= EMITTED, "conflict", "too many rows for one text: give a limit, or write a sheet", most=EMITTED)
    return T.plain_json([r.asDict(True) for r in part])


def payload(job: dict, project: dict, sections: dict[str, DataFrame], max_rows: int) -> dict:
    """A report's contents: each section in its order and cut at max_rows, with a flag where rows were left out (LIM-2, PRJ-5)."""
    require(job.get("status") == "succeeded", "conflict", "only succeeded analyses have reports", status=job.get("status"))
    out: dict = {"project": project, "analysis": job, "truncation": {"max_rows_per_section": max_rows}}
    for name in SECTIONS:
        if name in sections:
            rows = sections[name].orderBy(*Q.in_order(sections[name], name)).limit(max_rows + 1).collect()
            out[name] = [r.asDict(True) for r in rows[:max_rows]]
            out["truncation"][f"{name}_truncated"] = len(rows) > max_rows
        else:
            out[name] = []
    return out


def _cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return "'" + value if value[:1] in ("=", "+", "-", "@") and value else value
    return str(value) if isinstance(value, (int, float, bool)) else T.plain_json(value)


def sheet_text(rows: list[dict]) -> str:
    names, out = sorted({k for r in rows for k in r}), io.StringIO(newline="")
    if rows:
        w = csv.writer(out)
        w.writerow(names)
        w.writerows([[_cell(r.get(n)) for n in names] for r in rows])
    return out.getvalue()


def slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text.strip()).strip("-._")[:80] or "analysis"


def generate(contents: dict, form: str, folder: str, title: str | None = None) -> dict:
    """A report file as json, csv (a zip with one sheet for each section and a manifest) or html; its path, size and digest (SNK-10..12)."""
    require(form in FORMATS, "configuration_error", "unknown format", format=form)
    Path(folder).mkdir(parents=True, exist_ok=True)
    base = f"{slug(str(contents['project'].get('name', '')))}-{str(contents['analysis'].get('job_id', ''))[:8]}-{form}"
    path = Path(folder) / (base + (".zip" if form == "csv" else f".{form}"))
    if form == "json":
        path.write_text(json.dumps(json.loads(T.plain_json(contents)), indent=2, sort_keys=True))
    elif form == "csv":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name in ("project", "analysis"):
                z.writestr(f"{name}.csv", sheet_text([contents[name]]))
            for name in SECTIONS:
                z.writestr(f"{name}.csv", sheet_text(contents[name]))
            z.writestr("manifest.json", T.plain_json({"generated_at": datetime.now(timezone.utc).isoformat(), "truncation": contents["truncation"]}))
    else:
        path.write_text(T.page_of({n: contents[n] for n in SECTIONS}, title or base))
    data = path.read_bytes()
    return {"path": str(path), "format": form, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def make_report(reports: DataFrame, job_id: str, form: str, folder: str, build) -> tuple[DataFrame, dict]:
    """The reports table with a new report, ready or failed (SNK-17); build() gives its contents."""
    from quarry.operators.jobs import REPORTS

    rid = uuid.uuid4().hex
    try:
        made = generate(build(), form, f"{folder}/{rid}")
        row = {"report_id": rid, "job_id": job_id, "format": form, "status": "ready", "path": made["path"], "sha256": made["sha256"], "error": None}
    except Exception as e:
        row = {"report_id": rid, "job_id": job_id, "format": form, "status": "failed", "path": None, "sha256": None, "error": str(e)[:1000]}
    row["created_at"] = datetime.now(timezone.utc).replace(tzinfo=None)
    return reports.unionByName(reports.sparkSession.createDataFrame([row], REPORTS)), row


def download(report: dict) -> bytes:
    """A ready report's bytes; changed ones are an error (SNK-17)."""
    require(report["status"] == "ready", "conflict", "the report is not ready", status=report["status"])
    data = Path(report["path"]).read_bytes()
    require(hashlib.sha256(data).hexdigest() == report["sha256"], "conflict", "the report has changed")
    return data


def holdout_table(report: DataFrame) -> DataFrame:
    """Rows of a holdout report's trained results (RES-1): smell_type, model, test_projects, support, measures."""
    r = report.select(F.explode("results").alias("r")).where("r.status = 'trained'")
    return r.select("r.smell_type", "r.model", F.array_join("r.test_projects", ";").alias("test_projects"), F.col("r.metrics.support").alias("support"), *[F.col(f"r.metrics.{m}").alias(m) for m in L.MEASURES])


def fold_table(report: DataFrame) -> DataFrame:
    """Rows of a leave-one-out report's evaluated folds (RES-1)."""
    r = report.select(F.explode("results").alias("r")).where("r.status = 'evaluated'")
    return r.select("r.smell_type", "r.model", "r.held_out_project", "r.test_rows", *[F.col(f"r.metrics.{m}").alias(m) for m in L.MEASURES])


def fold_summary(folds: DataFrame, by: tuple[str, ...] = ("smell_type", "model")) -> DataFrame:
    """Per smell and model: folds, and each measure's mean, deviation and half-width of its 95 % interval (RES-1, AGG-19)."""
    out = [F.count(F.lit(1)).alias("folds")]
    for m in L.MEASURES:
        sd = F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m))
        out += [F.avg(m).alias(f"macro_{m}"), sd.alias(f"std_{m}"), (1.96 * sd / F.sqrt(F.when(F.count(m) > 0, F.count(m)))).alias(f"ci95_{m}")]
    return folds.groupBy(*by).agg(*out)


def research_bundle(spark: SparkSession, holdout: str, logo: str, path: str, overwrite: bool = False) -> dict:
    """Tables, JSON and a page of the results of a holdout and a leave-one-out run (SNK-13); figures need a plotting package."""
    empty_folder(spark, path, overwrite)
    a, b = (T.read_json(spark, f"{p}/report.json") for p in (holdout, logo))
    tables = {"holdout_metrics": holdout_table(a), "logo_fold_metrics": fold_table(b)}
    tables["logo_metrics"] = fold_summary(tables["logo_fold_metrics"])
    rows = {}
    for name, t in tables.items():
        T.write_sheet(t.orderBy("smell_type", "model"), f"{path}/{name}", tuple(t.columns))
        rows[name] = [r.asDict() for r in t.orderBy("smell_type", "model").collect()]
    summary = {**rows, "cautions": ["Holdout and leave-one-out results are different things.", "Results of made-up rows are no findings."]}
    _text(spark, f"{path}/research_summary.json", T.plain_json(summary))
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    page = ["# Results", "", "Projects are whole in training or in testing; choices are made inside training projects.", "", line(["smell", "model", "f1", "mcc", "roc_auc", "pr_auc"]), "|-|-|-|-|-|-|"]
    page += [line([r["smell_type"], r["model"], *(r[m] for m in ("f1", "mcc", "roc_auc", "pr_auc"))]) for r in rows["holdout_metrics"]]
    page += ["", line(["smell", "model", "folds", "f1", "half-width"]), "|-|-|-|-|-|"]
    page += [line([r["smell_type"], r["model"], r["folds"], r["macro_f1"], r["ci95_f1"]]) for r in rows["logo_metrics"]]
    _text(spark, f"{path}/RESULTS.md", "\n".join(page) + "\n")
    return summary


def read_table(spark: SparkSession, where: str, name: str, **options: str) -> DataFrame:
    """A stored table: Parquet below a folder, or one of a database by its JDBC address (SRC-15)."""
    if where.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=where, dbtable=name, **options).load()
    return spark.read.parquet(f"{where.rstrip('/')}/{name}")
