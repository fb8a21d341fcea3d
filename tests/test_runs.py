"""Training runs, explanations, jobs, bundles and written results, end to end on small tables."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry import errors
from quarry.operators import bundles as B
from quarry.operators import dataset as D
from quarry.operators import explain as X
from quarry.operators import jobs as J
from quarry.operators import learning as L
from quarry.operators import query as Q
from quarry.operators import rules as R
from quarry.plans import analyze as A
from quarry.settings import Sampling, Training
from quarry.sources import exports as W
from quarry.sources import intake as N
from quarry.sources import inventory as I
from quarry.sources import tables as T


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for p in range(4):
        for r in range(6):
            y = (p + r) % 2
            out.append((f"t{p}{r}", f"p{p}", "long_method", "method", y, 8.0 + 25 * y + p, 1.0 + 7 * y + r / 10))
    out += [(f"u{r}", "p0", "god_class", "class", 1, 5.0, None) for r in range(12)]
    return spark.createDataFrame(out, "task_id string, project_fingerprint string, smell_type string, entity_type string, label int, feature__loc double, feature__cc double")


def test_holdout_and_research(spark, rows, tmp_path):
    config = Training(models=("logistic", "decision_tree"), test_size=0.25)
    run = L.holdout(rows, config, ("long_method", "god_class", "dead_code"))
    assert {(r["smell_type"], r["reason"]) for r in run.of("skipped")} == {("god_class", "fewer than 2 projects"), ("dead_code", "smell is absent from the dataset")}
    trained = {r["model"]: r for r in run.of("trained")}
    assert set(trained) == {"logistic", "decision_tree"} and all(r["metrics"]["f1"] == 1.0 and r["metrics"]["support"] == 6 for r in trained.values())
    assert trained["logistic"]["features"] == ["feature__loc", "feature__cc"] and not set(trained["logistic"]["training_projects"]) & set(trained["logistic"]["test_projects"])
    report = W.write_run(run, str(tmp_path / "holdout"), spark, "project_holdout")
    assert (report["done"], report["skipped"]) == (2, 2)
    with pytest.raises(errors.QuarryError):
        W.write_run(run, str(tmp_path / "holdout"), spark, "project_holdout")
    where = str(tmp_path / "holdout" / "long_method" / "logistic")
    card = T.read_card(where)
    model, _ = T.load_model(where, card["features"], card["model_sha256"])
    scored = L.registered_scores(spark.createDataFrame([("e1", "method", 40.0), ("e2", "method", 1.0), ("c", "class", 90.0)], "entity_id string, entity_type string, loc double"), [(model, card)])
    assert {r.entity_id: r.prediction for r in scored.collect()} == {"e1": 1, "e2": 0} and scored.where("abs(confidence + uncertainty - 1) > 1e-9").count() == 0
    weights = next(p for p in (tmp_path / "holdout" / "long_method" / "logistic" / "model" / "stages").glob("2_*/data/*") if p.name.startswith("part"))
    weights.write_bytes(weights.read_bytes() + b"x")
    with pytest.raises(errors.QuarryError):
        T.load_model(where, card["features"])
    registry = spark.createDataFrame([(card["model_sha256"], where)], "model_sha256 string, path string")
    assert T.verified(registry) == [card["model_sha256"]]
    assert T.drop_model(registry, card["model_sha256"]).count() == 0

    logo = L.leave_one_out(rows, Training(models=("decision_tree",)), ("long_method",))
    assert len(logo.of("evaluated")) == 4 and logo.predictions.count() == 24
    W.write_run(logo, str(tmp_path / "logo"), spark, "leave_one_project_out")
    (agg,) = L.aggregate_folds(logo.predictions).collect()
    assert (agg.folds, agg.micro_f1, agg.macro_f1, agg.std_f1) == (4, 1.0, 1.0, 0.0)
    summary = W.research_bundle(spark, str(tmp_path / "holdout"), str(tmp_path / "logo"), str(tmp_path / "research"))
    assert [r["folds"] for r in summary["logo_metrics"]] == [4] and (tmp_path / "research" / "RESULTS.md").exists()
    splits = W.write_splits(rows, str(tmp_path / "splits"), config)["splits"]
    assert {s["status"] for s in splits} == {"created", "skipped"}


def test_explanations(spark, rows):
    mine = rows.where("smell_type = 'long_method'")
    names = ["feature__loc", "feature__cc"]
    model = L.estimator("logistic", mine, names, Training())[0]
    out = X.explain(model, names, mine, 2).collect()
    scored = {r.task_id: r.p for r in L.scored(model, mine, 0.5).collect()}
    import math

    for r in out:
        assert r.method == "linear_contribution" and [t.rank for t in r.top_features] == [1, 2]
        assert 1 / (1 + math.exp(-r.output_value)) == pytest.approx(scored[r.task_id])
        assert r.base_value + sum(t.contribution for t in r.top_features) == pytest.approx(r.output_value)
    tree = L.estimator("decision_tree", mine, names, Training())[0]
    assert X.explain(tree, names, mine).first().method == "tree_shapley"
    assert X.explain(object(), names, mine).first().method == "value_deviation_fallback"
    with pytest.raises(errors.QuarryError):
        X.explain(model, ["nothing"], mine)
    advised = X.recommendations(X.explain(model, names, mine).withColumn("probability", F.lit(0.9))).first()
    assert (advised.title, advised.priority, len(advised.actions), advised.evidence[0].metric in ("loc", "cc")) == ("Cut the method into steps", "high", 3, True)
    assert len(L.demo_models(spark, R.built_in()[:2])) == 2 and L.demo_models(spark, R.built_in()[:1])[0][1]["synthetic"]


@pytest.mark.parametrize("p", [0.0, 1.0, 0.5, 1 / 3, 0.012345678901234, 0.00098765432109876, 1e-4, 0.00001234, 3e-17, 0.999999999999999])
def test_twelve_digits(spark, p):
    assert spark.range(1).select(L.significant(F.lit(p)).alias("x")).first().x == f"{p:.12g}"


def test_jobs(spark, tmp_path):
    store, at = J.Store(spark, str(tmp_path)), F.lit(datetime(2024, 1, 1)).cast("timestamp")
    wanted = spark.createDataFrame([("a", "p", "rule"), ("b", "p", "ml"), ("c", "p", "rule"), ("d", "p", "rule")], "job_id string, project_id string, kind string")
    jobs, events = J.enqueue(store.read("jobs", J.JOBS), store.read("events", J.EVENTS), wanted, at)
    store.write("jobs", Q.patched(jobs, F.col("job_id") == "d", {"cancelled": F.lit(True), "status": F.lit("cancelled")}))
    store.write("events", events)

    def run(job, step):
        step(50, "half")
        if job["job_id"] == "b":
            raise errors.QuarryError("ml_error", "no model")
        if job["job_id"] == "c":
            store.write("jobs", Q.cancel(store.read("jobs", J.JOBS), "c"))
            step(60, "never")
        return json.dumps({"done": job["job_id"]})

    assert [J.work_once(store, "w", run) for _ in range(4)] == ["succeeded", "failed", "cancelled", None]
    got = {r.job_id: r for r in store.read("jobs", J.JOBS).collect()}
    assert (got["a"].progress, got["a"].summary, got["b"].error_code, got["c"].status, got["d"].status) == (100, '{"done": "a"}', "ml_error", "cancelled", "cancelled")
    assert all(r.worker is None for r in got.values()) and store.read("events", J.EVENTS).where("job_id = 'a'").count() == 3
    features = spark.createDataFrame([("e", 1)], "entity_id string, x int")
    out = J.orchestrate("rule", lambda: features, lambda f: f, lambda f: f)
    assert out["findings"] is features and out["predictions"] is None
    with pytest.raises(errors.QuarryError):
        J.orchestrate("else", lambda: features, lambda f: f, lambda f: f)
    models = spark.createDataFrame([("m", True), ("n", False)], "model_id string, enabled boolean")
    assert J.usable_models(models, ["m"]).count() == 1
    with pytest.raises(errors.QuarryError):
        J.usable_models(models, ["m", "n"])
    audit = J.audited(spark.createDataFrame([], J.AUDIT), "ann", "login", "s", at)
    assert J.audit_page(audit, "login")[1] == 1


def test_guards(spark):
    users = spark.createDataFrame([(1, "admin", True), (2, "analyst", True)], "user_id int, role string, enabled boolean")
    with pytest.raises(errors.QuarryError):
        Q.update_users(users, 1, {"enabled": False})
    assert Q.update_users(users, 2, {"role": "admin"}).where("role = 'admin'").count() == 2
    projects, jobs = spark.createDataFrame([("a",), ("b",)], "project_id string"), spark.createDataFrame([("j", "a", "running")], "job_id string, project_id string, status string")
    tables = {"projects": projects, "jobs": jobs}
    with pytest.raises(errors.QuarryError):
        Q.guarded_delete(tables, "projects", projects.where("project_id = 'a'"), "project_id", {"jobs": "project_id"}, Q.active(jobs))
    assert Q.guarded_delete(tables, "projects", projects.where("project_id = 'a'"), "project_id", {"jobs": "project_id"})["jobs"].count() == 0
    with pytest.raises(errors.QuarryError):
        Q.found(projects, "project_id", "z")
    assert Q.reports_of(spark.createDataFrame([("j", "x")], "job_id string, path string"), jobs, "a").count() == 1


def test_bundle(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("class A:\n    x = 1\n    def f(self):\n        return 1\n" + "".join(f"class C{i}:\n    def g(self):\n        return {i}\n" for i in range(6)))
    files, _, features = A.analyze(spark, str(src))
    rules = tuple(r for r in R.built_in() if r.smell in ("lazy_class", "god_class"))
    found = R.detect(features, rules, project="project")
    tasks = B.bundle(features, found, files, {"name": "p", "fingerprint": "fp"}, rules, Sampling(ratio=0.5, minimum=3)).cache()
    n = {(r.smell_type, r.rule_fired) for r in tasks.collect()}
    assert n == {("lazy_class", True), ("god_class", False)} and tasks.where("smell_type = 'god_class'").count() == 3
    made = W.write_bundle(tasks, str(tmp_path / "out"), rules)
    assert made["tasks"] == tasks.count() == 7 + 3 and made["tasks_by_smell"] == {"god_class": 3, "lazy_class": 7}
    assert "# How to label" in (tmp_path / "out" / "guide.md").read_text()
    sheet = T.read_sheet(spark, str(tmp_path / "out" / "review_tasks"), B.REVIEW_COLUMNS)
    assert sheet.count() == 10 and "rule_fired" not in sheet.columns
    filled = sheet.withColumns({"human_label": F.when(F.col("smell_type") == "lazy_class", "present").otherwise("absent"), "human_severity": F.when(F.col("smell_type") == "lazy_class", "low"), "reviewer_id": F.lit("ann")})
    with pytest.raises(errors.QuarryError):
        W.write_labels(sheet.withColumn("human_label", F.lit("")), "task_id", str(tmp_path / "bad"))
    manifest = W.write_labels(filled, "task_id", str(tmp_path / "labels"))
    assert (manifest["positive"], manifest["negative"]) == (7, 3)
    labels = T.read_sheet(spark, str(tmp_path / "labels"), B.LABEL_COLUMNS)
    vectors = features.withColumnRenamed("project", "project_fingerprint").withColumn("project_fingerprint", F.lit("fp"))
    assert W.write_training(labels, vectors, ["loc", "wmc"], str(tmp_path / "training"))["by_smell"] == {"god_class": 3, "lazy_class": 7}
    with pytest.raises(errors.QuarryError):
        B.compare_reviews(sheet.withColumnsRenamed({"human_label": "label", "human_severity": "severity", "reviewer_id": "reviewer"}), filled.withColumnsRenamed({"human_label": "label", "human_severity": "severity", "reviewer_id": "reviewer"}), "task_id")
    assert B.report(D.validate_review(filled.withColumnsRenamed({"human_label": "label", "human_severity": "severity", "reviewer_id": "reviewer"}), "task_id", ("task_id",)))["valid"]
    with pytest.raises(Exception, match="two values"):
        B.merged(spark.createDataFrame([("a", "x"), ("a", "y")], "k string, v string"), "k", "v").collect()


def test_reports(spark, tmp_path, monkeypatch):
    findings = spark.createDataFrame([("b.py", 2, "s", "=1+1"), ("a.py", 1, "s", "x")], "path string, start_line int, smell string, rationale string")
    job, project = {"job_id": "j", "status": "succeeded"}, {"name": "my project"}
    contents = W.payload(job, project, {"findings": findings}, 1)
    assert contents["truncation"]["findings_truncated"] and contents["findings"][0]["path"] == "a.py"
    contents = W.payload(job, project, {"findings": findings}, 2)
    assert not contents["truncation"]["findings_truncated"]
    for form in W.FORMATS:
        made = W.generate(contents, form, str(tmp_path / form))
        assert made["size"] > 0 and len(made["sha256"]) == 64
    with zipfile.ZipFile(W.generate(contents, "csv", str(tmp_path / "z"))["path"]) as z:
        assert set(z.namelist()) >= {"findings.csv", "manifest.json"} and "'=1+1" in z.read("findings.csv").decode()
    reports, row = W.make_report(spark.createDataFrame([], J.REPORTS), "j", "json", str(tmp_path / "r"), lambda: contents)
    assert row["status"] == "ready" and json.loads(W.download(row))["findings"][0]["path"] == "a.py" and reports.count() == 1
    assert W.make_report(reports, "j", "pdf", str(tmp_path / "r"), lambda: contents)[1]["status"] == "failed"
    with pytest.raises(errors.QuarryError):
        W.download({**row, "sha256": "0"})
    with pytest.raises(errors.QuarryError):
        W.payload({"status": "running"}, project, {}, 1)
    assert json.loads(W.emit(findings, ["path"]))[0]["path"] == "a.py"
    monkeypatch.setattr(W, "EMITTED", 0)
    with pytest.raises(errors.QuarryError):
        W.emit(findings, ["path"])
    assert len(json.loads(W.emit(findings, ["path"], 1))) == 1
    findings.write.parquet(str(tmp_path / "db" / "findings"))
    assert W.read_table(spark, str(tmp_path / "db"), "findings").count() == 2


def test_rule_files(spark):
    text = "version: 1\nsmells:\n  big:\n    entity_type: class\n    severity: {critical: 9}\n    conditions: [{metric: wmc, op: '>=', absolute: 47}]\n"
    (rule,) = R.load_rules(text, A.SCHEMA)
    assert rule.bands["critical"] == 9.0 and R.ruleset_hash((rule,)) != R.ruleset_hash(R.load_rules(text.replace("9", "8")))
    for wrong in (("wmc", "unknown_metric"), ("class", "planet"), ("critical: 9", "critical: 1"), ("critical", "worst"), ("47", "'many'"), ("big", "deep_nesting")):
        with pytest.raises(ValueError):
            R.load_rules(text.replace(*wrong), A.SCHEMA)
    e = spark.createDataFrame([("a", "class", 50.0)], "entity_id string, entity_type string, wmc double")
    with pytest.raises(ValueError):
        R.detect(e, R.built_in())
    assert R.detect(e, R.built_in(), partial=True).count() == 0 and R.detect(e, (rule,)).count() == 1
    assert R.lacking(e)["god_class"] == ["lcom_hs", "cbo"] and not R.lacking(e, (rule,))


def test_small_functions(spark):
    one = spark.createDataFrame([("..my proj!/x", "a\nb\nc\nd")], "n string, t string")
    from quarry.functions import text as TX

    r = one.select(TX.safe_name(F.col("n")).alias("n"), TX.truncated(F.col("t"), 2).alias("t"), TX.line_slice(F.col("t"), F.lit(2), F.lit(3)).alias("s")).first()
    assert (r.n, r.t, r.s) == ("my-proj-x", "a\nb\n# ... truncated ...", "b\nc")
    a, b = D.blind(spark.createDataFrame([("t", "rule", 1.0)], "task_id string, source string, excess double"))
    assert (a.columns, b.columns) == (["task_id"], ["task_id", "source", "excess"])
    assert Q.filtered(one, contains={"n": "PROJ"}, ignore_case=True).count() == 1 and Q.filtered(one, contains={"n": "PROJ"}).count() == 0
    assert N.used_bytes(spark.createDataFrame([], "size long")) == 0
    odd = spark.createDataFrame([(1, "u", b"a")], "size int, path string, content binary")
    assert I.rejections_in_order(I.inventory(odd.select("path", F.col("size").cast("long").alias("size"), "content"))[1]).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from quarry import cli

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("".join(f"class A{i}:\n    def f(self):\n        return 1\n" for i in range(3)))

    def run(*argv):
        code = cli.main(list(argv), spark)
        said = capsys.readouterr()
        return code, json.loads(said.out or said.err)

    assert run("version")[1]["wiring"]["rules"] == 13
    code, got = run("ingest", str(src))
    assert code == 0 and got["files"] == 1 and got["languages"][0]["language"] == "python" and "few_files" in got["warnings"]
    assert run("analyze", str(src), "--metric", "wmc")[1]["top"][0]["wmc"] >= 1
    assert "lazy_class" in {f["smell"] for f in run("detect", str(src))[1]["findings"]}
    code, got = run("ingest", str(tmp_path / "none"))
    assert code == 2 and got["error"]["code"] == "unsupported_source"
    assert run("config", "--environment", "nowhere")[0] == 2
    assert run("dataset-create", str(src), str(tmp_path / "bundle"), "--minimum", "1")[1]["tasks"] > 0
    assert run("dataset-validate", str(tmp_path / "bundle" / "review_tasks"))[1]["valid"]
    assert run("dataset-finalize", str(tmp_path / "bundle" / "review_tasks"), str(tmp_path / "labels"))[0] == 2
    assert run("report", str(src), str(tmp_path / "rep"), "--format", "html")[1]["size"] > 0
