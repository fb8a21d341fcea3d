"""Review bundles, agreement of reviewers, label and training tables (DST-1..6, DQ-2..4, AGG-12..16, SET-3, PRJ-13, ML-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import require
from quarry.functions import text as T
from quarry.operators import dataset as D
from quarry.operators import rules as R
from quarry.settings import Sampling

#: Columns of the tables, in their order.
REVIEW_COLUMNS = (
    "task_id", "project_name", "project_fingerprint", "source_kind", "origin", "entity_id", "entity_type", "qualified_name", "relative_path", "start_line", "end_line", "source_sha256", "smell_type", "snippet_path",
    "human_label", "human_severity", "reviewer_id", "review_notes", "labelled_at",
)
EVIDENCE_COLUMNS = ("task_id", "candidate_source", "rule_fired", "rule_severity", "threshold_mode", "conditions_json", "rationale", "references_json")
LABEL_COLUMNS = (
    "task_id", "project_name", "project_fingerprint", "source_kind", "origin", "source_sha256", "entity_id", "entity_type", "qualified_name", "relative_path", "start_line", "end_line", "smell_type",
    "label", "severity", "reviewer_id", "review_notes", "labelled_at",
)
PREDICTION_COLUMNS = (
    "task_id", "project_name", "project_fingerprint", "entity_id", "entity_type", "qualified_name", "relative_path", "start_line", "smell_type", "label", "prediction", "probability", "split", "held_out_project", "model",
)
#: Smells by the type of entity they are found in.
SMELLS = {
    "class": ("god_class", "large_class", "data_class", "lazy_class", "refused_bequest", "brain_class", "shotgun_surgery", "divergent_change", "inappropriate_intimacy", "middle_man", "speculative_generality"),
    "method": ("long_method", "brain_method", "feature_envy", "long_parameter_list", "deep_nesting", "complex_method", "message_chain", "magic_number", "dead_code", "duplicate_code"),
}


def entity_type_of(smell: Column) -> Column:
    """The entity type of a smell, or null for an unknown one."""
    return F.when(smell.isin(*SMELLS["class"]), "class").when(smell.isin(*SMELLS["method"]), "method")


def bundle(entities: DataFrame, findings: DataFrame, files: DataFrame, project: dict[str, str], rules: tuple[R.Rule, ...], sampling: Sampling = Sampling(), mode: str = "absolute") -> DataFrame:
    """Tasks with their evidence: one row for each finding, and controls without one drawn for each rule (DST-1..3).

    entities: entity_id, entity_type, qualified_name, path, start_line, end_line. findings: entity_id, smell, severity,
    evidence. files: path, sha256, text. project: name, fingerprint, kind, origin.
    """
    active = [r for r in rules if mode == "absolute" or r.relative()]
    spark = entities.sparkSession
    table = spark.createDataFrame([(r.smell, r.entity_type) for r in active], "smell string, entity_type string")
    candidates = entities.join(F.broadcast(table), "entity_type")
    found = findings.select("entity_id", "smell", "severity", F.to_json("evidence").alias("conditions")).join(candidates, ["entity_id", "smell"])
    drawn = D.controls(candidates, found.select("entity_id", "smell"), "entity_id", ["smell"], sampling.ratio, sampling.minimum, f"{sampling.seed}:{project['fingerprint']}")
    # a rule without any finding still gets its controls
    none = table.join(found.select("smell").distinct(), "smell", "left_anti")
    quiet = D.drawn(candidates.join(none.select("smell"), "smell", "left_semi"), none.select("smell", F.lit(sampling.minimum).alias("w")), "entity_id", ["smell"], f"{sampling.seed}:{project['fingerprint']}")
    rows = D.bundle(found, drawn.unionByName(quiet)).join(files.select("path", F.col("sha256").alias("source_sha256"), "text"), "path")
    task = D.stable_id(F.lit(project["fingerprint"]), F.col("entity_id"), F.col("smell"))
    slice_ = T.truncated(T.line_slice(F.col("text"), F.col("start_line"), F.col("end_line")), sampling.snippet_lines)
    rows = rows.withColumn("task_id", task).withColumn("snippet", slice_)
    rows = rows.withColumn("snippet_path", F.concat(F.lit("snippets/"), D.stable_id(F.col("snippet")), F.lit(".txt")))
    fixed = {"project_name": project["name"], "project_fingerprint": project["fingerprint"], "source_kind": project.get("kind", ""), "origin": project.get("origin", ""), "threshold_mode": mode}
    rows = rows.withColumns({k: F.lit(v) for k, v in fixed.items()} | {c: F.lit("") for c in ("human_label", "human_severity", "reviewer_id", "review_notes", "labelled_at", "references_json")})
    fired = F.col("source") == "rule"
    return rows.withColumns({
        "smell_type": F.col("smell"), "relative_path": F.col("path"), "candidate_source": F.col("source"), "rule_fired": fired, "rule_severity": F.coalesce("severity", F.lit("none")),
        "conditions_json": F.coalesce("conditions", F.lit("[]")), "rationale": F.when(fired, F.concat(F.col("smell"), F.lit(" by rule"))).otherwise("control without a finding"),
    }).select(*REVIEW_COLUMNS, *[c for c in EVIDENCE_COLUMNS if c != "task_id"], "snippet")


def in_order(tasks: DataFrame) -> DataFrame:
    """Tasks by project, smell, path, line and id (SRT-5)."""
    return tasks.orderBy("project_name", "smell_type", "relative_path", F.col("start_line").cast("int"), "task_id")


def sheets(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review sheet, evidence): what a reviewer may see, and what they may not (DST-4)."""
    return tasks.select(*REVIEW_COLUMNS), tasks.select(*EVIDENCE_COLUMNS)


def snippets(tasks: DataFrame) -> DataFrame:
    """(snippet_path, snippet), each path once; one path with two texts is an error (SET-3)."""
    return merged(tasks, "snippet_path", "snippet")


def merged(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each key; keys with more than one value raise when the row is read (SET-3)."""
    one = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    checked = F.when(F.col(value).eqNullSafe(F.col("_other")), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("two values for one key: "), F.col(key).cast("string"))).cast("string"))
    return one.select(key, checked.alias(value))


def counters(tasks: DataFrame, *by: str) -> DataFrame:
    """Per group: tasks, those of rules, those drawn as controls (AGG-12)."""
    return tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("candidate_source") == "rule").alias("rule_candidates"), F.count_if(F.col("candidate_source") == "control").alias("sampled_controls"))


def guide(rules: tuple[R.Rule, ...]) -> str:
    """Instructions for reviewers, and what each rule looks for (DST-6)."""
    steps = (
        "Read a task's snippet and its place in the file; do not look at candidate_evidence.csv before you are done.",
        "Write present, absent or uncertain into human_label.",
        "Where it is present, write low, medium, high or critical into human_severity; else leave it empty or write none.",
        "Write your own id into reviewer_id, and the time as RFC 3339 into labelled_at.",
        "Say in review_notes what made a decision hard.",
    )
    lines = ["# How to label", "", *[f"{i}. {s}" for i, s in enumerate(steps, 1)], "", "Candidates come from rules and from a draw of entities without findings; neither is a verdict.", ""]
    for r in sorted(rules, key=lambda r: r.smell):
        joined = (" and " if r.combinator == "all" else " or ").join(f"{c.metric} {c.op} {c.absolute:g}" for c in r.conditions)
        lines += [f"## {r.smell} ({r.entity_type})", "", f"Candidates have {joined}.", ""]
    return "\n".join(lines)


def validated(rows: DataFrame, order: str, required: tuple[str, ...], what: str) -> None:
    """A complete review sheet, or an error (DQ-2)."""
    issues = D.validate_review(rows, order, required, complete=True)
    n = issues.count()
    require(n == 0, "dataset_error", f"{what} is not complete and valid", issues=n)


def agreement(first: DataFrame, second: DataFrame, key: str = "task_id") -> DataFrame:
    """One row on two sheets (key, label, severity): agreement of labels, kappa of the binary ones, agreement of severities (AGG-14).

    Rows that either reviewer marks uncertain count for agreement and not for kappa. Severities are compared where both
    say present. The sheets meet in one join, and only counts of label pairs leave it.
    """
    side = lambda d, n: d.select(key, F.lower(F.trim("label")).alias(f"l{n}"), F.coalesce(F.nullif(F.lower(F.trim("severity")), F.lit("")), F.lit("none")).alias(f"s{n}"), F.lit(True).alias(f"in{n}"))
    joint = side(first, 1).join(side(second, 2), key, "full_outer").groupBy("l1", "l2", "in1", "in2").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s1") == F.col("s2")).alias("same"))
    both, pair = F.col("in1") & F.col("in2"), F.col("l1").isin("present", "absent") & F.col("l2").isin("present", "absent")
    total = lambda c, v="n": F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    says = lambda n, v: total(both & pair & (F.col(f"l{n}") == v)).alias(f"{v}{n}")
    present = both & (F.col("l1") == "present") & (F.col("l2") == "present")
    c = joint.agg(total(both).alias("common"), total(both & (F.col("l1") == F.col("l2"))).alias("equal"), total(F.col("in2").isNull()).alias("only_first"), total(F.col("in1").isNull()).alias("only_second"), total(both & pair).alias("binary"), total(both & pair & (F.col("l1") == F.col("l2"))).alias("binary_equal"), says(1, "present"), says(2, "present"), says(1, "absent"), says(2, "absent"), total(present).alias("present_both"), total(present, "same").alias("severity_equal"))
    part = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    n = F.col("binary").cast("double")
    po, pe = part(F.col("binary_equal"), n), part(F.col("present1").cast("double") * F.col("present2") + F.col("absent1").cast("double") * F.col("absent2"), n * n)
    kappa = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.when(pe != 1, 1 - pe))
    return c.select("common", "only_first", "only_second", (F.col("common") - F.col("equal")).alias("conflicts"), part(F.col("equal"), F.col("common")).alias("label_agreement"), "binary", kappa.alias("kappa"), "present_both", part(F.col("severity_equal"), F.col("present_both")).alias("severity_agreement"))


def compare_reviews(first: DataFrame, second: DataFrame, order: str, required: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """agreement() of two sheets, both valid and complete and with a task in common (DQ-2)."""
    validated(first, order, required, "the first sheet")
    validated(second, order, required, "the second sheet")
    out = agreement(first, second)
    require(out.first()["common"], "dataset_error", "the sheets have no task in common")
    return out


def final_labels(rows: DataFrame) -> DataFrame:
    """Labels as 0 or 1 with their severity from a review sheet; uncertain rows go (DST-5)."""
    y = F.when(F.lower(F.trim("human_label")) == "present", 1).when(F.lower(F.trim("human_label")) == "absent", 0)
    out = rows.withColumn("label", y).where("label is not null")
    return out.withColumn("severity", F.when(F.col("label") == 1, F.lower(F.trim("human_severity"))).otherwise("none")).select(*LABEL_COLUMNS)


def label_totals(review: DataFrame, *by: str) -> DataFrame:
    """Per group: binary labels, uncertain ones, positives, negatives (AGG-15)."""
    is_ = lambda *v: F.count_if(F.lower(F.trim("human_label")).isin(*v))
    return review.groupBy(*by).agg(is_("present", "absent").alias("binary_labels"), is_("uncertain").alias("uncertain_excluded"), is_("present").alias("positive"), is_("absent").alias("negative"))


def join_states(labels: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """labels with state: ok, or the first check of the feature join that a row fails (DQ-3).

    labels: project_fingerprint, entity_id, entity_type, qualified_name, relative_path, smell_type, source_sha256.
    entities: project_fingerprint, entity_id, entity_type, qualified_name, relative_path, vector (whether it has features).
    sources: project_fingerprint, relative_path, sha256. A project analysed twice counts as duplicate.
    """
    key = ["project_fingerprint", "entity_id"]
    e = entities.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_{c}") for c in ("entity_type", "qualified_name", "relative_path", "vector")])
    projects = entities.select("project_fingerprint").distinct().withColumn("_known", F.lit(True))
    s = sources.groupBy("project_fingerprint", F.col("relative_path").alias("_relative_path")).agg(F.min("sha256").alias("_sha"))
    met = labels.join(projects, "project_fingerprint", "left").join(e, key, "left").join(s, ["project_fingerprint", "_relative_path"], "left")
    state = (
        F.when(F.col("_known").isNull(), "project missing")
        .when(F.col("_n") > 1, "project duplicate")
        .when(F.col("_n").isNull(), "entity missing")
        .when(~F.coalesce("_vector", F.lit(False)), "features missing")
        .when(entity_type_of(F.col("smell_type")).isNull(), "smell unknown")
        .when(entity_type_of(F.col("smell_type")) != F.col("_entity_type"), "smell of another type")
        .when(~F.col("_sha").eqNullSafe(F.col("source_sha256")), "source changed")
        .when((F.col("_relative_path") != F.col("relative_path")) | (F.col("_qualified_name") != F.col("qualified_name")) | (F.col("_entity_type") != F.col("entity_type")), "metadata changed")
        .otherwise("ok")
    )
    return met.withColumn("state", state).select(*labels.columns, "state")


def training_rows(labels: DataFrame, features: DataFrame, names: list[str], prefix: str = "feature__") -> DataFrame:
    """Labels joined with their features, wide, with the prefix; features of other entity types stay null (ML-1, PRJ-4)."""
    key = ["project_fingerprint", "entity_id"]
    return labels.join(features.select(*key, *[F.col(c).cast("double").alias(prefix + c) for c in names]), key)


def training_balance(rows: DataFrame) -> DataFrame:
    """Per smell: rows, projects, and rows of each class (AGG-16)."""
    return rows.groupBy("smell_type").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("project_fingerprint").alias("projects"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def training_issues(rows: DataFrame, features: list[str]) -> DataFrame:
    """(task_id, problem) of training rows (DQ-4): blank or repeated ids, unknown or unfitting smell and type, labels,
    projects, features that are no finite number or all missing, and smells whose rows have different features."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    value = lambda c: F.col(c).cast("double")
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in features]))
    wild = F.array_compact(F.array(*[F.when(F.isnan(value(c)) | (F.abs(value(c)) == float("inf")), F.concat(F.lit("not finite: "), F.lit(c))) for c in features]))
    known = F.coalesce(entity_type_of(F.col("smell_type")).isNotNull() & F.col("entity_type").isin("module", "class", "method", "function"), F.lit(False))
    checks = [
        F.when(blank("task_id"), "blank task_id"),
        F.when(~known, "smell or entity type unknown"),
        F.when(known & (entity_type_of(F.col("smell_type")) != F.col("entity_type")), "smell of another type"),
        F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label is not 0 or 1"),
        F.when(blank("project_fingerprint"), "project missing"),
        F.when(F.size("_filled") == 0, "no feature"),
    ]
    marked = rows.withColumn("_filled", filled)
    own = marked.select("task_id", F.explode(F.concat(F.array_compact(F.array(*checks)), wild)).alias("problem"))
    again = rows.where(~blank("task_id")).groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id", F.lit("repeated task_id").alias("problem"))
    sets = marked.where(F.size("_filled") > 0).groupBy("smell_type").agg(F.min(F.to_json("_filled")).alias("a"), F.max(F.to_json("_filled")).alias("b")).where("a <> b")
    mixed = sets.select(F.concat(F.lit("smell "), "smell_type").alias("task_id"), F.lit("rows have different features").alias("problem"))
    return own.unionByName(again).unionByName(mixed)


def report(issues: DataFrame, **counts: int) -> dict:
    """A validation as a plain dict: valid, counts, and issues by problem (PRJ-13)."""
    by = {r[0]: r["n"] for r in issues.groupBy(issues.columns[-1]).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"valid": not by, "issues": sum(by.values()), "by_problem": by, **counts}
