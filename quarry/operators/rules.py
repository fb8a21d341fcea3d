"""Declarative smell rules: parsing, thresholds, evaluation, summaries (RUL-1..11, AGG-5..11, FLT-11..14, SRC-12)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.errors import require
from quarry.functions import scores as S

MIN_SAMPLE = 20
#: Entity types of the smells that rule files may name; further names are taken as the file has them.
KNOWN_SMELLS = {
    **dict.fromkeys(("god_class", "large_class", "data_class", "lazy_class", "refused_bequest", "brain_class", "shotgun_surgery", "divergent_change", "inappropriate_intimacy", "middle_man", "speculative_generality"), "class"),
    **dict.fromkeys(("long_method", "brain_method", "feature_envy", "long_parameter_list", "deep_nesting", "complex_method", "message_chain", "magic_number", "dead_code", "duplicate_code"), "method"),
}


@dataclass(frozen=True)
class Condition:
    metric: str
    op: str
    absolute: float
    percentile: float | None = None

    def __post_init__(self) -> None:
        if self.op not in (">", ">=", "<", "<="):
            raise ValueError(f"unknown operator {self.op!r}")
        if self.percentile is not None and not 0 < self.percentile < 100:
            raise ValueError("a percentile is between 0 and 100")


@dataclass(frozen=True)
class Rule:
    smell: str
    entity_type: str
    conditions: tuple[Condition, ...]
    combinator: str = "all"
    bases: tuple[str, ...] = ()
    decorators: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    bands: dict[str, float] = field(default_factory=lambda: dict(S.BANDS))

    def __post_init__(self) -> None:
        if not self.conditions or self.combinator not in ("all", "any"):
            raise ValueError(f"rule {self.smell}: conditions and all or any are needed")

    def relative(self) -> bool:
        """Whether every condition has a percentile (RUL-5)."""
        return all(c.percentile is not None for c in self.conditions)


_MINIMAL = (("Exception", "BaseException", ".*Error", ".*Exception", "Enum", "StrEnum", "IntEnum", "IntFlag", "Flag", "Protocol", "ABC", "ABCMeta", "NamedTuple", "TypedDict"), (), (".*Error", ".*Exception", ".*Protocol", ".*Interface", "Meta", "Config"))
_DATA = (("Enum", "StrEnum", "IntEnum", "IntFlag", "Flag", "NamedTuple", "TypedDict", "BaseModel", "BaseSettings", "Protocol"), ("dataclass", "attrs", "attr\\.s", "define", "frozen"), ())
_NO_RECEIVER = ((), ("staticmethod", "classmethod", "property", "cached_property"), ())

#: The thirteen rules as smell, entity type, combinator, exemption sets, (metric, operator, absolute, percentile).
BUILT_IN = (
    ("god_class", "class", "all", (_DATA,), (("wmc", ">=", 47, 90), ("lcom_hs", ">", 0.725, 75), ("cbo", ">", 5, 75))),
    ("large_class", "class", "all", (), (("loc", ">", 200, 90), ("number_of_methods", ">", 20, 90))),
    ("data_class", "class", "all", (_DATA,), (("number_of_fields", ">=", 3, 60), ("wmc", "<", 12, 30), ("number_of_public_methods", "<=", 2, None))),
    ("lazy_class", "class", "all", (_MINIMAL, _DATA), (("wmc", "<=", 3, None), ("loc", "<", 25, None), ("number_of_methods", "<=", 2, None))),
    ("refused_bequest", "class", "all", (_MINIMAL, _DATA), (("dit", ">=", 2, None), ("number_of_methods", "<=", 2, None), ("wmc", "<=", 5, None))),
    ("long_method", "method", "all", (), (("loc", ">", 65, 90),)),
    ("brain_method", "method", "all", (), (("loc", ">", 32, 85), ("cyclomatic_complexity", ">=", 8, 85), ("nesting_depth", ">=", 3, 80), ("local_variable_count", ">", 8, 80))),
    ("complex_method", "method", "any", (), (("cyclomatic_complexity", ">", 10, 90), ("cognitive_complexity", ">", 15, 90))),
    ("long_parameter_list", "method", "all", (), (("parameter_count_excluding_self", ">", 5, 95),)),
    ("deep_nesting", "method", "all", (), (("nesting_depth", ">=", 5, 95),)),
    ("feature_envy", "method", "all", (_NO_RECEIVER,), (("foreign_access_ratio", ">", 0.667, 80), ("accessed_field_count", "<=", 2, None), ("call_count", ">=", 3, None))),
    ("message_chain", "method", "all", (), (("max_message_chain", ">=", 4, 95),)),
    ("magic_number", "method", "all", (), (("magic_number_count", ">=", 4, 90),)),
)


def _made(smell: str, kind: str, combinator: str, exempt, conditions) -> Rule:
    merged = [tuple(dict.fromkeys(p for e in exempt for p in e[i])) for i in range(3)]
    return Rule(smell, kind, tuple(Condition(m, o, float(a), p) for m, o, a, p in conditions), combinator, *merged)


def built_in() -> tuple[Rule, ...]:
    return tuple(_made(*r) for r in BUILT_IN)


def load_rules(text: str, metrics: dict[str, tuple[str, ...]] | None = None) -> tuple[Rule, ...]:
    """Rules from YAML text (RUL-10): version 1, exemption_sets, smells with entity_type, conditions, combinator, exempt_if, severity bands.

    Smells must be known and fit their entity type; with metrics (names by entity type) each condition's metric must be
    one of that type. Bands begin at positive excesses that grow with the severity.
    """
    doc = yaml.safe_load(text) or {}
    require(isinstance(doc, dict) and doc.get("version") == 1 and isinstance(doc.get("smells"), dict), "configuration_error", "version 1 and a mapping of smells are needed")
    keys, sets, out = ("base_class_matches", "decorated_with", "name_matches"), doc.get("exemption_sets") or {}, []
    for name, body in sets.items():
        require(isinstance(body, dict) and set(body) <= {*keys, "reason"}, "configuration_error", f"exemption set {name}: unknown keys", keys=sorted(set(body or {})))
    for smell, body in doc["smells"].items():
        wrong = lambda ok, what: require(ok, "configuration_error", f"{smell}: {what}")  # noqa: E731, B023
        wrong(isinstance(body, dict) and isinstance(body.get("conditions"), list) and body["conditions"], "conditions are missing")
        kind = body.get("entity_type")
        wrong(kind in ("module", "class", "method", "function"), "unknown entity type")
        wrong(smell not in KNOWN_SMELLS or KNOWN_SMELLS[smell] == kind, "the smell is one of another entity type")
        exempt = body.get("exempt_if") or {}
        wrong(not set(exempt.get("use", ())) - set(sets), "unknown exemption sets")
        parts = [tuple(tuple(e.get(k) or ()) for k in keys) for e in [*(sets[u] for u in exempt.get("use", ())), exempt]]
        for c in body["conditions"]:
            wrong(isinstance(c, dict) and {"metric", "op", "absolute"} <= set(c), "a condition has metric, op and absolute")
            wrong(isinstance(c["absolute"], (int, float)) and not isinstance(c["absolute"], bool), "a threshold is a number")
            wrong(metrics is None or c["metric"] in metrics.get(kind, ()), f"unknown metric {c['metric']}")
        bands = body.get("severity") or {}
        wrong(isinstance(bands, dict) and set(bands) <= set(S.BANDS), "unknown severity")
        bands = {**S.BANDS, **{k: float(v) for k, v in bands.items()}}
        starts = [bands[k] for k in S.BANDS]
        wrong(starts == sorted(starts) and starts[0] > 0, "bands begin at positive excesses that grow")
        made = _made(smell, kind, body.get("combinator", "all"), parts, [(c["metric"], c["op"], c["absolute"], c.get("percentile")) for c in body["conditions"]])
        out.append(replace(made, bands=bands))
    return tuple(out)


def ruleset_hash(rules: tuple[Rule, ...]) -> str:
    """SHA-256 of everything that decides what the rules find (RUL-11)."""
    plain = [[r.smell, r.entity_type, r.combinator, [[c.metric, c.op, c.absolute, c.percentile] for c in r.conditions], r.bases, r.decorators, r.names, sorted(r.bands.items())] for r in sorted(rules, key=lambda r: r.smell)]
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()


#: Cells that a group's values are cut into before one is ordered, a power of two.
CELLS = 256


def _cell(v: Column, edges: Column) -> Column:
    """How many of the sorted edges lie below v, by halving."""
    steps = F.array(*[F.lit(CELLS >> i) for i in range(CELLS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(edges, at + step - 1) < v, step).otherwise(0))


def percentiles(entities: DataFrame, wanted: list[tuple[str, float]], by: list[str], min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(by, metric, q, n, threshold) of every (metric, q): the exact, interpolated percentile, null below min_sample rows (AGG-5, AGG-6).

    Values become counts of distinct values; three passes over these select without ordering a group. A sketch finds
    edges that cut a group's distinct values into CELLS cells of like size; exact counts of the cells tell which ones
    hold the wanted places; only the values of those cells are ordered. Counts are exact, so the sketch's error changes
    how large cells are and no result.
    """
    metrics = sorted({m for m, _ in wanted})
    long = entities.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*by, "m.*").where("v is not null")
    keys = [*by, "metric"]
    counted = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    group = W.partitionBy(*keys)
    edges = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.array_sort(F.percentile_approx("v", [i / CELLS for i in range(CELLS + 1)], 10 * CELLS)).alias("edges"))
    cells = _met(counted, edges, keys).groupBy(*keys, "n", _cell(F.col("v"), F.col("edges")).alias("cell")).agg(F.sum("c").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
    ran = cells.withColumn("upto", F.sum("c").over(group.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)))
    qs = F.explode(F.filter(F.array(*[F.struct(F.lit(m).alias("of"), F.lit(float(q)).alias("q")) for m, q in sorted(set(wanted))]), lambda w: w["of"] == F.col("metric")))
    # the places floor(at) and ceil(at), counted from 0, fall in the cells and values whose counts span them
    spans = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)
    ran = ran.select("*", qs.alias("w")).withColumn("q", F.col("w.q")).withColumn("at", (F.col("q") / 100) * (F.col("n") - 1))
    chosen = ran.where(spans(F.floor("at")) | spans(F.ceil("at"))).groupBy(*keys, "q").agg(F.max("n").alias("n"), F.max("at").alias("at"), F.min("from").alias("from"), F.max("to").alias("to"), F.min(F.col("upto") - F.col("c")).alias("below"))
    near = _met(counted, chosen, keys).where(F.col("v").between(F.col("from"), F.col("to")))
    near = near.withColumn("upto", F.col("below") + F.sum("c").over(W.partitionBy(*keys, "q").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    low, high = (F.max(F.when(spans(f(F.col("at"))), F.col("v"))) for f in (F.floor, F.ceil))
    out = near.groupBy(*keys, "q").agg(F.max("n").alias("n"), F.max("at").alias("at"), low.alias("low"), high.alias("high"))
    part = F.col("at") - F.floor("at")
    return out.select(*keys, "q", "n", F.when(F.col("n") >= min_sample, F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))).alias("threshold"))


def _met(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with their groups; a null key is a group too."""
    renamed = groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    same = [rows[k].eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    return rows.join(renamed, same).drop(*[f"_g{i}" for i in range(len(keys))])


def thresholds(entities: DataFrame, metric: str, q: float, by: list[str], min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(by, n, threshold) of one metric; a group without values is left out."""
    return percentiles(entities, [(metric, q)], by, min_sample).select(*by, "n", "threshold")


def threshold_summary(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, metrics): how many metrics have a threshold in each group (AGG-25)."""
    return table.where("threshold is not null").groupBy(*by).agg(F.countDistinct("metric").alias("metrics"))


def _matches(value: Column, patterns: tuple[str, ...]) -> Column:
    return value.rlike("^(?:" + "|".join(patterns) + ")$") if patterns else F.lit(False)


def exemption(rule: Rule, columns: list[str]) -> Column:
    """Why an entity is exempt: base, decorator or name, whichever matches first; else null (FLT-12, RUL-8)."""
    first = lambda c, ps, what: F.concat(F.lit(f"{what} "), F.get(F.filter(F.col(c), lambda x: _matches(x, ps)), 0)) if ps and c in columns else F.lit(None).cast("string")
    name = F.when(_matches(F.col("name"), rule.names), F.concat(F.lit("name "), F.col("name"))) if rule.names and "name" in columns else F.lit(None).cast("string")
    return F.coalesce(first("base_names", rule.bases, "base"), first("decorators", rule.decorators, "decorator"), name)


EVIDENCE = "array<struct<metric:string,operator:string,observed:double,threshold:double,satisfied:boolean,threshold_source:string>>"


def _finding(rule: Rule, relative: dict[str, Column], columns: list[str], mode: str) -> Column:
    parts, excesses = [], []
    for c in rule.conditions:
        observed = F.coalesce(F.col(c.metric).cast("double"), F.lit(0.0))
        from_project = relative.get(f"{c.metric}@{c.percentile}", F.lit(None).cast("double")) if mode == "percentile" and c.percentile is not None else F.lit(None).cast("double")
        limit, op = F.coalesce(from_project, F.lit(c.absolute)), F.lit(c.op)
        source = F.when(from_project.isNotNull(), f"percentile {c.percentile:g}" if c.percentile else "").otherwise("absolute")
        met = S.compare(op, observed, limit)
        parts.append(F.struct(F.lit(c.metric).alias("metric"), op.alias("operator"), observed.alias("observed"), limit.alias("threshold"), met.alias("satisfied"), source.alias("threshold_source")))
        excesses.append(F.when(met, S.excess(op, observed, limit)))
    test = F.forall if rule.combinator == "all" else F.exists
    # evidence and the weakest excess are used several times: each is computed once, as the element of an array
    judged = F.struct(F.array(*parts).cast(EVIDENCE).alias("evidence"), F.coalesce(F.array_min(F.array_compact(F.array(*excesses))), F.lit(1.0)).alias("excess"))
    found = F.transform(F.array(judged), lambda j: F.when(test(j["evidence"], lambda e: e["satisfied"]), F.struct(F.lit(rule.smell).alias("smell"), S.severity(j["excess"], rule.bands).alias("severity"), j["excess"].alias("excess"), j["evidence"].alias("evidence"))))[0]
    return F.when((F.col("entity_type") == rule.entity_type) & exemption(rule, columns).isNull(), found)


def detect(entities: DataFrame, rules: tuple[Rule, ...] | None = None, mode: str = "absolute", project: str | None = None, partial: bool = False) -> DataFrame:
    """Findings of wide entities (entity_id, entity_type, metric columns, optional name, base_names, decorators).

    The rules become one projection: no shuffle in absolute mode. In percentile mode every (project, entity type)
    gives one row of thresholds, which is joined back by broadcast where the optimiser finds it small (RUL-6, RUL-7).
    Rules of which a condition has no percentile are left out in that mode. Without rules the built-in ones apply whose
    metrics the entities have; given rules whose metrics are not all columns are an error, or left out where partial is set.
    lacking() tells which these are.
    """
    own = rules is None
    rules = [r for r in rules or built_in() if mode == "absolute" or r.relative()]
    lost = {r.smell: [c.metric for c in r.conditions if c.metric not in entities.columns] for r in rules}
    require(partial or own or not any(lost.values()), "configuration_error", "rules need metrics that the entities lack", metrics={k: v for k, v in lost.items() if v})
    known = [r for r in rules if not lost[r.smell]]
    relative: dict[str, Column] = {}
    if mode == "percentile" and known:
        wanted = sorted({(c.metric, c.percentile) for r in known for c in r.conditions})
        by = [*([project] if project else []), "entity_type"]
        named = {f"{m}@{p}": f"_t{i}" for i, (m, p) in enumerate(wanted)}
        long = percentiles(entities, wanted, by)
        pick = lambda m, p: F.max(F.when((F.col("metric") == m) & (F.col("q") == float(p)), F.col("threshold")))
        table = long.groupBy(*by).agg(*[pick(m, p).alias(named[f"{m}@{p}"]) for m, p in wanted])
        entities, relative = entities.join(table, by, "left"), {k: F.col(v) for k, v in named.items()}
    found = F.array_compact(F.array(*[_finding(r, relative, entities.columns, mode) for r in known])) if known else F.array().cast(f"array<struct<smell:string,severity:string,excess:double,evidence:{EVIDENCE}>>")
    keep = [c for c in (project, "entity_id", "entity_type", "name", "qualified_name", "path", "start_line", "end_line") if c and c in entities.columns]
    return entities.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")


def lacking(entities: DataFrame, rules: tuple[Rule, ...] | None = None) -> dict[str, list[str]]:
    """Rules that detect() cannot apply, with the metrics that the entities lack."""
    lost = {r.smell: [c.metric for c in r.conditions if c.metric not in entities.columns] for r in rules or built_in()}
    return {k: v for k, v in lost.items() if v}


def detect_long(values: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (entity_id, smell, severity) of long values (entity_id, entity_type, metric, value), absolute mode.

    The same verdicts as detect() without exemptions, by a join with the rule table; kept as a cross-check.
    """
    spark = values.sparkSession
    table = spark.createDataFrame([(r.smell, r.entity_type, r.combinator, len(r.conditions), c.metric, c.op, c.absolute) for r in rules for c in r.conditions], "smell string, entity_type string, combinator string, n int, metric string, op string, threshold double")
    met = values.join(F.broadcast(table), ["entity_type", "metric"]).withColumn("ok", S.compare(F.col("op"), F.col("value"), F.col("threshold")))
    per = met.groupBy("entity_id", "smell", "combinator", "n").agg(F.count_if("ok").alias("k"), F.min(F.when(F.col("ok"), S.excess(F.col("op"), F.col("value"), F.col("threshold")))).alias("e"))
    fires = F.when(F.col("combinator") == "all", F.col("k") == F.col("n")).otherwise(F.col("k") > 0)
    return per.where(fires).select("entity_id", "smell", S.severity(F.coalesce("e", F.lit(1.0))).alias("severity"))


def at_least(findings: DataFrame, floor: str) -> DataFrame:
    return findings.where(S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(floor))


def by_smell(findings: DataFrame) -> DataFrame:
    return findings.groupBy("smell").agg(F.count(F.lit(1)).alias("n"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Every severity with its count, also those without findings (AGG-8)."""
    domain = findings.sparkSession.createDataFrame([(s, i) for i, s in enumerate(S.SEVERITIES)], "severity string, rank int")
    return F.broadcast(domain).join(findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def summary(entities: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: entities, findings, entities with findings, smells found (AGG-9)."""
    e = entities.agg(F.count(F.lit(1)).alias("n_entities"))
    f = findings.agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("entity_id").alias("n_flagged"), F.countDistinct("smell").alias("n_smells"))
    return e.join(f, F.lit(True))


def explain(finding_columns: tuple[str, ...] = ("smell", "name", "severity", "evidence")) -> Column:
    """A finding as a sentence: what, where, how severe, and the conditions that hold (RUL-9)."""
    smell, name, severity, evidence = map(F.col, finding_columns)
    held = F.filter(evidence, lambda e: e["satisfied"])
    return F.concat(F.initcap(F.replace(smell, F.lit("_"), F.lit(" "))), F.lit(" in "), name, F.lit(" ("), severity, F.lit("): "), describe(held))


def describe(evidence: Column) -> Column:
    """Evidence as text: metric observed operator threshold, joined by ; (RUL-9)."""
    return F.array_join(F.transform(evidence, lambda e: F.format_string("%s %s %s %s", e["metric"], e["observed"].cast("string"), e["operator"], e["threshold"].cast("string"))), "; ")
