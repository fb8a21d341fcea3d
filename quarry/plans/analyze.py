"""Whole analyses: source tree to entities, features and findings (MET-19, PRJ-3, PRJ-6, GRA-15, JOB-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import require
from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import rules as R
from quarry.session import ensure_checkpoint_dir
from quarry.settings import Registry
from quarry.sources import inventory as I
from quarry.sources import parse as P
from quarry.sources.intake import open_source

LINE = ("loc", "sloc", "comment_lines", "blank_lines", "comment_density")
HALSTEAD = tuple(f"halstead_{x}" for x in ("distinct_operators", "distinct_operands", "total_operators", "total_operands", "vocabulary", "length", "volume", "difficulty", "effort", "time", "bugs"))
COMMON = (*LINE, "has_docstring", *HALSTEAD, "maintainability_index")
CLASS = ("wmc", "number_of_methods", "number_of_public_methods", "number_of_fields", "dit", "noc", "cbo", "fan_in", "fan_out", "rfc", "lcom1", "lcom_hs", "average_method_complexity", "number_of_base_classes")
METHOD = (
    "cyclomatic_complexity", "cognitive_complexity", "max_nesting_depth", "nesting_depth", "parameter_count", "parameter_count_excluding_self", "local_variable_count", "return_count",
    "call_count", "distinct_call_count", "max_message_chain", "magic_number_count", "foreign_access_ratio", "accessed_field_count", "decorator_count",
)
#: Feature names of each entity type, sorted: 32 of a class, 33 of a method or function, 18 of a module.
SCHEMA = {"class": tuple(sorted((*COMMON, *CLASS))), "method": tuple(sorted((*COMMON, *METHOD))), "function": tuple(sorted((*COMMON, *METHOD))), "module": tuple(sorted(COMMON))}

ALL_FEATURES = tuple(sorted(set().union(*map(set, SCHEMA.values()))))

#: What languages without metrics get in compatible mode, where it is not 0; fields of a matched class and of a whole file.
MADE_FIELDS = (4, 2)
COMPATIBLE = {"cyclomatic_complexity": 2.0, "cognitive_complexity": 2.0, "nesting_depth": 1.0, "max_nesting_depth": 1.0, "wmc": 1.0}


def _foreign_ratio() -> Column:
    """Accesses that start at another object, of all that start at an object; names bound by imports do not count."""
    roots = F.filter("attribute_roots", lambda r: r.isin(*P.RECEIVERS) | ~F.array_contains(F.map_keys("imports"), r))
    own = F.size(F.filter(roots, lambda r: r.isin(*P.RECEIVERS)))
    return S.ratio((F.size(roots) - own).cast("double"), F.size(roots).cast("double"))


def local_features(entities: DataFrame) -> DataFrame:
    """Entities with every metric that needs the entity alone."""
    entities = entities.withColumn("_lines", T.line_counts(F.col("text")))
    m = T.line_metrics(F.col("_lines"))
    h = S.halstead(*[F.col(c) for c in ("n1", "n2", "total_operators", "total_operands")])
    calls = F.size("called_names").cast("double")
    out = entities.withColumns({k: v.cast("double") for k, v in m.items()}).withColumns(h)
    number = {"has_docstring": "has_docstring", "cyclomatic_complexity": "cyclomatic", "cognitive_complexity": "cognitive", "max_nesting_depth": "nesting", "nesting_depth": "nesting", "local_variable_count": "n_locals", "return_count": "n_returns", "max_message_chain": "max_chain", "magic_number_count": "magic_numbers"}
    out = out.withColumns({k: F.col(v).cast("double") for k, v in number.items() if k != "has_docstring"} | {"has_docstring": F.col("has_docstring").cast("int").cast("double")})
    return out.withColumns({
        "maintainability_index": S.maintainability(F.col("halstead_volume"), F.col("cyclomatic_complexity"), F.col("sloc")),
        "parameter_count": F.col("parameter_count").cast("double"),
        "parameter_count_excluding_self": F.greatest(F.col("parameter_count") - F.col("has_self").cast("int"), F.lit(0)).cast("double"),
        "call_count": calls,
        "distinct_call_count": F.size(F.array_distinct("called_names")).cast("double"),
        "accessed_field_count": F.size("accessed_fields").cast("double"),
        "decorator_count": F.size("decorators").cast("double"),
        "foreign_access_ratio": _foreign_ratio(),
        "number_of_fields": F.size("declared_fields").cast("double"),
        "number_of_base_classes": F.size("base_names").cast("double"),
    })


def class_features(entities: DataFrame) -> DataFrame:
    """(project, entity_id, the class metrics that need other entities); entities may hold redefinitions."""
    key = lambda c="entity_id": F.concat_ws("\n", "project", c)
    all_ = entities.withColumn("node", key())
    one = G.keep_wins(all_, "node", "seq")
    classes = one.where("entity_type = 'class'")
    nodes = classes.select("node")
    # methods hang on their class by qualified name; redefinitions count each, with the last body
    last = one.select("node", F.col("cyclomatic").alias("cc"), F.col("accessed_fields").alias("af"), F.col("called_names").alias("cn"))
    methods = all_.where("entity_type = 'method'").select("project", "parent", "node", "seq", "name").join(last, "node").join(classes.select("project", F.col("qualified_name").alias("parent"), F.col("node").alias("owner")), ["project", "parent"])
    methods = methods.withColumn("method", F.concat_ws("#", "node", F.col("seq").cast("string"))).select("owner", "method", "name", "cc", "af", "cn")
    as_owner = nodes.withColumnRenamed("node", "owner")
    totals = G.method_totals(as_owner, methods, "owner", "cc")
    public = methods.groupBy("owner").agg(F.count_if(~F.col("name").startswith("_")).alias("number_of_public_methods"))
    response = G.response(methods.select("owner", "method", F.explode_outer("cn").alias("called")), "owner", "method", "called")
    cohesion = G.lcom1(methods, "owner", "method", "af")
    declared = classes.select(F.col("node").alias("owner"), F.explode("declared_fields").alias("field"))
    star = G.lcom_hs(methods, declared, "owner", "method", "af", "field")
    edges = inheritance(entities).where("target is not null").select("child", F.col("target").alias("parent"))
    dit, noc = G.inheritance_depth(nodes, edges), G.children_counts(nodes, edges)
    coupled = G.coupling_by_name(nodes, classes.select(F.col("node").alias("src"), F.explode(F.transform("references", lambda r: F.concat_ws("\n", F.col("project"), r))).alias("name")), classes.select(F.col("node").alias("dst"), F.concat_ws("\n", "project", "name").alias("name")))
    out = classes.select("project", "entity_id", "node")
    for t in (dit, noc, coupled):
        out = out.join(t, "node", "left")
    for t in (totals, public, response, cohesion, star):
        out = out.join(t.withColumnRenamed("owner", "node"), "node", "left")
    names = [c for c in CLASS if c not in ("number_of_fields", "number_of_base_classes")]
    return out.select("project", "entity_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def features(entities: DataFrame) -> DataFrame:
    """Parsed entities, the last definition of each, with the metrics of their type; metrics of other types are null."""
    parsed = entities.where("parse_error is null")
    one = G.keep_wins(parsed.withColumn("_node", F.concat_ws("\n", "project", "entity_id")), "_node", "seq").drop("_node")
    wide = local_features(one).join(class_features(parsed), ["project", "entity_id"], "left")
    kinds = lambda m: [k for k, names in SCHEMA.items() if m in names]
    keep = ["project", "path", "entity_id", "entity_type", "name", "qualified_name", "parent", "start_line", "end_line", "base_names", "decorators"]
    return wide.select(*keep, *[F.when(F.col("entity_type").isin(*kinds(m)), F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in ALL_FEATURES])


def inheritance(entities: DataFrame) -> DataFrame:
    """Every base that a class names: (project, child, name, target), target null where no class of the project is meant (GRA-3)."""
    one = G.keep_wins(entities.where("parse_error is null").withColumn("node", F.concat_ws("\n", "project", "entity_id")), "node", "seq")
    classes = one.where("entity_type = 'class'")
    known = classes.select("project", F.col("node").alias("entity_id"), "name", "qualified_name", F.col("path").alias("module"))
    uses = classes.select("project", F.col("node").alias("child"), F.explode("base_names").alias("name"), F.col("path").alias("module"), "imports").withColumn("origin", F.try_element_at("imports", F.col("name"))).drop("imports")
    return G.resolve_classes(uses, known).select("project", "child", "name", "target")


def line_entities(files: DataFrame) -> DataFrame:
    """Entities of files (project, path, language, text) by line patterns, each file's module among them (PAR-11)."""
    at = F.replace(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("/"), F.lit("."))
    stem = F.regexp_replace(F.regexp_replace(T.base_name(F.col("path")), r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9_]", "")
    bare = F.when(stem == "", "MainComponent").otherwise(F.concat(F.upper(F.substring(stem, 1, 1)), F.substr(stem, F.lit(2))))
    keyed = files.withColumn("_k", F.struct("project", "path", "language"))
    found = P.parse_lines(keyed, "_k", F.col("text"), bare).select("_k.*", "entity_type", "name", "owner", "start_line", "end_line", "parameter_count")
    modules = files.select("project", "path", "language", F.lit("module").alias("entity_type"), T.base_name(F.col("path")).alias("name"), F.lit(None).cast("string").alias("owner"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.size(T.lines(F.col("text")))).alias("end_line"), F.lit(0).alias("parameter_count"))
    named = found.unionByName(modules).withColumn("module", at)
    parent = F.when(F.col("entity_type") == "class", F.col("module")).when(F.col("owner").isNotNull(), F.concat_ws(".", "module", "owner")).when(F.col("entity_type") == "method", F.col("module"))
    qualified = F.when(F.col("entity_type") == "module", F.col("module")).otherwise(F.concat_ws(".", parent, "name"))
    entity_id = F.when(F.col("entity_type") == "module", F.concat(F.lit("mod:"), F.col("path"))).otherwise(F.concat_ws(":", F.when(F.col("entity_type") == "class", "cls").otherwise("mth"), "path", "name", F.col("start_line").cast("string")))
    return named.withColumn("parent", parent).withColumn("qualified_name", qualified).withColumn("entity_id", entity_id).drop("module", "owner")


def line_features(entities: DataFrame, compatible: bool = False) -> DataFrame:
    """Features of line_entities: what the lines tell (length, parameters), and null for what no parser measured.

    compatible fills in the constants of COMPATIBLE, 0 elsewhere, and the number of fields that the pattern parser makes
    up; is_default tells rows whose values are of this kind (PRJ-6).
    """
    span = (F.col("end_line") - F.col("start_line") + 1).cast("double")
    known = {"loc": span, "parameter_count": F.col("parameter_count").cast("double"), "parameter_count_excluding_self": F.col("parameter_count").cast("double")}
    whole = (F.col("entity_type") == "class") & (F.col("start_line") == 1) & (F.max("start_line").over(_same_file()) == 1)
    made = {"sloc": F.greatest(F.lit(1.0), span - 1), "number_of_fields": F.when(whole, float(MADE_FIELDS[1])).otherwise(float(MADE_FIELDS[0])), **{k: F.lit(v) for k, v in COMPATIBLE.items()}}
    value = lambda m: known.get(m, made.get(m, F.lit(0.0)) if compatible else F.lit(None).cast("double"))
    kinds = lambda m: [k for k, names in SCHEMA.items() if m in names]
    keep = ["project", "path", "language", "entity_id", "entity_type", "name", "qualified_name", "parent", "start_line", "end_line"]
    nothing = F.array().cast("array<string>")
    return entities.select(*keep, nothing.alias("base_names"), nothing.alias("decorators"), *[F.when(F.col("entity_type").isin(*kinds(m)), value(m)).alias(m) for m in ALL_FEATURES], F.lit(compatible).alias("is_default"))


def _same_file():
    from pyspark.sql import Window

    return Window.partitionBy("project", "path")


def summary(entities: DataFrame) -> DataFrame:
    """Entities of each type, all types named, parse failures, and bases that no class of the project answers to (GRA-15)."""
    spark = entities.sparkSession
    domain = spark.createDataFrame([(k,) for k in SCHEMA], "entity_type string")
    n = entities.where("parse_error is null").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    failed = entities.where("parse_error is not null").agg(F.lit("failed").alias("entity_type"), F.count(F.lit(1)).alias("n"))
    open_ = inheritance(entities).where("target is null").agg(F.lit("unresolved_bases").alias("entity_type"), F.countDistinct("child", "name").alias("n"))
    return domain.join(n, "entity_type", "left").select("entity_type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).union(failed).union(open_)


def files_of(files: DataFrame, language: str) -> DataFrame:
    """Files of one language (FLT-20)."""
    return files.where(F.col("language") == language)


def vectors_of(rows: DataFrame, entity_type: str) -> DataFrame:
    """Feature rows of one entity type, with the features that it has (FLT-20, PRJ-3); a missing one is an error."""
    names = SCHEMA[entity_type]
    require(not set(names) - set(rows.columns), "dataset_error", "features are missing", missing=sorted(set(names) - set(rows.columns)))
    others = [c for c in rows.columns if c in ALL_FEATURES and c not in names]
    return rows.where(F.col("entity_type") == entity_type).drop(*others)


#: Parser of each language; those that are not named here are read by line patterns (PAR-12).
PARSERS = Registry("parser")
PARSERS.add("python", lambda files, compatible: features(P.parse_python(files).checkpoint()).withColumn("language", F.lit("python")).withColumn("is_default", F.lit(False)))
PARSERS.add("*", lambda files, compatible: line_features(line_entities(files), compatible))


def wiring(rules: tuple[R.Rule, ...] | None = None) -> dict[str, int]:
    """How many parsers, rules and features there are (AGG-27)."""
    return {"parsers": len(PARSERS), "rules": len(rules or R.built_in()), **{f"{k}_features": len(v) for k, v in SCHEMA.items()}}


def features_of(files: DataFrame, compatible: bool = False) -> DataFrame:
    """Features of files (project, path, language, package, text), each by the parser of its language."""
    named = [n for n in PARSERS if n != "*"]
    parts = [PARSERS.get(n)(files_of(files, n), compatible) for n in named]
    parts.append(PARSERS.get("*")(files.where(~F.col("language").isin(*named)), compatible))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def analyze(spark: SparkSession, source: str, project: str | None = None, compatible: bool = False, work: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source files, rejections, features) of a folder, an archive, a file or a repository.

    Features are computed once and kept in the checkpoint folder: rules, bundles and models all start from them.
    """
    ensure_checkpoint_dir(spark)
    opened = open_source(spark, source, work)
    files, rejected = I.inventory(opened.files)
    rows = files.withColumn("project", F.lit(project or opened.name))
    return files, opened.rejected.unionByName(rejected), features_of(rows, compatible).checkpoint()


def detect(spark: SparkSession, source: str, mode: str = "absolute", floor: str = "low", compatible: bool = False, rules: tuple[R.Rule, ...] | None = None) -> DataFrame:
    """Findings of a source, most severe first."""
    from quarry.operators.query import findings_order

    found = R.detect(analyze(spark, source, compatible=compatible)[2], rules, mode=mode, project="project")
    return R.at_least(found, floor).orderBy(*findings_order())
