"""Operators bound to the testdata tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.operators import dataset as D
from quarry.operators import evaluation as E
from quarry.operators import graph as G
from quarry.operators import query as Q
from quarry.operators import rules as R
from quarry.session import table
from quarry.sources import inventory as I
from quarry.sources import parse as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


LINES = """
lines AS (SELECT doc_id, unnest(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END) AS x, text FROM documents),
met AS (SELECT doc_id, count(*) AS loc, count(*) FILTER (WHERE trim(x) = '') AS blank_lines, count(*) FILTER (WHERE trim(x) LIKE 'T%') AS comment_lines FROM lines GROUP BY doc_id),
sized AS (SELECT doc_id, loc, blank_lines, comment_lines, greatest(loc - blank_lines - comment_lines, 0) AS sloc, round(comment_lines / loc, 6) AS comment_density FROM met)
"""


@bound(f"WITH {LINES} SELECT sized.*, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS physical_lines FROM sized JOIN documents USING (doc_id)")
def text_line_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = T.line_metrics(F.col("counts"))
    m["comment_density"] = F.round(m["comment_density"], 6)
    counted = table(spark, d, "documents").select("doc_id", T.line_counts(F.col("text"), "T").alias("counts"), T.physical_lines(F.col("text")).alias("physical_lines"))
    return counted.select("doc_id", *[v.alias(k) for k, v in m.items()], "physical_lines")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    m = T.line_metrics(F.col("counts"))
    counted = table(spark, d, "documents").select("doc_id", "source", T.line_counts(F.col("text"), "T").alias("counts"))
    return counted.select(F.col("doc_id").alias("entity_id"), F.lit("class").alias("entity_type"), F.col("source").alias("project"), *[v.cast("double").alias(k) for k, v in m.items()])


LARGE = (R.Rule("large_file", "class", (R.Condition("loc", ">", 6.0, 90),)),)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Files ranked by size, those over the limit flagged with a severity."""
    flags = R.detect(_sized(spark, d), LARGE).select("entity_id", "severity")
    return _sized(spark, d).join(flags, "entity_id", "left").select(F.col("entity_id").alias("doc_id"), F.col("loc").cast("bigint").alias("loc"), F.coalesce("severity", F.lit("none")).alias("severity")).orderBy(F.desc("loc"), "doc_id").limit(100)


@bound(f"WITH {LINES} SELECT doc_id, loc, CASE WHEN loc <= 6 THEN 'none' WHEN loc / 6 >= 4 THEN 'critical' WHEN loc / 6 >= 2.5 THEN 'high' WHEN loc / 6 >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM sized ORDER BY loc DESC, doc_id LIMIT 100")
def largest_files_flagged(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@bound("SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def largest_files_topk(spark: SparkSession, d: str) -> DataFrame:
    return Q.top(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars")), "n_chars", 20, "doc_id")


PATHS = r"paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.min.py' WHEN 2 THEN '_pb2.py' WHEN 3 THEN '.JS' WHEN 4 THEN '/build/x.go' WHEN 5 THEN '/test/y.rs' ELSE '.pyc' END AS path, CAST(length(html) AS BIGINT) AS size FROM pages)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    end = F.expr("CASE page_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.min.py' WHEN 2 THEN '_pb2.py' WHEN 3 THEN '.JS' WHEN 4 THEN '/build/x.go' WHEN 5 THEN '/test/y.rs' ELSE '.pyc' END")
    return table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), end).alias("path"), F.length("html").cast("bigint").alias("size"))


_NAMED = rf"{PATHS}, n AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name, regexp_extract(path, '(?:^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in I.EXCLUDED_DIRS)}|\.[^/]+|[^/]+\.egg-info)/', 1) AS bad FROM paths)"


@bound(rf"""WITH {_NAMED}, r AS (SELECT *, CASE WHEN bad NOT IN ('', '.', '..') THEN 'excluded_path' WHEN regexp_matches(name, '(\.min\.py|\.py[cod]|\.so|\.dll|\.class|\.jar)$') THEN 'disallowed_suffix' WHEN regexp_matches(name, '_pb2\.py|_pb2_grpc\.py|_generated\.py|\.g\.py|_ui\.py') THEN 'generated'
 WHEN regexp_matches(name, '^test_|_test\.py$') OR regexp_matches(lower(path), '(^|/)tests?/') THEN 'test' WHEN size > 2000 THEN 'member_too_large' END AS why FROM n)
SELECT page_id, CASE WHEN why IN ('generated', 'test') THEN 'excluded_path' ELSE why END AS reason, CASE why WHEN 'excluded_path' THEN 'in ' || bad || '/' WHEN 'generated' THEN 'generated source' WHEN 'test' THEN 'test code' WHEN 'disallowed_suffix' THEN '' WHEN 'member_too_large' THEN size || ' > 2000' END AS detail FROM r""")
def file_screen_reasons(spark: SparkSession, d: str) -> DataFrame:
    no = I.screen(F.col("path"), F.col("size"), include_tests=False, max_bytes=2000)
    return _paths(spark, d).select("page_id", no["reason"].alias("reason"), no["detail"].alias("detail"))


_SUFFIXES = ", ".join(f"('{k}', '{v}')" for k, v in T.LANGUAGES.items())


@bound(rf"WITH {PATHS}, s AS (SELECT size, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\.[^.]+)$', 1)) AS x FROM paths) SELECT coalesce(l, 'other') AS language, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM s LEFT JOIN (VALUES {_SUFFIXES}) v(k, l) ON k = x GROUP BY 1")
def language_of_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).groupBy(T.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_bytes"))


@bound(f"WITH {PATHS} SELECT page_id, replace(regexp_replace(path, '([^/.])[.][^./]+$', '\\1'), '/', '.') AS package FROM paths")
def package_path(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", T.package_path(F.col("path")).alias("package"))


@bound("SELECT source, lang, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY 1, 2")
def language_census(spark: SparkSession, d: str) -> DataFrame:
    return I.census(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("bigint")), "source", "lang", "n_chars")


@bound("SELECT source, lang AS primary_language FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) AS n FROM documents GROUP BY 1, 2) WHERE n = 1")
def primary_language_by_source(spark: SparkSession, d: str) -> DataFrame:
    return I.primary_language(table(spark, d, "documents"), "source", "lang", "n_chars")


TOTALS = "t AS (SELECT source, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS total_lines FROM documents GROUP BY 1)"


@bound(f"WITH {TOTALS} SELECT *, CASE WHEN file_count < 60 AND total_lines < 300 THEN 'few_files,few_lines' WHEN file_count < 60 THEN 'few_files' WHEN total_lines < 300 THEN 'few_lines' ELSE '' END AS warnings FROM t")
def inventory_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.col("n_chars").cast("bigint").alias("b"), T.physical_lines(F.col("text")).alias("l"))
    return I.quality_warnings(I.totals(docs, "source", "b", "l"), 60, 300)


@bound("SELECT source, sha256(string_agg(p || chr(0) || s || chr(0), '' ORDER BY p)) AS fingerprint FROM (SELECT source, CAST(doc_id AS VARCHAR) AS p, sha256(text) AS s FROM documents) GROUP BY 1")
def project_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return I.fingerprint(table(spark, d, "documents").withColumn("sha", F.sha2("text", 256)), "source", "doc_id", "sha")


_FUNCTION = r"^\s*(?:public|private|protected|export|async|static|function|func|fn|def|void|int|float|double|char|boolean|bool|String|var|let|const)*\s*([A-Za-z0-9_]+)\s*\(([^)]*)\)"
_BROKEN = "string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))"


@bound(rf"""WITH l AS (SELECT page_id, unnest({_BROKEN}) AS x, generate_subscripts({_BROKEN}, 1) AS i FROM pages),
m AS (SELECT *, regexp_extract(x, '^\s*(?:public|private|protected|export|abstract|final|static)*\s*(?:class|interface|struct|type|enum)\s+([A-Za-z0-9_]+)', 1) AS c, regexp_extract(x, '{_FUNCTION}', 1) AS f, regexp_extract(x, '{_FUNCTION}', 2) AS a, max(i) OVER (PARTITION BY page_id) AS n FROM l),
o AS (SELECT *, last_value(CASE WHEN c <> '' THEN c END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS owner FROM m),
e AS (SELECT page_id, CASE WHEN c <> '' THEN 'class' ELSE 'method' END AS entity_type, CASE WHEN c <> '' THEN c ELSE f END AS name, CASE WHEN c = '' THEN owner END AS owner, i AS start_line, least(n, i + CASE WHEN c <> '' THEN 40 ELSE 15 END) AS end_line,
 CASE WHEN c <> '' THEN 0 ELSE len(list_filter(string_split(a, ','), lambda y: trim(y) <> '')) END AS parameter_count FROM o WHERE c <> '' OR (f <> '' AND f NOT IN ('if','for','while','switch','catch','return','class','interface','struct')))
SELECT page_id, entity_type, name, owner, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(parameter_count AS INT) AS parameter_count FROM e
UNION ALL SELECT page_id, t, CASE t WHEN 'class' THEN 'MainComponent' ELSE 'execute' END, CASE t WHEN 'method' THEN 'MainComponent' END, 1, CAST(max(n) AS INT), CASE t WHEN 'class' THEN 0 ELSE 1 END FROM m, (VALUES ('class'), ('method')) v(t) WHERE page_id NOT IN (SELECT page_id FROM e) GROUP BY 1, 2""")
def universal_entities(spark: SparkSession, d: str) -> DataFrame:
    found = P.parse_lines(table(spark, d, "pages"), "page_id", F.replace("html", F.lit("><"), F.lit(">\n<")))
    return found.select("page_id", "entity_type", "name", "owner", *[F.col(c).cast("int").alias(c) for c in ("start_line", "end_line", "parameter_count")])


@bound(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS o, regexp_extract_all(text, '[.,;:!?|]') AS p FROM documents),
c AS (SELECT doc_id, CAST(len(list_distinct(p)) AS DOUBLE) AS n1, CAST(len(list_distinct(o)) AS DOUBLE) AS n2, CAST(len(p) AS DOUBLE) AS t1, CAST(len(o) AS DOUBLE) AS t2 FROM w),
h AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2(n1 + n2) ELSE 0 END AS v, CASE WHEN n2 > 0 THEN n1 / 2 * (t2 / n2) ELSE 0 END AS d FROM c)
SELECT doc_id, round(v, 4) AS volume, round(d, 4) AS difficulty, round(v * d, 2) AS effort, round(v * d / 18, 2) AS "time", round(v / 3000, 6) AS bugs,
 round(greatest(0, least(100, (171 - 5.2 * ln(greatest(v, 1)) - 0.23 * t1 - 16.2 * ln(greatest(t2, 1))) * 100 / 171)), 6) AS maintainability FROM h""")
def halstead_from_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.expr("regexp_extract_all(text, '[A-Za-z]+', 0)").alias("o"), F.expr("regexp_extract_all(text, '[.,;:!?|]', 0)").alias("p"))
    c = w.select("doc_id", F.size(F.array_distinct("p")).alias("n1"), F.size(F.array_distinct("o")).alias("n2"), F.size("p").cast("double").alias("t1"), F.size("o").cast("double").alias("t2"))
    h = S.halstead(F.col("n1"), F.col("n2"), F.col("t1"), F.col("t2"))
    mi = S.maintainability(h["halstead_volume"], F.col("t1"), F.col("t2"))
    digits = {"volume": 4, "difficulty": 4, "effort": 2, "time": 2, "bugs": 6}
    return c.select("doc_id", *[F.round(h[f"halstead_{k}"], n).alias(k) for k, n in digits.items()], F.round(mi, 6).alias("maintainability"))


@bound("SELECT o_orderkey, round(coalesce(sum(l_quantity), 0), 4) AS wmc, count(l_orderkey) AS number_of_methods, round(coalesce(avg(l_quantity), 0), 6) AS average_method_complexity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def wmc_avg_complexity(spark: SparkSession, d: str) -> DataFrame:
    methods = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    m = G.method_totals(table(spark, d, "orders").select("o_orderkey"), methods, "o_orderkey", "l_quantity")
    return m.select("o_orderkey", F.round("wmc", 4).alias("wmc"), "number_of_methods", F.round("average_method_complexity", 6).alias("average_method_complexity"))


@bound("SELECT l_suppkey, count(DISTINCT l_orderkey) + count(DISTINCT l_partkey) AS rfc FROM lineitem GROUP BY 1")
def rfc(spark: SparkSession, d: str) -> DataFrame:
    return G.response(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_partkey")


@bound("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 211 AS dst FROM lineitem WHERE l_suppkey <> l_partkey % 211), n AS (SELECT s_suppkey AS node FROM supplier)
SELECT node, coalesce(o.c, 0) AS cbo, coalesce(o.c, 0) AS fan_out, coalesce(i.c, 0) AS fan_in FROM n LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY 1) o ON o.src = node LEFT JOIN (SELECT dst, count(*) c FROM e GROUP BY 1) i ON i.dst = node""")
def cbo_fan_in_fan_out(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 211).alias("name"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_suppkey").alias("name"))
    # classes beyond the suppliers are edges' ends all the same
    edges = uses.distinct().select("src", F.col("name").alias("dst")).where("src <> dst")
    return G.coupling(names.select(F.col("dst").alias("node")), edges)


LCOM = "m AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM lineitem)"


def _methods(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.row_number().over(w).alias("k"), F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 7).alias("fields"))


@bound(f"""WITH {LCOM}, p AS (SELECT x.o, count(*) FILTER (WHERE x.a IN (y.a, y.b) OR x.b IN (y.a, y.b)) AS s, count(y.o) AS n FROM m x LEFT JOIN m y ON x.o = y.o AND x.k < y.k GROUP BY 1) SELECT o, greatest(n - 2 * s, 0) AS lcom1 FROM p""")
def lcom1(spark: SparkSession, d: str) -> DataFrame:
    return G.lcom1(_methods(spark, d), "o", "k", "fields")


@bound(f"""WITH {LCOM}, f AS (SELECT DISTINCT o, a AS f FROM m UNION SELECT DISTINCT o, b FROM m), h AS (SELECT f.o, f.f, count(*) AS c FROM f JOIN m ON f.o = m.o AND f.f IN (m.a, m.b) GROUP BY 1, 2),
g AS (SELECT o, avg(c) AS mean FROM h GROUP BY 1), n AS (SELECT o, count(*) AS n FROM m GROUP BY 1) SELECT o, CASE WHEN n <= 1 THEN 0.0 ELSE round(greatest(0, least(1, (mean - n) / (1 - n))), 6) END AS lcom_hs FROM n JOIN g USING (o)""")
def lcom_hs(spark: SparkSession, d: str) -> DataFrame:
    m = _methods(spark, d)
    declared = m.select("o", F.explode("fields").alias("f"))
    return G.lcom_hs(m, declared, "o", "k", "fields", "f").select("o", F.round("lcom_hs", 6).alias("lcom_hs"))


@bound("SELECT r_regionkey AS node, count(n_nationkey) AS noc FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def noc(spark: SparkSession, d: str) -> DataFrame:
    return G.children_counts(table(spark, d, "region").select(F.col("r_regionkey").alias("node")), table(spark, d, "nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")))


@bound("SELECT conv_id * 100 + turn AS node, CAST(turn - min(turn) OVER (PARTITION BY conv_id) AS BIGINT) AS dit FROM conversations")
def inheritance_depth(spark: SparkSession, d: str) -> DataFrame:
    from quarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("node"))
    edges = c.select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent")).join(c.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")
    return G.inheritance_depth(c, edges)


@bound("SELECT event_id, coalesce(CASE event_type WHEN 'click' THEN 'own' WHEN 'view' THEN 'own' END, CASE event_type WHEN 'view' THEN 'import' WHEN 'error' THEN 'import' END, CASE event_type WHEN 'signup' THEN 'only' END) AS found FROM events")
def resolve_reference(spark: SparkSession, d: str) -> DataFrame:
    made = lambda *rows: spark.createDataFrame(list(rows), "k string, v string")
    tables = [made(("click", "own"), ("view", "own")), made(("view", "import"), ("error", "import")), made(("signup", "only"))]
    return G.priority_lookup(table(spark, d, "events"), "event_type", *[(t, "k", "v") for t in tables]).select("event_id", "found")


@bound("SELECT p_brand, p_type, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(quantile_cont(p_retailprice, 0.9), 4) END AS threshold FROM part GROUP BY 1, 2")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return R.thresholds(table(spark, d, "part"), "p_retailprice", 90, ["p_brand", "p_type"]).withColumn("threshold", F.round("threshold", 4))


# entities of the rule queries: customers as classes, with sums over their orders as metrics
ENTITIES = """e AS (SELECT c_custkey AS entity_id, c_mktsegment AS project, 'class' AS entity_type, c_name AS name, 'seg' || c_nationkey AS decorator,
 CAST(count(o_orderkey) AS DOUBLE) AS wmc, round(coalesce(sum(o_totalprice), 0) / 10000, 4) AS loc, CAST(count(DISTINCT o_orderpriority) AS DOUBLE) AS number_of_methods
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 4, c_nationkey)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("wmc"), F.sum("o_totalprice").alias("t"), F.countDistinct("o_orderpriority").cast("double").alias("m"))
    c = table(spark, d, "customer").join(o.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("project"), F.lit("class").alias("entity_type"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("seg"), F.col("c_nationkey").cast("string"))).alias("decorators"), F.coalesce("wmc", F.lit(0.0)).alias("wmc"), F.round(F.coalesce("t", F.lit(0.0)) / 10000, 4).alias("loc"), F.coalesce("m", F.lit(0.0)).alias("number_of_methods"))


C = R.Condition
DEMO = (
    R.Rule("big", "class", (C("loc", ">", 200.0, 90), C("wmc", ">=", 8.0, 75))),
    R.Rule("either", "class", (C("wmc", ">", 14.0, 95), C("loc", ">", 300.0, 95)), "any"),
    R.Rule("lazy", "class", (C("wmc", "<=", 3.0), C("number_of_methods", "<", 3.0)), decorators=("seg1", "seg2.*"), names=(".*7",)),
)
BAND = "CASE WHEN {0} >= 4 THEN 'critical' WHEN {0} >= 2.5 THEN 'high' WHEN {0} >= 1.5 THEN 'medium' ELSE 'low' END"
_UNDER = "CASE WHEN {v} > 0 THEN {t} / {v} END"
FOUND = f"""f AS (
 SELECT entity_id, 'big' AS smell, least(loc / 200, wmc / 8) AS x FROM e WHERE loc > 200 AND wmc >= 8
 UNION ALL SELECT entity_id, 'either', least(CASE WHEN wmc > 14 THEN wmc / 14 END, CASE WHEN loc > 300 THEN loc / 300 END) FROM e WHERE wmc > 14 OR loc > 300
 UNION ALL SELECT entity_id, 'lazy', coalesce(least({_UNDER.format(v="wmc", t=3.0)}, {_UNDER.format(v="number_of_methods", t=3.0)}), 1) FROM e
  WHERE wmc <= 3 AND number_of_methods < 3 AND NOT regexp_full_match(decorator, 'seg1|seg2.*') AND NOT regexp_full_match(name, '.*7')),
findings AS (SELECT entity_id, smell, {BAND.format("x")} AS severity, round(x, 4) AS excess FROM f)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return R.detect(_entities(spark, d), DEMO).select("entity_id", "smell", "severity", F.round("excess", 4).alias("excess"))


@bound(f"WITH {ENTITIES}, {FOUND} SELECT * FROM findings")
def rules_absolute(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)


@bound(f"""WITH {ENTITIES}, t AS (SELECT project, quantile_cont(loc, 0.9) AS l90, quantile_cont(wmc, 0.75) AS w75, quantile_cont(wmc, 0.95) AS w95, quantile_cont(loc, 0.95) AS l95, count(*) >= 20 AS ok FROM e GROUP BY 1),
j AS (SELECT entity_id, loc, wmc, CASE WHEN ok THEN l90 ELSE 200 END AS l90, CASE WHEN ok THEN w75 ELSE 8 END AS w75, CASE WHEN ok THEN w95 ELSE 14 END AS w95, CASE WHEN ok THEN l95 ELSE 300 END AS l95 FROM e JOIN t USING (project))
SELECT entity_id, 'big' AS smell FROM j WHERE loc > l90 AND wmc >= w75 UNION ALL SELECT entity_id, 'either' FROM j WHERE wmc > w95 OR loc > l95""")
def rules_percentile(spark: SparkSession, d: str) -> DataFrame:
    return R.detect(_entities(spark, d), DEMO, "percentile", "project").select("entity_id", "smell")


@bound(f"WITH {ENTITIES}, {FOUND} SELECT entity_id, smell, severity FROM findings WHERE smell <> 'lazy'")
def rules_long_form(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    values = e.select("entity_id", "entity_type", F.expr("stack(3, 'wmc', wmc, 'loc', loc, 'number_of_methods', number_of_methods) AS (metric, value)"))
    return R.detect_long(values, DEMO[:2])


@bound(f"WITH {ENTITIES} SELECT entity_id, CASE WHEN regexp_full_match(decorator, 'seg1|seg2.*') THEN 'decorator ' || decorator WHEN regexp_full_match(name, '.*7') THEN 'name ' || name END AS reason FROM e")
def exemptions(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    return e.select("entity_id", R.exemption(DEMO[2], e.columns).alias("reason"))


@bound(f"WITH {ENTITIES}, {FOUND} SELECT smell, count(*) AS n FROM findings GROUP BY 1")
def findings_by_smell(spark: SparkSession, d: str) -> DataFrame:
    return R.by_smell(_findings(spark, d))


@bound(f"WITH {ENTITIES}, {FOUND} SELECT s AS severity, CAST(r AS INT) AS rank, count(entity_id) AS n FROM (VALUES ('none', 0), ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) v(s, r) LEFT JOIN findings ON s = severity GROUP BY 1, 2")
def findings_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return R.by_severity(_findings(spark, d))


@bound(f"WITH {ENTITIES}, {FOUND} SELECT (SELECT count(*) FROM e) AS n_entities, count(*) AS n_findings, count(DISTINCT entity_id) AS n_flagged, count(DISTINCT smell) AS n_smells FROM findings")
def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(_entities(spark, d), _findings(spark, d))


@bound(f"WITH {ENTITIES}, {FOUND} SELECT * FROM findings WHERE severity IN ('high', 'critical')")
def severity_floor(spark: SparkSession, d: str) -> DataFrame:
    return R.at_least(_findings(spark, d), "high")


@bound(f"WITH {ENTITIES}, {FOUND} SELECT entity_id, smell, severity, excess FROM findings WHERE smell = 'either' ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, entity_id LIMIT 25 OFFSET 10")
def findings_page(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.filtered(_findings(spark, d), {"smell": "either", "severity": None})
    return rows.orderBy(S.severity_rank(F.col("severity")).desc(), "entity_id").offset(10).limit(25)


@bound("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%77%' AND c_mktsegment = 'HOUSEHOLD'")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return Q.filtered(table(spark, d, "customer"), {"c_mktsegment": "HOUSEHOLD"}, {"c_name": "77"}).select("c_custkey", "c_name")


@bound("SELECT c_custkey, round(sum(o_totalprice), 2) AS spend FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 50")
def rank_by_metric_topk(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.sum("o_totalprice").alias("spend"))
    return Q.top(spent, "spend", 50, "c_custkey").withColumn("spend", F.round("spend", 2))


@bound(f"""WITH {ENTITIES}, {FOUND}, w AS (SELECT smell, greatest(ceil(count(*) * 0.5), 5) AS w FROM findings GROUP BY 1),
r AS (SELECT entity_id, smell, row_number() OVER (PARTITION BY smell ORDER BY sha256('42|' || smell || '|' || entity_id), entity_id) AS n, w FROM e, w WHERE (entity_id, smell) NOT IN (SELECT entity_id, smell FROM findings))
SELECT entity_id, smell FROM r WHERE n <= w""")
def controls_sampled(spark: SparkSession, d: str) -> DataFrame:
    found = _findings(spark, d)
    smells = F.explode(F.array(*[F.lit(r.smell) for r in DEMO]))
    return D.controls(_entities(spark, d).select("entity_id", smells.alias("smell")), found, "entity_id", ["smell"], 0.5, 5, "42").select("entity_id", "smell")


@bound(f"WITH {ENTITIES}, {FOUND} SELECT entity_id, smell, sha256(smell || chr(0) || entity_id || chr(0))[:24] AS task_id FROM findings")
def task_ids(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("entity_id", "smell", D.stable_id(F.col("smell"), F.col("entity_id")).alias("task_id"))


REVIEW = """r AS (SELECT doc_id AS n, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 't' || (doc_id - doc_id % 13 * (CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END)) END AS task_id, CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN doc_id % 7 = 0 THEN 'uncertain' WHEN quality = 1 THEN 'present' WHEN quality = 0 AND doc_id % 5 <> 0 THEN 'absent' END AS label,
 CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'ann' END AS reviewer, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'none' END AS severity FROM labels)"""


def _review(spark: SparkSession, d: str) -> DataFrame:
    body = REVIEW[REVIEW.index("(") + 1 : REVIEW.rindex(")")].replace("FROM labels", "")
    return table(spark, d, "labels").selectExpr(*[f"{x.rsplit(' AS ', 1)[0]} AS {x.rsplit(' AS ', 1)[1]}" for x in _columns(body)])


def _columns(body: str) -> list[str]:
    """The select list of a plain SELECT, split at its outer commas."""
    out, depth, at = [], 0, body.strip()[len("SELECT ") :]
    part = ""
    for ch in at:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*(x.strip() for x in out), part.strip()]


@bound(f"""WITH {REVIEW}, k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n) AS nth FROM r)
SELECT n AS row_number, task_id, 'task_id' AS field, 'blank' AS message FROM k WHERE task_id = ''
UNION ALL SELECT n, task_id, 'task_id', 'duplicate' FROM k WHERE task_id <> '' AND nth > 1
UNION ALL SELECT n, task_id, 'label', 'unknown' FROM k WHERE label = 'maybe'
UNION ALL SELECT n, task_id, 'reviewer', 'missing' FROM k WHERE label IS NOT NULL AND reviewer = ''
UNION ALL SELECT n, task_id, 'severity', 'missing for present' FROM k WHERE label = 'present' AND severity = 'none'
UNION ALL SELECT n, task_id, 'severity', 'given for absent' FROM k WHERE label = 'absent' AND severity <> 'none'
UNION ALL SELECT n, task_id, 'label', 'missing' FROM k WHERE label IS NULL""")
def review_validation(spark: SparkSession, d: str) -> DataFrame:
    return D.validate_review(_review(spark, d), "n", ("task_id",), complete=True)


@bound(f"WITH {REVIEW} SELECT severity, count(*) AS n_rows, count(*) FILTER (WHERE label = 'present') AS n_present, count(*) FILTER (WHERE label = 'absent') AS n_absent, count(*) FILTER (WHERE label = 'uncertain') AS n_uncertain, count(*) FILTER (WHERE label IS NULL) AS n_open FROM r GROUP BY 1")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.label_counts(_review(spark, d), "severity")


@bound(f"WITH {REVIEW} SELECT n, CAST(label = 'present' AS INT) AS y, CASE WHEN label = 'present' THEN severity ELSE 'none' END AS severity FROM r WHERE label IN ('present', 'absent')")
def final_labels(spark: SparkSession, d: str) -> DataFrame:
    return D.finalise(_review(spark, d)).select("n", "y", "severity")


@bound("""WITH a AS (SELECT doc_id, quality AS a FROM labels WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, 1 - toxic AS b FROM labels WHERE doc_id % 10 <> 0), j AS (SELECT * FROM a FULL JOIN b USING (doc_id)), c AS (SELECT * FROM j WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (WHERE b IS NULL) AS only_first, count(*) FILTER (WHERE a IS NULL) AS only_second, count(*) FILTER (WHERE a <> b) AS conflicts FROM j),
p AS (SELECT 1 - conflicts / common AS po, (SELECT sum(x.n * y.n) FROM (SELECT a, count(*) n FROM c GROUP BY 1) x JOIN (SELECT b, count(*) n FROM c GROUP BY 1) y ON a = b) / (common * common) AS pe FROM s)
SELECT common, only_first, only_second, conflicts, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s, p""")
def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    a = rows.where("doc_id % 9 <> 0").select("doc_id", F.col("quality").alias("l"))
    b = rows.where("doc_id % 10 <> 0").select("doc_id", (1 - F.col("toxic")).alias("l"))
    out = D.agreement(a, b, "doc_id", "l")
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("kappa", F.round("kappa", 6))


@bound("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) d USING (doc_id)")
def feature_join_integrity(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.lit("a").alias("sha"))
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "b").otherwise("a").alias("sha"))
    return D.feature_integrity(labels, features, "doc_id", "sha").select("doc_id", "state")


@bound("SELECT doc_id, 'label' AS problem FROM labels WHERE quality + toxic > 1 UNION ALL SELECT doc_id, 'f' FROM labels WHERE doc_id % 4 = 0")
def training_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("y"), F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, float("nan"))).otherwise(F.lit(1.0)).alias("f"))
    return D.validate_training(rows, "doc_id", "y", ["f"])


@bound("SELECT source, CASE WHEN CAST('0x' || sha256('7' || source)[:8] AS BIGINT) % 100 < 30 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT source FROM documents)")
def project_split(spark: SparkSession, d: str) -> DataFrame:
    return E.hash_split(table(spark, d, "documents"), "source", 30, "7")


SCORED = "s AS (SELECT source, quality AS y, floor(n_chars % 1000 / 10) / 100 AS p, CAST(n_chars % 1000 >= 500 AS INT) AS z FROM labels JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("source", F.col("quality").alias("y"), (F.floor(F.col("n_chars") % 1000 / 10) / 100).alias("p"), (F.col("n_chars") % 1000 >= 500).cast("int").alias("z"))


MEASURES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN tn / (fp + tn) END, 6) AS specificity,
round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (tp / (tp + fn) + tn / (fp + tn)) / 2 END, 6) AS balanced_accuracy,
round(CASE WHEN (tp + fp) * (tp + fn) * (fp + tn) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (fp + tn) * (tn + fn)) ELSE 0 END, 6) AS mcc"""
CELLS = "count(*) FILTER (WHERE y = 1 AND z = 1) AS tp, count(*) FILTER (WHERE y = 0 AND z = 1) AS fp, count(*) FILTER (WHERE y = 1 AND z = 0) AS fn, count(*) FILTER (WHERE y = 0 AND z = 0) AS tn"


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@bound(f"WITH {SCORED}, c AS (SELECT source, {CELLS} FROM s GROUP BY 1) SELECT source, tp, fp, fn, tn, {MEASURES} FROM c")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.binary_metrics(_scored(spark, d), ["source"], "y", "z"))


AUC = """g AS (SELECT {k}, p, CAST(sum(y) AS DOUBLE) AS a, count(*) AS n, sum((p - y) * (p - y)) AS b FROM s GROUP BY {k}, p), c AS (SELECT *, sum(a) OVER w AS ca, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY {k} ORDER BY p DESC)),
r AS (SELECT {k}, sum(a) AS pos, sum(n - a) AS neg, sum((n - a) * (ca - a / 2)) AS area, sum(a * ca / cn) AS ap, sum(b) / sum(n) AS brier FROM c GROUP BY {k})
SELECT {o} CASE WHEN pos > 0 AND neg > 0 THEN round(area / (pos * neg), 6) END AS roc_auc, CASE WHEN pos > 0 AND neg > 0 THEN round(ap / pos, 6) END AS pr_auc, round(brier, 6) AS brier FROM r"""


@bound(f"WITH {SCORED}, {AUC.format(k='source', o='source,')}")
def ranking_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.ranking(_scored(spark, d), ["source"], "y", "p"))


@bound(f"WITH {SCORED.replace('source,', '1 AS source,')}, {AUC.format(k='source', o='')}")
def ranking_global(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.ranking(_scored(spark, d), [], "y", "p"))


@bound(f"WITH {SCORED}, p AS (SELECT source, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM s GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(pos) AS tp FROM p) SELECT source, n, pos, CASE WHEN tp - pos > 0 AND tn - n - (tp - pos) > 0 THEN 'ok' ELSE 'one class' END AS state FROM p, t")
def logo_folds(spark: SparkSession, d: str) -> DataFrame:
    return E.folds(_scored(spark, d), "source", "y")


@bound(f"WITH {SCORED}, c AS (SELECT source, {CELLS} FROM s GROUP BY 1), m AS (SELECT source, {MEASURES} FROM c) SELECT count(*) AS n_folds, round(avg(f1), 5) AS f1, round(avg(specificity), 5) AS specificity FROM m")
def logo_macro(spark: SparkSession, d: str) -> DataFrame:
    per = _rounded(E.binary_metrics(_scored(spark, d), ["source"], "y", "z"))
    return _rounded(E.macro(per, [], ["f1", "specificity"]), 5)


@bound("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS ci95 FROM customer GROUP BY 1")
def research_ci(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.confidence(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal"), 4)


COEF = [0.5, -1.0, 2.0, 0.25, -0.75, 1.5, -2.0, 1.0]
_first = lambda: F.slice("embedding", 1, 8)


@bound(f"""WITH u AS (SELECT vec_id, unnest(embedding[1:8]) AS x, unnest({COEF}) AS w, unnest(range(8)) AS f FROM embeddings), c AS (SELECT vec_id, f, CAST(x AS DOUBLE) * w AS v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(CAST(x AS DOUBLE) * w) DESC, f) AS r FROM u)
SELECT vec_id, CAST(f AS INT) AS feature, round(v, 6) AS contribution, CASE WHEN v >= 0 THEN 'increases_smell_risk' ELSE 'decreases_smell_risk' END AS direction, CAST(r AS INT) AS rank FROM c WHERE r <= 3""")
def linear_attribution_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.top_attributions(table(spark, d, "embeddings"), ["vec_id"], E.linear_contributions(_first(), COEF), 3))


@bound(f"""WITH u AS (SELECT vec_id, unnest(embedding[1:8]) AS x, unnest({[abs(c) for c in COEF]}) AS w, unnest(range(8)) AS f, list_median(embedding[1:8]) AS m FROM embeddings), c AS (SELECT vec_id, f, (CAST(x AS DOUBLE) - m) * w AS v FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, f) AS r FROM c)
SELECT vec_id, CAST(f AS INT) AS feature, round(v, 5) AS contribution, CAST(r AS INT) AS rank FROM k WHERE r <= 3""".replace("list_median(embedding[1:8])", "(list_sort(list_transform(embedding[1:8], lambda y: CAST(y AS DOUBLE)))[4] + list_sort(list_transform(embedding[1:8], lambda y: CAST(y AS DOUBLE)))[5]) / 2"))
def tree_fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    out = E.top_attributions(table(spark, d, "embeddings"), ["vec_id"], E.tree_contributions(_first(), [abs(c) for c in COEF]), 3)
    return _rounded(out.drop("direction"), 5)


@bound("SELECT event_id, CASE WHEN value % 1 >= 0.85 THEN 'high' WHEN value % 1 >= 0.65 THEN 'medium' ELSE 'low' END AS priority, CASE event_type WHEN 'error' THEN 'Extract cohesive groups of methods into classes of their own' ELSE 'Review the entity and refactor where it helps' END AS action FROM events")
def recommendation_priority(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") % 1).alias("p"), F.when(F.col("event_type") == "error", "god_class").otherwise(F.col("event_type")).alias("s"))
    return E.recommend(e, "s", "p").select("event_id", "priority", "action")


JOBS = """j AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'succeeded' END AS status, ts AS queued_at, ts AS heartbeat_at, CAST(user_id % 4 AS INT) AS attempts, 3 AS max_attempts, user_id % 6 = 0 AS cancelled FROM events)"""
CUTOFF = "2024-01-08 00:00:00"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'succeeded' END")
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("queued_at"), F.col("ts").alias("heartbeat_at"), (F.col("user_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), (F.col("user_id") % 6 == 0).alias("cancelled"), F.lit(None).cast("string").alias("worker"))


@bound(f"WITH {JOBS} SELECT job_id, 'w1' AS worker, attempts + 1 AS attempts FROM j WHERE status = 'queued' AND NOT cancelled AND attempts < max_attempts ORDER BY queued_at, job_id LIMIT 1")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    return Q.claim(_jobs(spark, d), "w1", F.to_timestamp(F.lit(CUTOFF))).where("worker is not null").select("job_id", "worker", "attempts")


@bound(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' AND heartbeat_at < TIMESTAMP '{CUTOFF}' THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END ELSE status END AS status FROM j")
def job_recover(spark: SparkSession, d: str) -> DataFrame:
    return Q.recover(_jobs(spark, d), F.to_timestamp(F.lit(CUTOFF))).select("job_id", "status")


@bound(f"WITH {JOBS} SELECT job_id, CASE WHEN h THEN 'queued' ELSE status END AS status, CASE WHEN h THEN 0 ELSE attempts END AS attempts, CASE WHEN h AND attempts >= max_attempts THEN max_attempts + 3 ELSE max_attempts END AS max_attempts FROM (SELECT *, status IN ('failed', 'cancelled') AS h FROM j)")
def job_retry(spark: SparkSession, d: str) -> DataFrame:
    return Q.retry(_jobs(spark, d)).select("job_id", "status", "attempts", "max_attempts")


@bound(f"WITH {JOBS} SELECT status, count(*) AS n FROM j GROUP BY 1")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(_jobs(spark, d), "status")


@bound(f"""WITH {ENTITIES}, {FOUND}, c AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS high, count(*) FILTER (WHERE severity = 'medium') AS medium FROM findings JOIN e USING (entity_id) GROUP BY 1),
s AS (SELECT *, CAST(floor(greatest(35, 100 - least(65, 3 * high + 1.5 * medium + 0.2 * n)) + 0.5) AS BIGINT) AS score, CAST(floor(1.5 * n + 0.5) AS BIGINT) AS debt FROM c) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s""")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    found = R.detect(_entities(spark, d), DEMO, project="project")
    return Q.health(found, "project", "severity")


@bound(f"WITH {ENTITIES}, {FOUND}, x AS (SELECT entity_id IN (SELECT entity_id FROM findings) AS r, wmc > 10 AS m FROM e) SELECT count(*) FILTER (WHERE r AND m) AS tp, count(*) FILTER (WHERE m AND NOT r) AS fp, count(*) FILTER (WHERE r AND NOT m) AS fn, count(*) FILTER (WHERE NOT r AND NOT m) AS tn FROM x")
def rule_vs_ml_confusion(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    return Q.rule_vs_model(e, _findings(spark, d), e.where("wmc > 10"), "entity_id")


@bound("SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN v[1] IN ('=', '+', '-', '@') THEN '''' || v ELSE v END AS v FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || event_type AS v FROM events)")
def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.expr("CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END"), F.col("event_type"))
    return Q.csv_cells(table(spark, d, "events").select("event_id", v.alias("v")))


@bound("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS written_bytes, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 100.005 AS fits FROM events")
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return I.within_budget(e, "user_id", "o", "value", 100.005).select("user_id", "event_id", F.round("written_bytes", 4).alias("written_bytes"), "fits")


@bound("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return G.keep_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@bound("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return Q.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


from quarry.plans import bindings_models, bindings_runs  # noqa: E402, F401  (register their queries)
