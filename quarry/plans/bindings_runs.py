"""More operators bound to the testdata tables, each with the SQL that gives the same rows: intake, rules, review data, runs, result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bundles as B
from quarry.operators import evaluation as E
from quarry.operators import explain as X
from quarry.operators import graph as G
from quarry.operators import jobs as J
from quarry.operators import learning as L
from quarry.operators import query as Q
from quarry.operators import rules as R
from quarry.plans import analyze as A
from quarry.plans.bindings import CUTOFF, DEMO, ENTITIES, FOUND, JOBS, _entities, _findings, _jobs, _rounded, bound
from quarry.session import table
from quarry.settings import Training
from quarry.sources import exports as W
from quarry.sources import intake as N
from quarry.sources import inventory as I
from quarry.sources import manifests as M


def columns(*pairs: str) -> tuple[list[str], str]:
    """Expressions 'name: sql' for both engines: a Spark select list and a SQL one."""
    named = [p.split(": ", 1) for p in pairs]
    return [f"{x} AS {n}" for n, x in named], ", ".join(f"{x} AS {n}" for n, x in named)


# ---------------------------------------------------------------- intake

FILE_LIST, FILE_SQL = columns(
    "page_id: page_id",
    "path: CASE page_id % 12 WHEN 0 THEN 'src/a' || page_id || '.py' WHEN 1 THEN 'build/x.py' WHEN 2 THEN 'web/app.min.py' WHEN 3 THEN 'gen/m_pb2.py' WHEN 4 THEN '.git/hooks/p.py' WHEN 5 THEN 'lib/pkg.egg-info/top.txt' WHEN 6 THEN 'tests/test_' || page_id || '.py' WHEN 7 THEN 'env' || page_id || '/pyvenv.cfg' WHEN 8 THEN 'env' || (page_id - 1) || '/lib/m.py' WHEN 9 THEN 'Main.JAVA' WHEN 10 THEN 'a/b.c/README' ELSE 'lib/x.pyc' END",
    "html: html",
)


def _files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").selectExpr(*FILE_LIST).withColumn("path", F.concat(F.col("page_id").cast("string"), F.lit("/"), F.col("path")))
    return rows.select("page_id", F.when(F.col("page_id") % 12 == 8, F.concat((F.col("page_id") - 1).cast("string"), F.substr("path", F.length(F.col("page_id").cast("string")) + 1))).otherwise(F.col("path")).alias("path"), F.octet_length("html").cast("bigint").alias("size"), F.encode("html", "UTF-8").alias("content"))


_AT = f"files AS (SELECT page_id, html, (CASE WHEN page_id % 12 = 8 THEN page_id - 1 ELSE page_id END) || '/' || path AS path FROM (SELECT {FILE_SQL} FROM pages))"
_LANG = "CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.java' THEN 'java' ELSE 'other' END"


@bound(rf"""WITH {_AT}, dirs AS (SELECT *, regexp_extract(path, '^(.*/)?', 1) AS dir, lower(regexp_extract(path, '[^/]*$')) AS name FROM files),
venv AS (SELECT dir AS root FROM dirs WHERE name = 'pyvenv.cfg'), x AS (SELECT * FROM dirs WHERE NOT EXISTS (SELECT 1 FROM venv WHERE starts_with(dirs.path, venv.root))),
f AS (SELECT *, regexp_extract(path, '(?:^|/)(build|dist|venv|env|\.[^/]+|[^/]+\.egg-info)/', 1) AS bad, octet_length(encode(html)) AS size FROM x)
SELECT path, CASE WHEN bad <> '' THEN 'excluded_path' WHEN name LIKE '%.min.py' OR name LIKE '%.pyc' THEN 'disallowed_suffix' WHEN contains(name, '_pb2.py') THEN 'excluded_path' WHEN size > 4194304 THEN 'member_too_large' END AS reason,
 CASE WHEN bad <> '' THEN 'in ' || bad || '/' WHEN contains(name, '_pb2.py') THEN 'generated source' ELSE '' END AS detail FROM f
WHERE bad <> '' OR name LIKE '%.min.py' OR name LIKE '%.pyc' OR contains(name, '_pb2.py') ORDER BY reason, path LIMIT 60""")
def source_rejections(spark: SparkSession, d: str) -> DataFrame:
    return I.rejections_in_order(I.inventory(_files(spark, d))[1], 60)


@bound(rf"""WITH {_AT} SELECT path, {_LANG} AS language, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, CAST(length(html) - length(replace(html, chr(10), '')) + CASE WHEN html = '' OR html LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS line_count, sha256(html) AS sha256
FROM files WHERE CAST(page_id % 12 AS INT) IN (0, 6, 9, 10)""")
def inventory_files(spark: SparkSession, d: str) -> DataFrame:
    return I.inventory(_files(spark, d))[0].select("path", "language", "size_bytes", "line_count", "sha256")


@bound(rf"WITH {_AT}, v AS (SELECT path FROM files WHERE path LIKE '%/pyvenv.cfg') SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM v WHERE starts_with(files.path, regexp_replace(v.path, 'pyvenv.cfg$', '')))")
def outside_virtualenvs(spark: SparkSession, d: str) -> DataFrame:
    return I.without_virtualenvs(_files(spark, d)).select("path")


@bound(rf"WITH {_AT} SELECT regexp_replace(path, '^wrap/', '') AS path FROM (SELECT 'wrap/' || path AS path FROM files)")
def root_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    return N.unwrapped(_files(spark, d).withColumn("path", F.concat(F.lit("wrap/"), "path"))).select("path")


MEMBER_LIST, MEMBER_SQL = columns(
    "event_id: event_id",
    "archive: 'a' || CAST(user_id AS VARCHAR(20))",
    "path: CASE event_id % 9 WHEN 0 THEN 'ok/' || event_id || '.py' WHEN 1 THEN '/abs.py' WHEN 2 THEN 'C:/x.py' WHEN 3 THEN 'a/../b.py' WHEN 4 THEN ' ' WHEN 5 THEN 'link' WHEN 6 THEN 'big.bin' WHEN 7 THEN 'bomb.txt' ELSE 'dev' END",
    "size: CAST(CASE event_id % 9 WHEN 6 THEN 5000000 ELSE floor(value * 100) END AS BIGINT)",
    "packed: CAST(CASE event_id % 9 WHEN 7 THEN 1 WHEN 6 THEN 4000000 ELSE floor(value * 50) + 1 END AS BIGINT)",
    "kind: CASE event_id % 9 WHEN 5 THEN 'symlink' WHEN 8 THEN 'special' ELSE 'file' END",
)


@bound(f"""WITH m AS (SELECT {MEMBER_SQL} FROM events) SELECT event_id, CASE WHEN trim(path) = '' THEN 'empty_name' WHEN path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') THEN 'absolute_path' WHEN regexp_matches(path, '(^|/)[.][.](/|$)') THEN 'path_traversal'
 WHEN kind = 'symlink' THEN 'symlink' WHEN kind = 'special' THEN 'special_file' WHEN size > 4194304 THEN 'member_too_large' WHEN packed > 0 AND size > 120 * packed THEN 'compression_ratio' END AS why FROM m""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").selectExpr(*MEMBER_LIST)
    return m.select("event_id", I.screen_member(F.col("path"), F.col("size"), F.col("packed"), F.col("kind")).alias("why"))


@bound(f"WITH m AS (SELECT {MEMBER_SQL} FROM events), t AS (SELECT archive, count(*) AS members, CAST(sum(size) AS BIGINT) AS declared_bytes, CAST(sum(packed) AS BIGINT) AS packed_bytes FROM m GROUP BY 1) SELECT *, CASE WHEN members > 50000 THEN 'too_many_members' WHEN declared_bytes > 1073741824 THEN 'archive_too_large' WHEN packed_bytes > 0 AND declared_bytes > 120 * packed_bytes THEN 'compression_ratio' END AS broken FROM t")
def archive_sums(spark: SparkSession, d: str) -> DataFrame:
    return I.archive_totals(table(spark, d, "events").selectExpr(*MEMBER_LIST))


URL_LIST, URL_SQL = columns(
    "page_id: page_id",
    "url: CASE page_id % 8 WHEN 0 THEN 'https://github.com/o' || page_id || '/r.git' WHEN 1 THEN 'http://github.com/a/b' WHEN 2 THEN 'https://u:p@github.com/a/b' WHEN 3 THEN 'https://GitLab.com:443/a/b/c?x#y' WHEN 4 THEN 'https://github.com:8443/a/b' WHEN 5 THEN 'https://github.com/a' WHEN 6 THEN url ELSE ' ' END",
)


@bound(rf"""WITH u AS (SELECT {URL_SQL} FROM pages), p AS (SELECT page_id, url, regexp_extract(url, '^https://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^https://[^/]*(/[^?#]*)', 1), '\.git$', '') AS rest FROM u)
SELECT page_id, CASE WHEN trim(url) = '' THEN 'empty' WHEN url NOT LIKE 'https://%' THEN 'not https' WHEN contains(host, '@') THEN 'credentials' WHEN regexp_replace(lower(host), ':.*$', '') NOT IN ('github.com', 'gitlab.com', 'bitbucket.org') THEN 'host not allowed'
 WHEN contains(host, ':') AND host NOT LIKE '%:443' THEN 'port' WHEN len(string_split(rest, '/')) < 3 THEN 'no owner and repository' END AS problem,
 CASE WHEN page_id % 8 IN (0, 3) THEN 'https://' || regexp_replace(lower(host), ':.*$', '') || '/' || string_split(rest, '/')[2] || '/' || string_split(rest, '/')[3] || '.git' END AS normal FROM p""")
def repository_addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").selectExpr(*URL_LIST).select("page_id", M.repository(F.col("url")).alias("r")).select("page_id", "r.*")


@bound(r"SELECT page_id, CASE WHEN n = '' THEN 'project' ELSE n END AS name FROM (SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 120) AS n FROM pages)")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@bound("""WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS x, text FROM documents)
SELECT doc_id, sha256(array_to_string(x[2:3], chr(10))) AS slice, sha256(CASE WHEN len(x) > 3 THEN array_to_string(x[1:3], chr(10)) || chr(10) || '# ... truncated ...' ELSE text END) AS cut FROM l""")
def snippets_cut(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.line_slice(t, F.lit(2), F.lit(3)), 256).alias("slice"), F.sha2(T.truncated(t, 3), 256).alias("cut"))


@bound(r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, generate_subscripts(string_split(html, chr(10)), 1) AS i, html FROM pages), n AS (SELECT page_id, CASE WHEN html LIKE '%' || chr(10) THEN max(i) - 1 ELSE max(i) END AS loc FROM l GROUP BY page_id, html)
SELECT 'mod:f' || page_id || '.js' AS entity_id, greatest(1, loc)::DOUBLE AS loc, greatest(1, greatest(1, loc) - 1)::DOUBLE AS sloc, NULL::DOUBLE AS wmc, NULL::DOUBLE AS cyclomatic_complexity, true AS is_default FROM n""")
def line_features_of_modules(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), F.col("html").alias("text"))
    f = A.line_features(A.line_entities(files), compatible=True).where("entity_type = 'module'")
    return f.select("entity_id", "loc", "sloc", "wmc", "cyclomatic_complexity", "is_default")


# ---------------------------------------------------------------- graph

_CLASSES = "c AS (SELECT s_nationkey % 5 AS project, 'S' || s_suppkey AS entity_id, 'N' || (s_suppkey % 40) AS name, 'm' || (s_suppkey % 7) AS module, 'm' || (s_suppkey % 7) || '.N' || (s_suppkey % 40) AS qualified_name FROM supplier)"
_USES = "u AS (SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS project, 'L' || l_suppkey AS child, 'N' || (l_partkey % 60) AS name, 'm' || (l_suppkey % 7) AS module, CASE l_partkey % 3 WHEN 0 THEN 'm' || (l_partkey % 7) || '.N' || (l_partkey % 60) WHEN 1 THEN 'other.N' || (l_partkey % 50) END AS origin FROM lineitem)"
_RESOLVED = f"""{_CLASSES}, {_USES}, one AS (SELECT project, name, min(entity_id) AS t FROM c GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT u.*, coalesce((SELECT min(entity_id) FROM c WHERE c.project = u.project AND c.module = u.module AND c.name = u.name), (SELECT min(entity_id) FROM c WHERE c.project = u.project AND c.qualified_name = u.origin),
 (SELECT t FROM one WHERE one.project = u.project AND one.name = regexp_extract(u.origin, '[^.]*$')), (SELECT t FROM one WHERE one.project = u.project AND one.name = u.name)) AS target FROM u)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    body = _CLASSES[_CLASSES.index("(SELECT ") + 8 : _CLASSES.rindex(" FROM")]
    classes = table(spark, d, "supplier").selectExpr(*[x.strip() for x in body.split(", ")])
    uses = table(spark, d, "lineitem").selectExpr("CAST(l_suppkey % 5 AS INT) AS project", "'L' || l_suppkey AS child", "'N' || (l_partkey % 60) AS name", "'m' || (l_suppkey % 7) AS module", "CASE l_partkey % 3 WHEN 0 THEN 'm' || (l_partkey % 7) || '.N' || (l_partkey % 60) WHEN 1 THEN 'other.N' || (l_partkey % 50) END AS origin").distinct()
    return G.resolve_classes(uses, classes)


@bound(f"WITH {_RESOLVED} SELECT project, child, name, module, origin, target FROM r")
def resolve_classes(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("project", "child", "name", "module", "origin", "target")


@bound(f"WITH {_RESOLVED} SELECT project, count(DISTINCT child || '>' || target) AS edges, count(DISTINCT CASE WHEN target IS NULL THEN child || '>' || name END) AS unresolved FROM r GROUP BY 1")
def inheritance_edges(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d)
    return r.groupBy("project").agg(F.countDistinct(F.concat("child", F.lit(">"), "target")).alias("edges"), F.countDistinct(F.when(F.col("target").isNull(), F.concat("child", F.lit(">"), "name"))).alias("unresolved"))


@bound("WITH e AS (SELECT DISTINCT l_suppkey AS src, s_suppkey AS dst FROM lineitem JOIN supplier ON s_suppkey % 37 = l_partkey % 211 WHERE l_suppkey <> s_suppkey) SELECT s_suppkey AS node, (SELECT count(*) FROM e WHERE src = s_suppkey) AS cbo, (SELECT count(*) FROM e WHERE src = s_suppkey) AS fan_out, (SELECT count(*) FROM e WHERE dst = s_suppkey) AS fan_in FROM supplier")
def reference_coupling(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 211).alias("name"))
    return G.coupling_by_name(s.select(F.col("s_suppkey").alias("node")), uses, s.select(F.col("s_suppkey").alias("dst"), (F.col("s_suppkey") % 37).alias("name")))


@bound("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 2 UNION SELECT s_suppkey, s_suppkey - 7 FROM supplier WHERE s_suppkey % 10 = 9),
w AS (SELECT child AS node, parent AS at, 1 AS d FROM e UNION SELECT w.node, e.parent, w.d + 1 FROM w JOIN e ON w.at = e.child) SELECT s_suppkey AS node, CAST(coalesce(max(d), 0) AS BIGINT) AS dit FROM supplier LEFT JOIN w ON node = s_suppkey GROUP BY 1""")
def inheritance_branching(spark: SparkSession, d: str) -> DataFrame:
    from quarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    n = F.col("node")
    edge = lambda where, parent: s.where(where).select(n.alias("child"), parent.cast("bigint").alias("parent"))
    edges = edge(n > 0, F.floor(n / 2)).union(edge(n > 2, F.floor(n / 3))).union(edge(n % 10 == 9, n - 7))
    return G.inheritance_depth(s, edges)


# ---------------------------------------------------------------- rules

_CLASS_LIST, _CLASS_SQL = columns(
    "entity_id: p_partkey", "name: p_name", "wmc: CAST(p_size AS DOUBLE) * 1.5", "lcom_hs: CAST(p_partkey % 100 AS DOUBLE) / 100", "cbo: CAST(p_partkey % 13 AS DOUBLE)", "loc: p_retailprice / 4", "number_of_methods: CAST(p_partkey % 29 AS DOUBLE)",
    "number_of_fields: CAST(p_partkey % 7 AS DOUBLE)", "number_of_public_methods: CAST(p_partkey % 4 AS DOUBLE)", "dit: CAST(p_partkey % 4 AS DOUBLE)",
    "base: CASE p_partkey % 11 WHEN 0 THEN 'Enum' WHEN 1 THEN 'MyError' WHEN 2 THEN 'BaseModel' ELSE 'Plain' END", "decorator: CASE p_partkey % 17 WHEN 0 THEN 'dataclass' WHEN 1 THEN 'attr.s' ELSE 'other' END",
)
_METHOD_LIST, _METHOD_SQL = columns(
    "entity_id: p_partkey", "loc: p_retailprice / 12", "cyclomatic_complexity: CAST(p_size % 14 AS DOUBLE)", "cognitive_complexity: CAST(p_size % 19 AS DOUBLE)", "nesting_depth: CAST(p_partkey % 7 AS DOUBLE)", "local_variable_count: CAST(p_partkey % 12 AS DOUBLE)",
    "parameter_count_excluding_self: CAST(p_partkey % 9 AS DOUBLE)", "foreign_access_ratio: CAST(p_partkey % 10 AS DOUBLE) / 10", "accessed_field_count: CAST(p_partkey % 5 AS DOUBLE)", "call_count: CAST(p_size % 8 AS DOUBLE)", "max_message_chain: CAST(p_partkey % 6 AS DOUBLE)",
    "magic_number_count: CAST(p_size % 6 AS DOUBLE)", "decorator: CASE p_partkey % 8 WHEN 0 THEN 'staticmethod' WHEN 1 THEN 'property' ELSE 'other' END",
)
_DATA = "base IN ('Enum', 'BaseModel') OR decorator IN ('dataclass', 'attr.s')"
_MINIMAL = "base IN ('Enum', 'MyError') OR regexp_full_match(name, '.*Error|.*Exception|.*Protocol|.*Interface|Meta|Config')"


@bound(f"""WITH c AS (SELECT {_CLASS_SQL} FROM part), m AS (SELECT {_METHOD_SQL} FROM part)
SELECT entity_id, 'god_class' AS smell FROM c WHERE wmc >= 47 AND lcom_hs > 0.725 AND cbo > 5 AND NOT ({_DATA})
UNION ALL SELECT entity_id, 'large_class' FROM c WHERE loc > 200 AND number_of_methods > 20
UNION ALL SELECT entity_id, 'data_class' FROM c WHERE number_of_fields >= 3 AND wmc < 12 AND number_of_public_methods <= 2 AND NOT ({_DATA})
UNION ALL SELECT entity_id, 'lazy_class' FROM c WHERE wmc <= 3 AND loc < 25 AND number_of_methods <= 2 AND NOT ({_DATA}) AND NOT ({_MINIMAL})
UNION ALL SELECT entity_id, 'refused_bequest' FROM c WHERE dit >= 2 AND number_of_methods <= 2 AND wmc <= 5 AND NOT ({_DATA}) AND NOT ({_MINIMAL})
UNION ALL SELECT entity_id, 'long_method' FROM m WHERE loc > 65
UNION ALL SELECT entity_id, 'brain_method' FROM m WHERE loc > 32 AND cyclomatic_complexity >= 8 AND nesting_depth >= 3 AND local_variable_count > 8
UNION ALL SELECT entity_id, 'complex_method' FROM m WHERE cyclomatic_complexity > 10 OR cognitive_complexity > 15
UNION ALL SELECT entity_id, 'long_parameter_list' FROM m WHERE parameter_count_excluding_self > 5
UNION ALL SELECT entity_id, 'deep_nesting' FROM m WHERE nesting_depth >= 5
UNION ALL SELECT entity_id, 'feature_envy' FROM m WHERE foreign_access_ratio > 0.667 AND accessed_field_count <= 2 AND call_count >= 3 AND decorator NOT IN ('staticmethod', 'property')
UNION ALL SELECT entity_id, 'message_chain' FROM m WHERE max_message_chain >= 4
UNION ALL SELECT entity_id, 'magic_number' FROM m WHERE magic_number_count >= 4""")
def builtin_rules(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    arrays = {"base_names": F.array("base"), "decorators": F.array("decorator")}
    classes = part.selectExpr(*_CLASS_LIST, "'class' AS entity_type").withColumns(arrays)
    methods = part.selectExpr(*_METHOD_LIST, "'method' AS entity_type", "'m' AS name").withColumn("decorators", F.array("decorator")).withColumn("base_names", F.array().cast("array<string>"))
    return R.detect(classes.unionByName(methods, allowMissingColumns=True)).select("entity_id", "smell")


_SMALL = "(SELECT entity_id, loc, wmc, project || '/' || (entity_id % 9) AS project FROM e)"


@bound(f"""WITH {ENTITIES}, g AS {_SMALL}, t AS (SELECT project, quantile_cont(loc, 0.9) AS l, quantile_cont(wmc, 0.75) AS w, count(*) AS n FROM g GROUP BY 1)
SELECT entity_id, n >= 20 AS relative FROM g JOIN t USING (project) WHERE loc > CASE WHEN n >= 20 THEN l ELSE 200 END AND wmc >= CASE WHEN n >= 20 THEN w ELSE 8 END""")
def rules_percentile_small_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).withColumn("project", F.concat("project", F.lit("/"), (F.col("entity_id") % 9).cast("string")))
    found = R.detect(e, DEMO[:1], "percentile", "project")
    return found.select("entity_id", F.exists("evidence", lambda x: x["threshold_source"] != "absolute").alias("relative"))


@bound(f"WITH {ENTITIES}, l AS (SELECT project, 'wmc' AS metric, wmc AS v FROM e UNION ALL SELECT project, 'loc', loc FROM e), q AS (SELECT * FROM (VALUES ('wmc', 75.0), ('wmc', 95.0), ('loc', 33.3)) x(metric, q)) SELECT project, metric, CAST(q AS DOUBLE) AS q, count(*) AS n, round(CASE q WHEN 75.0 THEN quantile_cont(v, 0.75) WHEN 95.0 THEN quantile_cont(v, 0.95) ELSE quantile_cont(v, 0.333) END, 6) AS threshold FROM l JOIN q USING (metric) GROUP BY project, metric, q")
def percentile_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.percentiles(_entities(spark, d), [("wmc", 75), ("wmc", 95), ("loc", 33.3)], ["project"], 1))


@bound(f"WITH {ENTITIES}, n AS (SELECT project || '/' || (entity_id % 9) AS project, count(*) AS n FROM e GROUP BY 1) SELECT project, 2 AS metrics FROM n WHERE n >= 20")
def threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).withColumn("project", F.concat("project", F.lit("/"), (F.col("entity_id") % 9).cast("string")))
    return R.threshold_summary(R.percentiles(e, [("wmc", 75), ("loc", 90)], ["project"]), ["project"])


@bound(f"WITH {ENTITIES}, {FOUND} SELECT entity_id, 'Lazy in ' || name || ' (' || severity || '): wmc ' || CAST(wmc AS VARCHAR) || ' <= 3.0; number_of_methods ' || CAST(number_of_methods AS VARCHAR) || ' < 3.0' AS said FROM findings JOIN e USING (entity_id) WHERE smell = 'lazy'")
def finding_sentences(spark: SparkSession, d: str) -> DataFrame:
    return R.detect(_entities(spark, d), DEMO[2:]).select("entity_id", R.explain().alias("said"))


# ---------------------------------------------------------------- review data

_TASKS = f"""r AS (SELECT entity_id, smell, row_number() OVER (PARTITION BY smell ORDER BY sha256('42|' || smell || '|' || entity_id), entity_id) AS n, w FROM e, (SELECT smell, greatest(ceil(count(*) * 0.5), 5) AS w FROM findings GROUP BY 1) w WHERE (entity_id, smell) NOT IN (SELECT entity_id, smell FROM findings)),
tasks AS (SELECT entity_id, smell, 'rule' AS source FROM findings UNION ALL SELECT entity_id, smell, 'control' FROM r WHERE n <= w)"""


@bound(f"WITH {ENTITIES}, {FOUND}, {_TASKS} SELECT smell AS smell_type, count(*) AS tasks, count(*) FILTER (WHERE source = 'rule') AS rule_candidates, count(*) FILTER (WHERE source = 'control') AS sampled_controls FROM tasks GROUP BY 1")
def bundle_counters(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import dataset as D

    found = _findings(spark, d)
    candidates = _entities(spark, d).select("entity_id", F.explode(F.array(*[F.lit(r.smell) for r in DEMO])).alias("smell"))
    tasks = D.bundle(found.select("entity_id", "smell"), D.controls(candidates, found, "entity_id", ["smell"], 0.5, 5, "42"))
    return B.counters(tasks.select(F.col("smell").alias("smell_type"), F.col("source").alias("candidate_source")), "smell_type")


_SHEET = "CASE WHEN {l} = 1 THEN 'present' WHEN doc_id % 7 = {k} THEN 'uncertain' ELSE 'absent' END AS label, CASE WHEN {l} = 1 THEN CASE WHEN doc_id % {s} = 0 THEN 'High' ELSE 'low' END END AS severity"
_PAIR = f"a AS (SELECT doc_id AS task_id, {_SHEET.format(l='quality', k=3, s=4)} FROM labels WHERE doc_id % 9 <> 0), b AS (SELECT doc_id AS task_id, {_SHEET.format(l='1 - toxic', k=4, s=6)} FROM labels WHERE doc_id % 10 <> 0)"


@bound(f"""WITH {_PAIR}, j AS (SELECT a.label AS la, b.label AS lb, coalesce(lower(a.severity), 'none') = coalesce(lower(b.severity), 'none') AS same FROM a JOIN b USING (task_id)), p AS (SELECT * FROM j WHERE la <> 'uncertain' AND lb <> 'uncertain'),
k AS (SELECT avg(CAST(la = lb AS INT)) AS po, avg(CAST(la = 'present' AS INT)) * avg(CAST(lb = 'present' AS INT)) + avg(CAST(la = 'absent' AS INT)) * avg(CAST(lb = 'absent' AS INT)) AS pe, count(*) AS n FROM p)
SELECT (SELECT count(*) FROM j) AS common, (SELECT count(*) FROM a WHERE task_id NOT IN (SELECT task_id FROM b)) AS only_first, (SELECT count(*) FROM b WHERE task_id NOT IN (SELECT task_id FROM a)) AS only_second, (SELECT count(*) FROM j WHERE la <> lb) AS conflicts, round((SELECT avg(CAST(la = lb AS INT)) FROM j), 6) AS label_agreement, n AS "binary", round((po - pe) / (1 - pe), 6) AS kappa,
 (SELECT count(*) FROM j WHERE la = 'present' AND lb = 'present') AS present_both, round((SELECT avg(CAST(same AS INT)) FROM j WHERE la = 'present' AND lb = 'present'), 6) AS severity_agreement FROM k""")
def review_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    sheet = lambda where, l, k, s: rows.where(where).selectExpr("doc_id AS task_id", f"CASE WHEN {l} = 1 THEN 'present' WHEN doc_id % 7 = {k} THEN 'uncertain' ELSE 'absent' END AS label", f"CASE WHEN {l} = 1 THEN CASE WHEN doc_id % {s} = 0 THEN 'High' ELSE 'low' END END AS severity")  # noqa: E731, E741
    return _rounded(B.agreement(sheet("doc_id % 9 <> 0", "quality", 3, 4), sheet("doc_id % 10 <> 0", "1 - toxic", 4, 6)))


_LABEL_LIST, _LABEL_SQL = columns(
    "task_id: CASE WHEN doc_id % 31 = 0 THEN ' ' WHEN doc_id % 29 = 1 THEN 't1' ELSE 't' || doc_id END", "project_fingerprint: CASE WHEN doc_id % 23 = 0 THEN 'gone' ELSE source END", "entity_id: CAST(CASE WHEN doc_id % 19 = 0 THEN -1 ELSE doc_id END AS BIGINT)", "entity_type: CASE WHEN doc_id % 13 = 0 THEN 'class' ELSE 'method' END",
    "qualified_name: 'q' || doc_id", "relative_path: CASE WHEN doc_id % 17 = 0 THEN 'moved' ELSE 'p' || doc_id END", "smell_type: CASE doc_id % 11 WHEN 0 THEN 'god_class' WHEN 1 THEN 'no_smell' WHEN 2 THEN 'deep_nesting' ELSE 'long_method' END", "source_sha256: CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE 'sha' || doc_id END",
    "label: quality + CASE WHEN doc_id % 37 = 0 THEN 2 ELSE 0 END", "toxic: toxic", "doc_id: doc_id", "n_chars: n_chars", "source: source",
)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").selectExpr(*_LABEL_LIST)


_LABELS = f"t AS (SELECT {_LABEL_SQL} FROM labels JOIN documents USING (doc_id))"


@bound(f"""WITH {_LABELS}, e AS (SELECT source, doc_id, CASE WHEN doc_id % 41 = 0 THEN 'class' ELSE 'method' END AS ty, doc_id % 43 <> 0 AS vector FROM documents)
SELECT t.doc_id, CASE WHEN project_fingerprint = 'gone' THEN 'project missing' WHEN e.doc_id IS NULL THEN 'entity missing' WHEN NOT vector THEN 'features missing' WHEN smell_type = 'no_smell' THEN 'smell unknown' WHEN (smell_type = 'god_class') <> (ty = 'class') THEN 'smell of another type'
 WHEN source_sha256 = 'old' THEN 'source changed' WHEN relative_path = 'moved' OR entity_type <> ty THEN 'metadata changed' ELSE 'ok' END AS state FROM t LEFT JOIN e ON e.source = t.project_fingerprint AND e.doc_id = t.entity_id""")
def feature_join_states(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    entities = docs.select(F.col("source").alias("project_fingerprint"), F.col("doc_id").alias("entity_id"), F.when(F.col("doc_id") % 41 == 0, "class").otherwise("method").alias("entity_type"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qualified_name"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("relative_path"), (F.col("doc_id") % 43 != 0).alias("vector"))
    sources = docs.select(F.col("source").alias("project_fingerprint"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("relative_path"), F.concat(F.lit("sha"), F.col("doc_id").cast("string")).alias("sha256"))
    return B.join_states(_labelled(spark, d), entities, sources).select("doc_id", "state")


_FEATURES = "CASE WHEN doc_id % 47 <> 0 AND doc_id % 53 <> 0 THEN CAST(n_chars AS DOUBLE) END AS f1, CASE WHEN doc_id % 53 <> 0 THEN CASE WHEN doc_id % 59 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 1.5 END END AS f2"


@bound(f"""WITH {_LABELS}, x AS (SELECT *, {_FEATURES} FROM t), s AS (SELECT smell_type FROM (SELECT DISTINCT smell_type, f1 IS NULL AS a FROM x WHERE f1 IS NOT NULL OR f2 IS NOT NULL) GROUP BY 1 HAVING count(*) > 1)
SELECT task_id, 'blank task_id' AS problem FROM x WHERE trim(task_id) = '' UNION ALL SELECT task_id, 'smell or entity type unknown' FROM x WHERE smell_type = 'no_smell'
UNION ALL SELECT task_id, 'smell of another type' FROM x WHERE smell_type <> 'no_smell' AND (smell_type = 'god_class') <> (entity_type = 'class') UNION ALL SELECT task_id, 'label is not 0 or 1' FROM x WHERE label > 1
UNION ALL SELECT task_id, 'no feature' FROM x WHERE f1 IS NULL AND f2 IS NULL UNION ALL SELECT task_id, 'not finite: f2' FROM x WHERE isinf(f2)
UNION ALL SELECT task_id, 'repeated task_id' FROM x WHERE trim(task_id) <> '' GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT 'smell ' || smell_type, 'rows have different features' FROM s""")
def training_issues(spark: SparkSession, d: str) -> DataFrame:
    return B.training_issues(_labelled(spark, d).selectExpr("*", *_FEATURES.replace(" AS f1, ", " AS f1@").split("@")), ["f1", "f2"])


@bound(f"WITH {_LABELS} SELECT smell_type, count(*) AS n_rows, count(DISTINCT project_fingerprint) AS projects, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative FROM t GROUP BY 1")
def training_balance(spark: SparkSession, d: str) -> DataFrame:
    return B.training_balance(_labelled(spark, d))


@bound(f"""WITH {_LABELS}, n AS (SELECT smell_type, count(*) AS n_rows, count(DISTINCT project_fingerprint) AS projects, count(DISTINCT label) AS classes FROM t WHERE label <= 1 AND (smell_type <> 'deep_nesting' OR project_fingerprint = 'gone') GROUP BY 1), a AS (SELECT * FROM (VALUES ('god_class'), ('long_method'), ('deep_nesting'), ('dead_code')) v(smell_type)), j AS (SELECT smell_type, coalesce(n_rows, 0) AS n_rows, coalesce(projects, 0) AS projects, coalesce(classes, 0) AS classes FROM a LEFT JOIN n USING (smell_type))
SELECT *, CASE WHEN n_rows = 0 THEN 'smell is absent from the dataset' WHEN n_rows < 10 THEN 'fewer than 10 rows' WHEN projects < 2 THEN 'fewer than 2 projects' WHEN classes < 2 THEN 'only one class is present' END AS skip FROM j""")
def training_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).where("label <= 1 and (smell_type <> 'deep_nesting' or project_fingerprint = 'gone')")
    return L.training_plan(rows, Training(), ("god_class", "long_method", "deep_nesting", "dead_code"))


@bound(f"WITH {_LABELS} SELECT t.task_id, t.label, CAST(d.n_chars AS DOUBLE) AS feature__loc, CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.doc_id % 10 AS DOUBLE) END AS feature__cbo FROM t JOIN documents d ON d.source = t.project_fingerprint AND d.doc_id = t.entity_id")
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "documents").select(F.col("source").alias("project_fingerprint"), F.col("doc_id").alias("entity_id"), F.col("n_chars").alias("loc"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10).alias("cbo"))
    rows = B.training_rows(_labelled(spark, d).select("task_id", "label", "project_fingerprint", "entity_id"), features, ["loc", "cbo"])
    return rows.select("task_id", "label", "feature__loc", "feature__cbo")


@bound(f"WITH {_LABELS} SELECT smell_type, count(*) FILTER (WHERE l IN ('present', 'absent')) AS binary_labels, count(*) FILTER (WHERE l = 'uncertain') AS uncertain_excluded, count(*) FILTER (WHERE l = 'present') AS positive, count(*) FILTER (WHERE l = 'absent') AS negative FROM (SELECT smell_type, CASE label WHEN 1 THEN 'present' WHEN 0 THEN 'absent' ELSE 'uncertain' END AS l FROM t) GROUP BY 1")
def label_totals(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("label") == 1, " Present").when(F.col("label") == 0, "ABSENT ").otherwise("uncertain")
    return B.label_totals(_labelled(spark, d).withColumn("human_label", said), "smell_type")


@bound(f"WITH {_LABELS} SELECT task_id, smell_type, relative_path, doc_id FROM t ORDER BY smell_type, relative_path, doc_id, task_id LIMIT 40")
def tasks_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("project_name", F.lit("p")).withColumn("start_line", F.col("doc_id").cast("string"))
    return B.in_order(rows).limit(40).select("task_id", "smell_type", "relative_path", "doc_id")


@bound("SELECT source AS snippet_path, min(lang) AS snippet FROM (SELECT source, 'x' || source AS lang FROM documents) GROUP BY 1")
def snippets_merged(spark: SparkSession, d: str) -> DataFrame:
    return B.merged(table(spark, d, "documents").select(F.col("source").alias("snippet_path"), F.concat(F.lit("x"), "source").alias("snippet")), "snippet_path", "snippet")


# ---------------------------------------------------------------- runs

_PRED_LIST, _PRED_SQL = columns(
    "task_id: 't' || doc_id", "project: source", "smell_type: CASE WHEN doc_id % 2 = 0 THEN 'long_method' ELSE 'god_class' END", "model: CASE WHEN doc_id % 3 = 0 THEN 'logistic' ELSE 'random_forest' END", "label: quality", "p: floor(n_chars % 997) / 997", "prediction: CAST(floor(n_chars % 997) / 997 >= 0.5 AS INT)",
)
_PRED = f"p AS (SELECT {_PRED_SQL} FROM labels JOIN documents USING (doc_id))"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").selectExpr(*_PRED_LIST)


_CELL = "count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, avg((p - label) * (p - label)) AS brier"
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
_SPEC = "CASE WHEN fp + tn > 0 THEN tn / (fp + tn) END"


@bound(f"""WITH {_PRED}, f AS (SELECT smell_type, model, project, {_CELL} FROM p GROUP BY 1, 2, 3), m AS (SELECT smell_type, model, {_CELL} FROM p GROUP BY 1, 2)
SELECT m.smell_type, m.model, (SELECT count(*) FROM f WHERE f.smell_type = m.smell_type AND f.model = m.model) AS folds, round({_F1}, 6) AS micro_f1, round({_SPEC}, 6) AS micro_specificity, round(brier, 6) AS micro_brier,
 (SELECT round(avg({_F1}), 6) FROM f WHERE f.smell_type = m.smell_type AND f.model = m.model) AS macro_f1, (SELECT round(avg({_SPEC}), 6) FROM f WHERE f.smell_type = m.smell_type AND f.model = m.model) AS macro_specificity, (SELECT round(stddev_samp({_F1}), 6) FROM f WHERE f.smell_type = m.smell_type AND f.model = m.model) AS std_f1 FROM m""")
def logo_micro(spark: SparkSession, d: str) -> DataFrame:
    out = L.aggregate_folds(_predictions(spark, d).withColumnRenamed("project", "held_out_project"))
    return _rounded(out.select("smell_type", "model", "folds", "micro_f1", "micro_specificity", "micro_brier", "macro_f1", "macro_specificity", "std_f1"))


@bound(f"WITH {_PRED}, c AS (SELECT smell_type, {_CELL} FROM p GROUP BY 1) SELECT smell_type, tp + fp + fn + tn AS support, tp + fn AS positives, fp + tn AS negatives, tp + fp AS predicted_positives, round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate, round(brier, 6) AS brier, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def model_measures(spark: SparkSession, d: str) -> DataFrame:
    m = L.measures(_predictions(spark, d), ["smell_type"])
    return _rounded(m.select("smell_type", "support", "positives", "negatives", "predicted_positives", "positive_rate", "brier", "precision", "recall"))


@bound(f"""WITH {_PRED}, s AS (SELECT task_id, smell_type, label, prediction, p, CASE WHEN p >= 0.1 THEN printf('%.12f', p) WHEN p >= 0.01 THEN printf('%.13f', p) WHEN p >= 0.001 THEN printf('%.14f', p) ELSE printf('%.15f', p) END AS t FROM p)
SELECT task_id, smell_type, label, prediction, CASE WHEN p = 0 THEN '0' ELSE regexp_replace(t, '\\.?0+$', '') END AS probability, 'test' AS split, 'h' AS held_out_project, 'logistic' AS model FROM s""".replace("\\\\", "\\"))
def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.prediction_rows(_predictions(spark, d), "test", "h", "logistic").select("task_id", "smell_type", "label", "prediction", "probability", "split", "held_out_project", "model")


@bound(f"WITH {_PRED} SELECT smell_type, count(*) AS predictions, count(*) FILTER (WHERE prediction = 1) AS positive FROM p GROUP BY ROLLUP (smell_type)")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.run_totals(_predictions(spark, d))


@bound(f"""WITH {_PRED}, f AS (SELECT smell_type, model, project, {_CELL} FROM p GROUP BY 1, 2, 3), x AS (SELECT smell_type, model, {_F1} AS f1 FROM f)
SELECT smell_type, model, count(*) AS folds, round(avg(f1), 6) AS macro_f1, round(stddev_samp(f1), 6) AS std_f1, round(1.96 * stddev_samp(f1) / sqrt(count(f1)), 6) AS ci95_f1 FROM x GROUP BY 1, 2""")
def research_folds(spark: SparkSession, d: str) -> DataFrame:
    folds = L.measures(_predictions(spark, d), ["smell_type", "model", "project"])
    return _rounded(W.fold_summary(folds).select("smell_type", "model", "folds", "macro_f1", "std_f1", "ci95_f1"))


_MEAN, _SD, _COEF = [0.1, -0.2, 0.05, 0.0], [1.5, 0.5, 0.0, 2.0], [1.0, -2.0, 3.0, 0.5]


@bound(f"""WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), v AS (SELECT vec_id, (i - 1) % 4 AS f, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY 1, 2),
w AS (SELECT vec_id, f, x, CASE WHEN ({_SD})[f + 1] = 0 THEN 0 ELSE (x - ({_MEAN})[f + 1]) / ({_SD})[f + 1] * ({_COEF})[f + 1] END AS c FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, f) AS rank, 0.25 + sum(c) OVER (PARTITION BY vec_id) AS output FROM w)
SELECT vec_id, 'f' || f AS feature, round(x, 6) AS raw_value, round(c, 6) AS contribution, CASE WHEN c >= 0 THEN 'increases_smell_risk' ELSE 'decreases_smell_risk' END AS direction, CAST(rank AS INT) AS rank, round(output, 6) AS output_value FROM r WHERE rank <= 2""")
def linear_explanations(spark: SparkSession, d: str) -> DataFrame:
    # a vector's means over every fourth of its values are the features
    e = table(spark, d, "embeddings")
    n = F.size("embedding")
    mean = lambda k: F.aggregate(F.filter("embedding", lambda _, i: i % 4 == k), F.lit(0.0), lambda s, x: s + x.cast("double")) / F.ceil((n - k) / 4)
    e = e.select("vec_id", F.array(*[mean(k) for k in range(4)]).alias("x"))
    got = X.linear(F.col("x"), _MEAN, _SD, _COEF, 0.25)
    e = e.withColumn("c", got["contributions"]).withColumn("output_value", F.round(got["output"], 6))
    t = e.select("vec_id", "output_value", F.explode(X.ranked(["f0", "f1", "f2", "f3"], F.col("x"), F.col("c"), 2)).alias("t")).select("vec_id", "output_value", "t.*")
    return t.select("vec_id", "feature", F.round("raw_value", 6).alias("raw_value"), F.round("contribution", 6).alias("contribution"), "direction", "rank", "output_value")


@bound("""WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'god_class' WHEN 'click' THEN 'deep_nesting' ELSE 'dead_code' END AS s, value % 1 AS p FROM events)
SELECT event_id, CASE s WHEN 'god_class' THEN 'Give the class one responsibility' WHEN 'deep_nesting' THEN 'Flatten the control flow' ELSE 'Look at what weighs most' END AS title, CASE WHEN p >= 0.85 THEN 'high' WHEN p >= 0.65 THEN 'medium' ELSE 'low' END AS priority, 3 AS n_actions, 3 AS n_checks, 'loc' AS metric, CASE WHEN isnan(p) THEN NULL ELSE p END AS value FROM e""")
def recommendation_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.expr("CASE event_type WHEN 'error' THEN 'god_class' WHEN 'click' THEN 'deep_nesting' ELSE 'dead_code' END").alias("smell_type"), (F.col("value") % 1).alias("probability"))
    top = X.ranked(["feature__loc"], F.array("probability"), F.array("probability"), 8)
    out = X.recommendations(e.withColumn("top_features", top))
    return out.select("event_id", "title", "priority", F.size("actions").alias("n_actions"), F.size("validation_steps").alias("n_checks"), F.get("evidence", 0)["metric"].alias("metric"), F.get("evidence", 0)["value"].alias("value"))


# ---------------------------------------------------------------- result lists, jobs

_REC = "SELECT event_id AS recommendation_id, CASE WHEN value % 1 >= 0.85 THEN 'high' WHEN value % 1 >= 0.65 THEN 'medium' ELSE 'low' END AS priority FROM events"


def _recommended(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("recommendation_id"), E.priority(F.col("value") % 1).alias("priority"))


@bound(f"SELECT * FROM ({_REC}) ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, recommendation_id LIMIT 50 OFFSET 20")
def recommendations_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return Q.listed(_recommended(spark, d), "recommendations", 50, 20)[0]


@bound(f"SELECT * FROM ({_REC}) ORDER BY priority DESC, recommendation_id LIMIT 50")
def recommendations_by_text(spark: SparkSession, d: str) -> DataFrame:
    return Q.listed(_recommended(spark, d), "recommendations", 50, ranks=False)[0]


@bound("SELECT event_id AS prediction_id, value AS probability FROM events ORDER BY value DESC, event_id LIMIT 100 OFFSET 5")
def predictions_listed(spark: SparkSession, d: str) -> DataFrame:
    return Q.listed(table(spark, d, "events").select(F.col("event_id").alias("prediction_id"), F.col("value").alias("probability")), "predictions", 100, 5)[0]


@bound(f"WITH {JOBS} SELECT job_id, status FROM j WHERE status = 'failed' ORDER BY queued_at DESC, job_id LIMIT 30")
def jobs_listed(spark: SparkSession, d: str) -> DataFrame:
    return J.selected(_jobs(spark, d), status="failed").limit(30).select("job_id", "status")


@bound("SELECT l_orderkey AS explanation_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def explanations_of_job(spark: SparkSession, d: str) -> DataFrame:
    ex = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("prediction_id"), "l_linenumber", "l_quantity")
    got = Q.explanations_of(ex, table(spark, d, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_custkey").alias("job_id")), 7)
    return got.withColumnRenamed("prediction_id", "explanation_id")


@bound("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def rows_within(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return Q.within(table(spark, d, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@bound("""WITH c AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 211 = 0 GROUP BY 1), s AS (SELECT *, greatest(15, CAST(floor(98 - 1.8 * n - 3.5 * high + 0.5) AS BIGINT)) AS score FROM c)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s""")
def analysis_health(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 211 = 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return Q.analysis_health(o.withColumn("p", F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low")), "c_mktsegment", "p")


@bound("SELECT r AS role, count(c_custkey) AS n, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS enabled FROM (VALUES ('admin'), ('analyst'), ('viewer')) v(r) LEFT JOIN customer ON r = CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'analyst' ELSE 'other' END GROUP BY 1")
def users_by_role(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("c_custkey") % 50 == 0, "admin").when(F.col("c_custkey") % 3 == 0, "analyst").otherwise("other")
    return Q.by_role(table(spark, d, "customer").select(role.alias("role"), (F.col("c_acctbal") > 0).alias("enabled")))


@bound("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 4 <> 1 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 4 <> 1")
def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    tables = {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders")}
    doomed = tables["customer"].where("c_custkey % 4 = 1").select("c_custkey")
    left = Q.guarded_delete(tables, "customer", doomed, "c_custkey", {"orders": "o_custkey"})
    return left["orders"].agg(F.lit("orders").alias("name"), F.count(F.lit(1)).alias("n")).union(left["customer"].agg(F.lit("customer"), F.count(F.lit(1))))


@bound("SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN false ELSE s_acctbal > 0 END AS enabled FROM supplier")
def models_updated(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") > 0).alias("enabled"))
    return Q.patched(s, F.col("s_nationkey") == 7, {"enabled": F.lit(False)}).select("s_suppkey", "enabled")


@bound("SELECT 'j' || o_orderkey AS job_id, 'c' || o_custkey AS project_id, 'hybrid' AS kind, 'queued' AS status, 0 AS attempts, 5 AS max_attempts, false AS cancelled FROM orders WHERE o_orderstatus = 'P'")
def jobs_enqueued(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project_id"), F.lit("hybrid").alias("kind"))
    jobs, _ = J.enqueue(spark.createDataFrame([], J.JOBS), spark.createDataFrame([], J.EVENTS), wanted, F.to_timestamp(F.lit(CUTOFF)), 5)
    return jobs.select("job_id", "project_id", "kind", "status", "attempts", "max_attempts", "cancelled")


@bound(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' AND attempts = 2 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND attempts = 2 THEN 'too_slow' END AS error_code FROM j")
def jobs_failed(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    jobs = _jobs(spark, d).withColumns({"message": none, "error_code": none, "error_message": none, "completed_at": F.lit(None).cast("timestamp")})
    return J.ended(jobs, F.expr("status = 'running' and attempts = 2"), "failed", F.to_timestamp(F.lit(CUTOFF)), F.lit("too_slow"), F.lit("x")).select("job_id", "status", "error_code")


@bound(f"WITH {ENTITIES}, {FOUND} SELECT smell, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, smell LIMIT 2")
def dashboard_smells(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(_findings(spark, d), "smell", 2)


@bound("SELECT user_id AS project_id, count(*) AS n FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'other' END AS status FROM events) WHERE status IN ('queued', 'running') GROUP BY 1")
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("other").alias("status"))
    return Q.active(e)
