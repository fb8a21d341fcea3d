"""Operators over graphs, thresholds and models bound to the testdata tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import attribution as T
from quarry.operators import context as C
from quarry.operators import graph as G
from quarry.operators import query as Q
from quarry.plans.bindings import bound
from quarry.session import ensure_checkpoint_dir, table

# ---------------------------------------------------------------- graphs


@bound("""WITH RECURSIVE e AS (
  SELECT DISTINCT conv_id * 100 + turn AS child, conv_id * 100 + turn - 1 AS parent FROM conversations WHERE turn > 0
  UNION SELECT DISTINCT conv_id * 100, conv_id * 100 + conv_id % 4 FROM conversations WHERE conv_id % 3 = 0 AND conv_id * 100 + conv_id % 4 IN (SELECT conv_id * 100 + turn FROM conversations)
  UNION SELECT DISTINCT conv_id * 100 + 1, conv_id * 100 - 100 FROM conversations WHERE conv_id % 3 = 1 AND turn = 1),
r AS (SELECT child AS a, parent AS b FROM e UNION SELECT r.a, e.parent FROM r JOIN e ON r.b = e.child),
n AS (SELECT DISTINCT conv_id * 100 + turn AS node FROM conversations),
c AS (SELECT node, coalesce(min(x.b), node) AS c, greatest(count(x.b), 1) AS size, count(x.b) AS ring FROM n LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON x.a = node GROUP BY node),
u AS (SELECT DISTINCT a.c, b.c AS up, a.size FROM e JOIN c a ON a.node = e.child JOIN c b ON b.node = e.parent WHERE a.c <> b.c),
w AS (SELECT c AS a, up AS b, size AS d FROM u UNION SELECT w.a, u.up, w.d + u.size FROM w JOIN u ON w.b = u.c),
last AS (SELECT DISTINCT c, size FROM c WHERE ring > 0 AND c NOT IN (SELECT c FROM u)),
best AS (SELECT a AS c, max(d + coalesce(size, 0)) AS d FROM w LEFT JOIN last ON last.c = w.b GROUP BY 1 UNION ALL SELECT c, size FROM last)
SELECT node, CAST(coalesce(max(d), 0) AS BIGINT) AS dit FROM c LEFT JOIN best ON best.c = c.c GROUP BY 1""")
def inheritance_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Chains of turns; every third has an edge back (or to itself), every third goes on to the one before."""
    ensure_checkpoint_dir(spark)
    t = table(spark, d, "conversations").select("conv_id", "turn")
    c = t.select((F.col("conv_id") * 100 + F.col("turn")).alias("node")).distinct()
    first, own = F.col("conv_id") * 100, F.col("conv_id") % 3
    down = t.where("turn > 0").select((first + F.col("turn")).alias("child"), (first + F.col("turn") - 1).alias("parent"))
    back = t.where(own == 0).select(first.alias("child"), (first + F.col("conv_id") % 4).alias("parent")).join(c.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")
    on = t.where((own == 1) & (F.col("turn") == 1)).select((first + 1).alias("child"), (first - 100).alias("parent"))
    return G.inheritance_depth(c, down.union(back).union(on))


# ---------------------------------------------------------------- lookups


@bound("SELECT c_nationkey AS project, CAST(c_custkey % 50 AS VARCHAR) AS qualified_name, max(c_custkey) FILTER (WHERE c_custkey % 3 > 0) AS entity_id FROM customer GROUP BY 1, 2")
def entity_by_qualified_name(spark: SparkSession, d: str) -> DataFrame:
    """Names that are defined several times, some of them never."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("project"), (F.col("c_custkey") % 50).cast("string").alias("qualified_name"), F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("seq"))
    return C.by_qualified_name(c, c.where("entity_id % 3 > 0"), "seq")


@bound("""WITH f AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS l, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT c_custkey AS entity_id, coalesce(array_to_string(l, ','), '') AS called, n FROM customer LEFT JOIN f ON c = c_custkey WHERE c_custkey % 5 = 0""")
def facts_lookup(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").where("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("called"), F.count(F.lit(1)).alias("n"))
    wanted = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("entity_id"))
    return C.facts_of(wanted, facts).select("entity_id", F.array_join("called", ",").alias("called"), "n")


@bound("SELECT DISTINCT s_suppkey AS dst, l_suppkey AS src FROM lineitem JOIN supplier ON s_suppkey % 37 = l_partkey % 211 WHERE s_suppkey % 10 = 3 AND l_suppkey <> s_suppkey")
def referencing_classes(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), (F.col("s_suppkey") % 37).alias("name"))
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 211).alias("name"))
    return C.referencing_classes(names.where("dst % 10 = 3"), uses, names)


@bound("""WITH i AS (SELECT path, string_agg(alias || '=' || origin, ',' ORDER BY alias) AS said FROM (SELECT s_nationkey AS path, 'a' || s_suppkey % 4 AS alias, max(s_name) AS origin FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1, 2) GROUP BY 1)
SELECT c_custkey AS entity_id, coalesce(said, '') AS said FROM customer LEFT JOIN i ON path = c_nationkey WHERE c_custkey % 4 = 1""")
def imports_lookup(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("path"))
    imports = table(spark, d, "supplier").where("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("path"), F.concat(F.lit("a"), (F.col("s_suppkey") % 4).cast("string")).alias("alias"), F.col("s_name").alias("origin"))
    said = F.array_join(F.transform(F.map_entries("imports"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return C.imports_for(entities.where("entity_id % 4 = 1"), entities, imports).select("entity_id", said.alias("said"))


@bound("SELECT DISTINCT c_nationkey AS project, c_mktsegment AS name, c_custkey AS entity_id FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 40 = 0)")
def classes_named(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("entity_id"))
    return C.classes_named(classes.where("entity_id % 40 = 0"), classes)


@bound("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def keys_in_both(spark: SparkSession, d: str) -> DataFrame:
    return Q.in_both(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), "id")


@bound("SELECT s_suppkey AS id FROM supplier UNION SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0")
def keys_in_either(spark: SparkSession, d: str) -> DataFrame:
    return Q.in_either(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id")), "id")


# ---------------------------------------------------------------- tree attributions

#: A small ensemble over quantity, discount and tax; the second tree splits on discount twice.
FOREST = T.Ensemble(
    (
        (0.5, T.Split(0, 25.0, T.Split(1, 0.05, T.Leaf(0.21, 31), T.Leaf(0.63, 19)), T.Split(2, 0.04, T.Leaf(0.47, 23), T.Leaf(0.91, 28)))),
        (0.5, T.Split(1, 0.03, T.Split(0, 10.0, T.Leaf(0.13, 11), T.Split(1, 0.01, T.Leaf(0.29, 17), T.Leaf(0.43, 22))), T.Leaf(0.71, 53))),
    )
)
FEATURES = ("l_quantity", "l_discount", "l_tax")


def _known(node: T.Split | T.Leaf, subset: frozenset[int]) -> str:
    """SQL of a tree's mean over the features outside the subset."""
    if isinstance(node, T.Leaf):
        return repr(node.value) + "::DOUBLE"
    left, right = _known(node.left, subset), _known(node.right, subset)
    if node.feature in subset:
        return f"CASE WHEN {FEATURES[node.feature]}::DOUBLE <= {node.threshold}::DOUBLE THEN {left} ELSE {right} END"
    return f"(({node.left.count}::DOUBLE * {left} + {node.right.count}::DOUBLE * {right}) / {node.count}::DOUBLE)"


def _shapley_sql() -> str:
    """By enumeration: the values of all subsets, then each feature's weighted differences."""
    n = len(FEATURES)
    subsets = [frozenset(s) for k in range(n + 1) for s in combinations(range(n), k)]
    name = lambda s: "v" + "".join(map(str, sorted(s)))
    values = ", ".join(f"{' + '.join(f'{w} * {_known(t, s)}' for w, t in FOREST.trees)} AS {name(s)}" for s in subsets)
    parts = [" + ".join(f"{factorial(len(s)) * factorial(n - 1 - len(s))} / {factorial(n)}.0 * ({name(s | {i})} - {name(s)})" for s in subsets if i not in s) for i in range(n)]
    return f"""WITH v AS (SELECT l_orderkey, l_linenumber, {values} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(f"round({p}, 6) + 0.0 AS {f[2:]}" for f, p in zip(FEATURES, parts, strict=True))}, round(v, 6) AS base, round({name(subsets[-1])}, 6) AS output FROM v"""


@bound(_shapley_sql())
def tree_shapley(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
    out = T.explained(rows, F.col("x"), FOREST, len(FEATURES))
    return out.select("l_orderkey", "l_linenumber", *[(F.round(F.col("contributions")[i], 6) + 0.0).alias(f[2:]) for i, f in enumerate(FEATURES)], F.round("base", 6).alias("base"), F.round("output", 6).alias("output"))
