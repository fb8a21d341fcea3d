"""Cross-entity metrics over edges (GRA-1..14, LKP-3, LKP-4)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def keep_wins(rows: DataFrame, key: str, order: str, last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) in order (GRA-1, SET-3)."""
    w = W.partitionBy(key).orderBy(F.col(order).desc() if last else F.col(order).asc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _only(classes: DataFrame, *keys: str) -> DataFrame:
    """Classes that are alone with their keys."""
    return classes.groupBy(*keys).agg(F.min("entity_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def resolve_classes(uses: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds target to uses (project, name, module, origin): the class that a name means, or null (GRA-2).

    classes: project, entity_id, name, qualified_name, module. In turn: a class of the same module, the class that an
    import binds (by qualified name, else by the only class with the origin's last part), the only class of that name.
    """
    here = classes.groupBy("project", "module", "name").agg(F.min("entity_id").alias("t1"))
    exact = classes.groupBy("project", F.col("qualified_name").alias("origin")).agg(F.min("entity_id").alias("t2"))
    single = _only(classes, "project", "name")
    tail = F.element_at(F.split("origin", r"\."), -1)
    out = uses.join(here, ["project", "module", "name"], "left").join(exact, ["project", "origin"], "left")
    out = out.withColumn("_tail", tail).join(single.select("project", F.col("name").alias("_tail"), F.col("target").alias("t3")), ["project", "_tail"], "left")
    out = out.join(single.select("project", "name", F.col("target").alias("t4")), ["project", "name"], "left")
    return out.withColumn("target", F.coalesce("t1", "t2", "t3", "t4")).drop("t1", "t2", "t3", "t4", "_tail")


def priority_lookup(left: DataFrame, key: str, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Adds found: the value of the first table (frame, key, value) that knows the key; keys are unique in each."""
    out, names = left, []
    for i, (frame, k, value) in enumerate(tables):
        names.append(f"_v{i}")
        out = out.join(frame.select(F.col(k).alias(key), F.col(value).alias(names[-1])), key, "left")
    return out.withColumn("found", F.coalesce(*names)).drop(*names)


def _grown(pairs: DataFrame, measure: list) -> tuple[DataFrame, tuple]:
    """pairs (src, dst, d) with every two joined end to end, the longest kept, and what measure says of them."""
    ahead = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("d").alias("more"))
    longer = pairs.join(ahead, "dst").select("src", F.col("to").alias("dst"), (F.col("d") + F.col("more")).alias("d"))
    out = pairs.union(longer).groupBy("src", "dst").agg(F.max("d").alias("d")).checkpoint()
    return out, tuple(out.agg(*measure).first())


def reachable(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of edges (src, dst) from one to the other; each round doubles the paths' length."""
    pairs = edges.select("src", "dst").distinct().withColumn("d", F.lit(0).cast("bigint"))
    before = None
    while True:
        pairs, now = _grown(pairs, [F.count(F.lit(1))])
        if now == before:
            return pairs.select("src", "dst")
        before = now


def longest_paths(edges: DataFrame) -> DataFrame | None:
    """(src, dst, d): the longest path of weighted edges (src, dst, d) from one to the other; None where there is a cycle.

    A round doubles the length of the paths that it knows, so there are at most log2 of the longest, and one to see the end.
    """
    pairs, before = edges.groupBy("src", "dst").agg(F.max("d").cast("bigint").alias("d")), None
    while True:
        pairs, now = _grown(pairs, [F.count(F.lit(1)), F.sum("d"), F.count_if(F.col("src") == F.col("dst"))])
        if now[2]:
            return None
        if now == before:
            return pairs
        before = now


def inheritance_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, dit): longest path up the edges (child, parent) (GRA-4).

    Classes that inherit from one another are one component: from a component of n classes a path visits all n and goes
    on to a parent outside, or comes back once where there is none. So the classes of a cycle of n have depth n, a self
    edge counts 1, and depths neither depend on an order nor need a limit. Without cycles the components are the classes.
    Paths are doubled each round; what is held is each class with its ancestors.
    """
    proper = edges.where("child <> parent").select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    loops = edges.where("child = parent").select(F.col("child").alias("src")).distinct()
    paths = longest_paths(proper.withColumn("d", F.lit(1)))
    if paths is None:
        reach = reachable(proper)
        mutual = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
        parts = mutual.groupBy("src").agg(F.min("dst").alias("c")).checkpoint()
        sizes = parts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        up = _mapped(_mapped(proper, parts, "src"), parts, "dst").where("src <> dst").distinct()
        paths = longest_paths(up.join(sizes.withColumnRenamed("c", "src"), "src", "left").select("src", "dst", F.coalesce("n", F.lit(1)).alias("d")))
        rings = sizes.select(F.col("c").alias("src"), "n").union(loops.join(parts, "src", "left_anti").select("src", F.lit(1).cast("bigint")))
    else:
        parts, up = None, proper
        rings = loops.select("src", F.lit(1).cast("bigint").alias("n"))
    # a component that is a cycle without a way out comes back once
    ends = rings.join(up.select("src").distinct(), "src", "left_anti")
    whole = paths.join(ends.withColumnRenamed("src", "dst"), "dst", "left").select("src", (F.col("d") + F.coalesce("n", F.lit(0))).alias("d"))
    best = whole.union(ends.select("src", "n")).groupBy("src").agg(F.max("d").alias("dit"))
    of = nodes.select("node", F.col("node").alias("src"))
    of = _mapped(of, parts, "src") if parts is not None else of
    return of.join(best, "src", "left").select("node", F.coalesce("dit", F.lit(0)).cast("bigint").alias("dit"))


def _mapped(rows: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """rows with the component in place of each class of a column that is in one."""
    to = parts.select(F.col("src").alias("_class"), F.col("c").alias("_component"))
    out = rows.join(to, rows[name] == to["_class"], "left").withColumn(name, F.coalesce("_component", F.col(name)))
    return out.drop("_class", "_component")


def children_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, noc): subclass edges of each node, repeated ones counted (GRA-5)."""
    n = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("noc"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("noc", F.lit(0)).cast("bigint").alias("noc"))


def reference_edges(uses: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (src, dst): uses (src, name) met with every class (dst, name) of that name, itself left out (GRA-6).

    Classes of the same names are one group: users meet groups, each once, and a group's classes take their places in the last
    join. So the edges, of which there may be as many as pairs of classes, are neither shuffled nor held.
    """
    groups = names.where("dst is not null and name is not null").groupBy("dst").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    met = groups.select("_names", F.explode("_names").alias("name")).distinct()
    users = uses.select("src", "name").distinct().join(met, "name").select("_names", "src").distinct()
    return users.join(groups, "_names").where("src <> dst").select("src", "dst")


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cbo, fan_out, fan_in) from (src, dst) edges (GRA-7, GRA-8)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("cbo"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))
    zero = F.lit(0).cast("bigint")
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("cbo", zero).alias("cbo"), F.coalesce("cbo", zero).alias("fan_out"), F.coalesce("fan_in", zero).alias("fan_in"))


def coupling_by_name(nodes: DataFrame, uses: DataFrame, names: DataFrame) -> DataFrame:
    """(node, cbo, fan_out, fan_in) from uses (src, name) and the classes' names (dst, name), one for each class (GRA-6 to 8).

    The edges are all users of a name with all classes of that name, and never made: cbo sums over a class's used names
    how many classes each has, fan_in counts the users of the class's own name, and either leaves out the class itself.
    So a name with very many classes and users costs as many rows as it has classes and users.
    """
    names = names.select("dst", "name").distinct()
    used = uses.select("src", "name").distinct()
    own = names.select(F.col("dst").alias("src"), "name", F.lit(1).alias("own"))
    classes = names.groupBy("name").agg(F.count(F.lit(1)).alias("classes"))
    met = used.join(classes, "name").join(own, ["src", "name"], "left")
    out = met.groupBy(F.col("src").alias("node")).agg((F.sum("classes") - F.count("own")).alias("cbo"))
    users = used.groupBy("name").agg(F.count(F.lit(1)).alias("users"))
    itself = used.select(F.col("src").alias("dst"), "name", F.lit(1).alias("own"))
    into = names.join(users, "name").join(itself, ["dst", "name"], "left").select(F.col("dst").alias("node"), (F.col("users") - F.coalesce("own", F.lit(0))).alias("fan_in"))
    zero = F.lit(0).cast("bigint")
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("cbo", zero).alias("cbo"), F.coalesce("cbo", zero).alias("fan_out"), F.coalesce("fan_in", zero).alias("fan_in"))


def method_totals(classes: DataFrame, methods: DataFrame, owner: str, complexity: str) -> DataFrame:
    """Per class of classes(owner): wmc, number_of_methods and the average; without methods 0 (GRA-9, GRA-10)."""
    m = methods.groupBy(owner).agg(F.sum(complexity).alias("wmc"), F.count(F.lit(1)).alias("number_of_methods"))
    n = F.coalesce("number_of_methods", F.lit(0)).cast("bigint")
    return classes.join(m, owner, "left").select(owner, F.coalesce(F.col("wmc").cast("double"), F.lit(0.0)).alias("wmc"), n.alias("number_of_methods"), F.when(n > 0, F.col("wmc") / n).otherwise(0.0).alias("average_method_complexity"))


def response(calls: DataFrame, owner: str, method: str, called: str) -> DataFrame:
    """(owner, rfc): methods and distinct called names (GRA-11)."""
    return calls.groupBy(owner).agg((F.countDistinct(method) + F.countDistinct(called)).alias("rfc"))


#: Pairs of methods that are compared at once.
PAIRS = 1 << 22


@F.pandas_udf(LongType())
def _sharing(classes: pd.Series) -> pd.Series:
    """Pairs of field sets of a class that have a field in common: equal sets once with their number, as rows of a bitmap."""

    def pairs(methods) -> int:
        sets = Counter(frozenset(m) for m in methods if len(m))
        at = {f: i for i, f in enumerate(sorted(set().union(*sets)))}
        n = np.array(list(sets.values()), np.int64)
        bits = np.zeros((len(sets), len(at)), np.float32)
        for row, fields in zip(bits, sets, strict=True):
            row[[at[f] for f in fields]] = 1
        step, shared = max(1, PAIRS // max(1, len(bits))), 0
        for i in range(0, len(bits), step):
            met = bits[i : i + step] @ bits.T > 0
            shared += int(n[i : i + step] @ (met @ n))
        return (shared - int(n.sum())) // 2  # both orders, and each method with itself

    return classes.map(pairs)


def lcom1(methods: DataFrame, owner: str, method: str, fields: str) -> DataFrame:
    """(owner, lcom1) from methods with their field arrays: disjoint pairs less sharing pairs, not below 0 (GRA-12).

    A class becomes one row of its methods' field sets, bounded by its source file; pairs are counted by products of
    bitmaps, a bounded block at a time, and never become rows.
    """
    m = methods.groupBy(owner).agg(F.collect_list(F.array_compact(F.coalesce(fields, F.array()))).alias("_f"))
    n = F.size("_f")
    pairs = (n.cast("bigint") * (n - 1) / 2).cast("bigint")
    named = F.transform("_f", lambda fs: F.transform(fs, lambda f: f.cast("string")))
    return m.select(owner, F.greatest(pairs - 2 * _sharing(named), F.lit(0)).cast("bigint").alias("lcom1"))


def lcom_hs(methods: DataFrame, declared: DataFrame, owner: str, method: str, fields: str, field: str) -> DataFrame:
    """(owner, lcom_hs): (mean accesses of a declared field - m) / (1 - m) in 0..1; 0 for one method or no fields (GRA-13)."""
    m = methods.groupBy(owner).agg(F.count(F.lit(1)).alias("m"))
    used = methods.select(owner, F.explode(F.array_distinct(fields)).alias(field))
    hits = declared.select(owner, field).distinct().join(used.groupBy(owner, field).agg(F.count(F.lit(1)).alias("a")), [owner, field], "left")
    mean = hits.groupBy(owner).agg(F.avg(F.coalesce("a", F.lit(0))).alias("mean"))
    value = (F.col("mean") - F.col("m")) / F.when(F.col("m") > 1, 1 - F.col("m"))
    return m.join(mean, owner, "left").select(owner, F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0).alias("lcom_hs"))
