"""Lookups in an analysis: entities by name, their facts, who refers to a class, a module's imports (LKP-3, LKP-4).

Each takes the keys that are wanted as rows and answers all of them with one equi-join, so a lookup of many entities is
one job, and nothing is built for the entities that nobody asks about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph as G


def by_qualified_name(wanted: DataFrame, entities: DataFrame, order: str, scope: str = "project", name: str = "qualified_name") -> DataFrame:
    """wanted (scope, qualified_name) with the entity_id of that name, the last definition where there are several; null where
    there is none."""
    keyed = entities.select(scope, name, "entity_id", order).withColumn("_k", F.struct(scope, name))
    last = G.keep_wins(keyed, "_k", order).select(scope, name, "entity_id")
    return wanted.select(scope, name).distinct().join(last, [scope, name], "left")


def facts_of(wanted: DataFrame, facts: DataFrame, key: str = "entity_id") -> DataFrame:
    """wanted (key) with their facts; an entity without any has empty arrays and maps, and null for single values."""
    out = wanted.select(key).distinct().join(facts, key, "left")
    empty = {"array": F.array, "map": F.create_map}
    kinds = {f.name: (f.dataType.typeName(), f.dataType.simpleString()) for f in facts.schema if f.name != key}
    return out.select(key, *[F.coalesce(F.col(c), empty[t]().cast(ddl)).alias(c) if t in empty else F.col(c) for c, (t, ddl) in kinds.items()])


def referencing_classes(wanted: DataFrame, uses: DataFrame, names: DataFrame) -> DataFrame:
    """(dst, src) of the classes src whose uses (src, name) mean a wanted class dst by its name (dst, name), itself left out.

    Only the wanted classes' names meet the uses: edges of other classes are never made.
    """
    return G.reference_edges(uses, names.join(wanted.select("dst").distinct(), "dst", "left_semi")).select("dst", "src")


def imports_for(wanted: DataFrame, entities: DataFrame, imports: DataFrame, module: str = "path") -> DataFrame:
    """(entity_id, imports): the bindings (alias to origin, of imports by module) that wanted entities see; of an alias that is
    bound twice the last origin by name; an empty map where the module imports nothing."""
    one = imports.groupBy(module, "alias").agg(F.max("origin").alias("origin"))
    bound = one.groupBy(module).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "origin")))).alias("imports"))
    seen = wanted.select("entity_id").distinct().join(entities.select("entity_id", module), "entity_id").join(bound, module, "left")
    return seen.select("entity_id", F.coalesce("imports", F.create_map().cast(bound.schema["imports"].dataType)).alias("imports"))


def classes_named(wanted: DataFrame, classes: DataFrame, scope: str = "project") -> DataFrame:
    """(scope, name, entity_id) of every class with a wanted simple name, repeated names with all of theirs (LKP-4)."""
    return wanted.select(scope, "name").distinct().join(classes.select(scope, "name", "entity_id").distinct(), [scope, "name"])
