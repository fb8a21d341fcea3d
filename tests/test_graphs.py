"""Depths over cycles and long chains, coupling without edges, lookups by name."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def depths(spark, edges, nodes=None):
    nodes = nodes or sorted({x for e in edges for x in e})
    got = G.inheritance_depth(spark.createDataFrame([(n, "x", 0) for n in nodes], "node long, src string, d int"), spark.createDataFrame(edges, "child long, parent long"))
    return {r.node: r.dit for r in got.collect()}


def brute(edges):
    """Components by mutual reachability, then the longest way through them, all n classes of each."""
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    while True:
        more = {n: reach[n] | {c for b in reach[n] for c in reach[b]} for n in nodes}
        if more == reach:
            break
        reach = more
    part = {n: frozenset([n]) | {m for m in reach[n] if n in reach[m]} for n in nodes}

    def depth(p):
        out = {part[b] for a, b in edges if a in p and part[b] != p}
        ring = any(n in reach[n] for n in p)
        return len(p) + max(map(depth, out)) if out else len(p) if ring else 0

    return {n: depth(part[n]) for n in nodes}


def test_a_cycle_of_two_with_a_third_above(spark):
    assert depths(spark, [(1, 2), (2, 1), (3, 1)]) == {1: 2, 2: 2, 3: 3}
    assert depths(spark, [(1, 1), (2, 1)]) == {1: 1, 2: 2}
    assert depths(spark, [(1, 2), (1, 2)], [1, 2, 9]) == {1: 1, 2: 0, 9: 0}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(26)]
    assert depths(spark, edges) == brute(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    grown = G._grown
    monkeypatch.setattr(G, "_grown", lambda *a: rounds.append(1) or grown(*a))
    got = depths(spark, [(i + 1, i) for i in range(100)])
    assert got == {i: i for i in range(101)} and len(rounds) <= 8


def test_no_classes_at_all(spark):
    none = spark.createDataFrame([], "child long, parent long")
    assert G.inheritance_depth(spark.createDataFrame([], "node long"), none).count() == 0


def test_coupling_equals_that_of_edges(spark):
    rng = random.Random(1)
    uses = spark.createDataFrame([(rng.randrange(30), rng.choice("abcdefgh")) for _ in range(120)] + [(1, None)], "src long, name string")
    names = spark.createDataFrame([(i, "abcdexyz"[i % 8]) for i in range(40)], "dst long, name string")
    nodes = spark.range(45).withColumnRenamed("id", "node")
    want = G.coupling(nodes, G.reference_edges(uses, names))
    assert sorted(G.coupling_by_name(nodes, uses, names).collect()) == sorted(want.collect())


def test_a_name_of_a_hundred_thousand_classes_and_users(spark):
    n = 100_000
    every = spark.range(n)
    got = G.coupling_by_name(every.withColumnRenamed("id", "node"), every.select(F.col("id").alias("src"), F.lit("Node").alias("name")), every.select(F.col("id").alias("dst"), F.lit("Node").alias("name")))
    assert got.agg(F.min("cbo"), F.max("cbo"), F.min("fan_in"), F.max("fan_in"), F.count("*")).first()[:] == (n - 1, n - 1, n - 1, n - 1, n)
