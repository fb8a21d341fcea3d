"""Operator 5: near duplicates by universal hash minima, banding, verification and connected components.

Copies with the same set of shingles collapse into a class first; classes are the nodes. A signature of 128
minima is cut into 32 bands of 4, which misses a pair at similarity 0.75 with probability below 1e-5. Within a
bucket every class is compared with the bucket's most central class (a star), components are formed, and only pairs
of a bucket that are still in different components are compared with one another. Signatures and bitmaps of the
sets discard pairs below the threshold inside the join; every link is confirmed on the full sets.

Classes have numbers of their own, so texts that share a doc_id stay apart until the result is made. Classes that
hold many rows are met by broadcast and the others by a shuffled join, so no key gathers many rows in a task.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its own
component; a text of fewer words than a shingle is one shingle; repeated rows get the same component; rows that
share a doc_id count as one document with one component in near_duplicates, while drop_duplicates judges each text
of such a document by itself, so that none that is alone of its kind goes; a row without doc_id has no component
and is kept; an empty table gives an empty table; extra columns are ignored (near_duplicates) or carried through
(drop_duplicates).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, drop_table, fresh, join_groups, read, text_of, written
from quarry.llm.components import components

SHINGLE = 5
THRESHOLD_PERCENT = 75
MINIMA = 128
ROWS_PER_BAND = 4
#: Low bits of every minimum that the signature keeps.
SIGNATURE_BITS = 4
#: Pairs with fewer equal signature places are discarded unread: 4.5 standard deviations below what 0.75 gives.
LEAST_EQUAL = 76
#: Bits of a set's bitmap. Bits that differ are at most as many as members that differ, so this test loses nothing.
BITMAP = 1024
CACHED_WORDS = 300_000
#: Shingles hashed at once; bounds a worker's memory.
BLOCK = 1 << 16

_rng = np.random.default_rng(20240531)
_A = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_C = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, cache: WordHash, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; bytes.lower and bytes.split treat ASCII only, as the contract."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        out += h[j : j + n] * _C[j]
    return np.unique(mixed(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MINIMA 32-bit minima for each set; no set is empty."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    x = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    t = np.empty_like(x)
    for i in range(MINIMA):
        np.multiply(x, _A[i], out=t)
        np.add(t, _B[i], out=t)
        out[:, i] = np.minimum.reduceat(t, at) >> np.uint64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()

    def rows(ids: list, keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list = [None] * len(sets)
        bands: list = [[]] * len(sets)
        if full:
            made = signatures([sets[i] for i in full])
            cut = made.reshape(len(full), MINIMA // ROWS_PER_BAND, ROWS_PER_BAND).astype(np.uint64)
            key = np.arange(cut.shape[1], dtype=np.uint64)[None, :] * _C[9]
            for j in range(ROWS_PER_BAND):
                key = mixed(key + cut[:, :, j] * _C[10 + j])
            low = (made & np.uint32((1 << SIGNATURE_BITS) - 1)).astype(np.uint8)
            packed = ((low[:, ::2] << np.uint8(SIGNATURE_BITS)) | low[:, 1::2]).view(np.int64)
            for i, s, b in zip(full, packed, key.view(np.int64), strict=True):
                bits = np.zeros(BITMAP, np.uint8)
                bits[sets[i] % np.uint64(BITMAP)] = 1
                sig[i], bands[i] = np.concatenate([s, np.packbits(bits).view(np.int64)]), b
        fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "fp", "sig", "bands"])

    for batch in batches:
        ids, keys, sets, size = [], [], [], 0
        for i, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ids.append(i)
            keys.append(key)
            sets.append(shingle_set(text, cache))
            size += len(sets[-1])
            if size >= BLOCK:
                yield rows(ids, keys, sets)
                ids, keys, sets, size = [], [], [], 0
        if ids:
            yield rows(ids, keys, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        sets = [shingle_set(t, cache).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "items"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both))
        out = [(p, q) for p, q, k in zip(u, v, keep, strict=True) if k]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["u", "v"])


def _fits(a: str, b: str) -> Column:
    """Sizes, bitmaps and signatures of the structs a and b allow the threshold; evaluated inside the join, on 64-bit words."""
    equal, differ, words = F.lit(0), F.lit(0), MINIMA * SIGNATURE_BITS // 64
    for i in range(words, words + BITMAP // 64):
        differ = differ + F.bit_count(F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i]))
    for i in range(words):
        x = F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        equal = equal + 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(na, nb) >= THRESHOLD_PERCENT * F.greatest(na, nb)
    return sizes & ((100 + THRESHOLD_PERCENT) * differ <= (100 - THRESHOLD_PERCENT) * (na + nb)) & (equal >= LEAST_EQUAL)


def _judged(docs: DataFrame, tie: bool) -> DataFrame:
    """Per row of docs: doc_id, key (hash of its text), n_shingles, fp and component_id; tie: texts of one doc_id share a component."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("key"))
    signed = written(texts.mapInArrow(_sign, "doc_id long, key long, n_shingles long, fp binary, sig array<long>, bands array<long>"), "signed")
    full = signed.where("fp is not null and doc_id is not null")
    classes = written(full.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
    # one row for each class: the row of its least document
    heads = classes.select(F.col("fp").alias("_fp"), "head", "node")
    first = full.join(heads, (F.col("fp") == F.col("_fp")) & (F.col("doc_id") == F.col("head"))).select(F.struct("node", F.col("n_shingles").alias("n"), "sig").alias("x"), "head", "key", "fp", "bands")
    nodes = written(first.dropDuplicates(["fp"]).drop("fp"), "nodes")
    keys = nodes.select(F.col("x.node").alias("node"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = written(keys.join(buckets, "key").select("key", "node", "n"), "placed")
    # a class near the middle of its group is in the group's large buckets: the best centre for a star
    central = placed.groupBy("node").agg(F.sum("n").alias("reach")).join(nodes.select("x", F.col("x.node").alias("node")), "node")
    members = written(placed.join(central, "node").select("key", "reach", "x"), "members")
    centre = members.groupBy("key").agg(F.max_by("x", F.struct("reach", "x.node")).alias("y"))
    star = members.join(centre, "key").where((F.col("x.node") != F.col("y.node")) & _fits("x", "y")).select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
    star = written(star.distinct(), "star")
    drop_table(placed)

    def confirmed(near: DataFrame, name: str) -> DataFrame:
        asked = near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct()
        wanted = written(nodes.select(F.col("x.node").alias("node"), F.col("head").alias("_head"), F.col("key").alias("_key")).join(asked, "node", "left_semi"), f"wanted-{name}")
        few = broadcast_if_small(wanted)
        met = texts.join(few, (F.col("doc_id") == F.col("_head")) & (F.col("key") == F.col("_key"))).select("node", "text")
        sets = written(met.mapInArrow(_sets, "node long, items binary").dropDuplicates(["node"]), f"sets-{name}")
        both = near.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
        links = written(both.mapInArrow(_linked, "u long, v long").distinct(), f"links-{name}")
        for t in (wanted, sets):
            drop_table(t)
        return links

    links = confirmed(star, "star")
    roots = written(components(links), "roots")
    # what the stars left apart: within each bucket, the members outside its largest component against the others
    placed = members.join(roots, F.col("x.node") == F.col("node"), "left").select("key", "x", F.coalesce("root", "x.node").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("top")).where("parts > 1").select("key", F.col("top.root").alias("top"))
    open_ = placed.join(split, "key")
    rest = open_.where("root <> top").select("key", F.col("x").alias("p"), F.col("root").alias("pr"))
    other = open_.select("key", F.col("x").alias("q"), F.col("root").alias("qr"))
    pairs = rest.join(other, (rest["key"] == other["key"]) & F.expr("pr <> qr") & _fits("p", "q")).select(F.least("p.node", "q.node").alias("u"), F.greatest("p.node", "q.node").alias("v"))
    more = confirmed(written(pairs.distinct().join(star, ["u", "v"], "left_anti"), "rest"), "rest")
    shared = _shared(signed) if tie else None
    if shared is not None:
        more = more.union(_ties(full, classes, shared))
    if not more.isEmpty():
        roots = written(components(more.union(roots.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))), "roots")
    for t in (nodes, members, star):
        drop_table(t)
    # a component is called by the least doc_id of its classes
    named = roots.join(classes.select("node", "head"), "node")
    named = named.join(named.groupBy("root").agg(F.min("head").alias("least")), "root").select("node", "least")
    called = classes.join(named, "node", "left").select("fp", "n", F.coalesce("least", "head").alias("component"))
    rows = join_groups(signed.select("doc_id", "key", "n_shingles", "fp"), called, "fp", "n")
    if shared is not None:
        # a text without words goes with the other texts of its document
        own = rows.where("component is not null").join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("_own"))
        rows = rows.join(own, "doc_id", "left").withColumn("component", F.coalesce("component", "_own"))
    return rows.select("doc_id", "key", "n_shingles", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def _shared(signed: DataFrame) -> DataFrame | None:
    """The doc_ids that several texts share, or None where there are none."""
    h = F.xxhash64("fp")
    each = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b"))
    shared = written(each.where("a <> b").select("doc_id"), "shared")
    return None if shared.isEmpty() else shared


def _ties(full: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of each shared doc_id."""
    held = full.select("doc_id", "fp").join(shared, "doc_id", "left_semi").distinct().join(classes.select("fp", "node"), "fp").select("doc_id", "node")
    least = held.groupBy("doc_id").agg(F.min("node").alias("u"))
    return held.join(least, "doc_id").where("u < node").select("u", F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _judged(docs, tie=True).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is that of the least document of its component; columns as they were.

    Repeated rows of a kept document all stay: they are one document.
    """
    i, k, key = fresh(docs, "_gone", "_k", "_key")
    lost = _judged(docs, tie=False).where("doc_id <> component_id").select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()
    gone = broadcast_if_small(written(lost, "gone"))
    return docs.withColumn(key, F.xxhash64(text_of())).join(gone, (F.col(key) == F.col(k)) & (F.col("doc_id") == F.col(i)), "left_anti").drop(key)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
