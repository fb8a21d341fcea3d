"""Operator 10: benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become tokens (runs of letters, marks and digits); a number, a capitalised word and a unit after a number
become typed placeholders. Windows of eight such tokens are hash-joined between benchmark items and documents.
Matches on one diagonal form a passage; its literal tokens must be equal, and its slots consistent: filled alike,
or by a one-to-one renaming (a re-parameterised question). A document is contaminated by an item when consistent
passages cover at least half of the item's tokens.

Benchmark items of fewer than eight tokens, and windows of fewer than three literal tokens, say too little as
templates: they are joined by their words as written.

Defined results: null and empty texts match nothing; benchmark items of fewer than eight tokens and MIN_BYTES bytes
are too short to tell from chance and are not searched; repeated rows are found each; rows without doc_id are searched like others; empty tables give
an empty result; extra columns are ignored (contaminated) or carried through (drop_contaminated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, fresh, let, read, text_of, written

WINDOW = 8
MIN_LITERALS = 3
MIN_COVERED = 0.5
#: Items of fewer than WINDOW tokens are searched from so many bytes of tokens on.
MIN_BYTES = 12
#: Slots filled alike that make a passage consistent without a renaming.
MIN_SAME_SLOTS = 0.75
#: Benchmark windows up to this number are broadcast (24 bytes each); more are joined by shuffle.
MAX_BROADCAST = 2_000_000

#: Units that become placeholders after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "miles", "meters", "metres", "g", "mg", "kg", "lb", "oz", "ml", "l", "liters", "litres", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "kmh", "mph", "degrees")


def tokens(text: Column) -> Column:
    """Runs of letters, marks and digits; a decimal point or comma inside a number is dropped."""
    whole = F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")).otherwise(text)
    return F.filter(F.split(whole, r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def canonical(words: Column) -> Column:
    """Tokens with placeholders: # number, @ name, ~ unit."""
    first = lambda x: F.substring(x, 1, 1)
    name = lambda x: ((x >= "A") & (x < "[")) | ((x >= "\x7f") & (first(x) != F.lower(first(x))))
    after = lambda i: F.coalesce(_is_number(F.get(words, i - 1)), F.lit(False))
    return F.transform(words, lambda x, i: F.when(_is_number(x), "#").when(name(x), "@").when(after(i) & x.isin(*UNITS), "~").otherwise(x))


def _windows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, h): place and hash of every window of the column canon."""
    df = df.select(*keys, F.transform("canon", lambda x: F.xxhash64(x)).alias("h1"))
    step = 1
    while step < WINDOW:
        rest = F.slice(f"h{step}", step + 1, F.greatest(F.size(f"h{step}") - step, F.lit(0)))
        df = df.select(*keys, F.zip_with(F.slice(f"h{step}", 1, F.greatest(F.size(f"h{step}") - step, F.lit(0))), rest, lambda a, b: F.xxhash64(a, b)).alias(f"h{2 * step}"))
        step *= 2
    # outer: else the optimiser filters on the array's size first, which makes the whole chain again for each step
    return df.select(*keys, F.posexplode_outer(f"h{WINDOW}").alias("at", "h")).where("h is not null")


def _exact(texts: DataFrame, items: DataFrame, low: DataFrame) -> DataFrame | None:
    """Hits of whole short items, and of the windows of few literals (low), by their words as written."""
    short = items.where((F.size("words") < WINDOW) & (F.octet_length(F.array_join("words", "")) >= MIN_BYTES)).select("item_id", "item_key", F.lit(0).alias("item_at"), F.size("words").alias("width"), F.xxhash64("words").alias("h"))
    wanted = written(short.union(low.select("item_id", "item_key", F.col("at").alias("item_at"), F.lit(WINDOW).alias("width"), F.xxhash64(F.slice("words", F.col("at") + 1, F.lit(WINDOW))).alias("h"))), "exact")
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())
    if not widths:
        return None
    places = lambda n: F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
    run = lambda n: lambda i: F.struct(F.lit(n).alias("width"), i.alias("at"), F.xxhash64(F.slice("words", i + 1, F.lit(n))).alias("h"))
    runs = F.flatten(F.array(*[F.transform(places(n), run(n)) for n in widths]))
    windows = texts.select("doc_id", "key", tokens(F.col("text")).alias("words")).select("doc_id", "key", F.explode_outer(runs).alias("r")).where("r is not null").select("doc_id", "key", "r.*")
    small = wanted.count() <= MAX_BROADCAST
    return windows.join(F.broadcast(wanted) if small else wanted, ["width", "h"]).select("doc_id", "key", "at", "item_id", "item_key", "item_at")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_covered: float = MIN_COVERED) -> DataFrame:
    """(doc_id, item_id, n_covered, n_tokens, n_slots, reparameterised) for every document that holds an item.

    n_covered of the item's n_tokens tokens are in consistent passages; reparameterised: some slot is filled otherwise.
    """
    return _matched(docs.select("doc_id", text_of().alias("text")), benchmark, min_covered).select("doc_id", "item_id", "n_covered", "n_tokens", "n_slots", "reparameterised")


def _matched(docs: DataFrame, benchmark: DataFrame, min_covered: float) -> DataFrame:
    """contaminated() with the key of the text, for rows that share a doc_id."""
    spark = docs.sparkSession
    split = lambda df, *keys: df.select(*keys, tokens(text_of()).alias("words")).select(*keys, "words", let(F.col("words"), canonical).alias("canon"))
    items = written(split(benchmark.dropDuplicates(["item_id", "text"]).withColumn("item_key", F.xxhash64("text")), "item_id", "item_key"), "items")
    literal = lambda x: ~x.isin("#", "@", "~")
    enough = items.select("item_id", "item_key", "words", "canon", F.transform("canon", lambda x: F.when(literal(x), 1).otherwise(0)).alias("lit"))
    places = enough.select("item_id", "item_key", "words", F.posexplode(F.transform("lit", lambda x, i: F.aggregate(F.slice("lit", i + 1, WINDOW), F.lit(0), lambda s, y: s + y))).alias("at", "n_lit"))
    wanted = written(_windows(items.select("item_id", "item_key", "canon"), ["item_id", "item_key"]).join(places.where(f"n_lit >= {MIN_LITERALS}"), ["item_id", "item_key", "at"], "left_semi").withColumnRenamed("at", "item_at"), "windows")
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    windows = _windows(split(texts, "doc_id", "key").select("doc_id", "key", "canon"), ["doc_id", "key"])
    small = wanted.count() <= MAX_BROADCAST
    hits = windows.join(F.broadcast(wanted) if small else wanted, "h").select("doc_id", "key", "at", "item_id", "item_key", "item_at")
    exact = _exact(texts, items, places.where(f"n_lit < {MIN_LITERALS}").where(F.col("at") + WINDOW <= F.size("words")))
    hits = written((hits if exact is None else hits.union(exact)).distinct(), "hits")
    # passages: all windows of a document and an item on one diagonal; at most the item's length each
    diagonal = hits.groupBy("doc_id", "key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("starts"))
    ids = broadcast_if_small(written(hits.select("doc_id", "key").distinct(), "ids"))
    held = texts.withColumnRenamed("doc_id", "_d").withColumnRenamed("key", "_k").join(ids, (F.col("_k") == F.col("key")) & F.col("_d").eqNullSafe(F.col("doc_id")), "left_semi")
    held = held.dropDuplicates(["_d", "_k"]).select("_d", "_k", tokens(F.col("text")).alias("doc_words"))
    met = diagonal.join(held, (F.col("_k") == F.col("key")) & F.col("_d").eqNullSafe(F.col("doc_id")))
    bench = items.select(F.col("item_id").alias("_i"), F.col("item_key").alias("_ik"), "words", "canon")
    met = met.join(bench, (F.col("_ik") == F.col("item_key")) & F.col("_i").eqNullSafe(F.col("item_id")))
    span = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.least(F.lit(WINDOW), F.size("words")) - 1)))))
    pairs = F.transform("span", lambda p: F.struct(p.alias("p"), F.get("canon", p).alias("c"), F.get("words", p).alias("x"), F.get("doc_words", p + F.col("shift")).alias("y")))
    met = met.withColumn("span", span).withColumn("pairs", pairs)
    slots = F.filter("pairs", lambda s: s["c"].isin("#", "@", "~"))
    met = met.select("doc_id", "key", "item_id", F.size("words").alias("n_tokens"), slots.alias("slots"), F.transform(F.filter("pairs", lambda s: s["c"].isin("#", "@", "~") | (s["x"] == s["y"])), lambda s: s["p"]).alias("covered"), F.size("pairs").alias("n_pairs"))
    distinct = lambda f: F.size(F.array_distinct(F.transform("slots", f)))
    n_same = F.size(F.filter("slots", lambda s: s["x"] == s["y"]))
    both = distinct(lambda s: F.struct(s["x"], s["y"]))
    renamed = (both == distinct(lambda s: s["x"])) & (both == distinct(lambda s: s["y"]))
    consistent = renamed | (n_same >= MIN_SAME_SLOTS * F.size("slots"))
    good = met.where((F.size("covered") == F.col("n_pairs")) & consistent).select("doc_id", "key", "item_id", "n_tokens", "covered", F.size("slots").alias("n_slots"), n_same.alias("n_same"))
    found = good.groupBy("doc_id", "key", "item_id").agg(F.max("n_tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("bigint").alias("n_covered"), F.sum("n_slots").cast("bigint").alias("n_slots"), (F.sum("n_same") < F.sum("n_slots")).alias("reparameterised"))
    return found.where(F.col("n_covered") >= min_covered * F.col("n_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_covered: float = MIN_COVERED) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns as they were."""
    key, d, k = fresh(docs, "_key", "_d", "_k")
    found = _matched(docs.select("doc_id", text_of().alias("text")), benchmark, min_covered).select(F.col("doc_id").alias(d), F.col("key").alias(k)).distinct()
    found = broadcast_if_small(written(found, "found"))
    return docs.withColumn(key, F.xxhash64(text_of())).join(found, (F.col(key) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_anti").drop(key)


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
