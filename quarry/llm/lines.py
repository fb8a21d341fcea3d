"""Operator 4: line dedup over overlapping windows of three lines, in DataFrame functions only.

Lines with a word are numbered within their document; every three consecutive ones form a window. A window that
occurs again, anywhere in the corpus, marks the lines it spans; overlapping spans merge and go. The first
occurrence, by doc_id and position, stays, so the first copy of any line always survives.

Defined results: null text stays null with no lines removed; an empty text or one of fewer than three lines with
words is unchanged; repeated rows (same doc_id and text) count as one document and get the same result; rows
without doc_id come before all others; an empty table gives an empty table; extra columns are ignored
(dedup_lines) or carried through (clean_documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh, let, read, text_of

WINDOW = 3


def _numbered(text: Column) -> Column:
    """(place in the text, line) of the lines that have a word."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(every, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, first, last, a, b): the lines a window spans, and 128 bits of hash of its lines."""

    def make(s: Column) -> Column:
        n = F.size(s)
        return F.transform(
            F.slice(s, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.struct(
                x["i"].alias("first"),
                F.get(s, i + 2)["i"].alias("last"),
                F.xxhash64(x["x"], F.get(s, i + 1)["x"], F.get(s, i + 2)["x"]).alias("a"),
                F.xxhash64(F.get(s, i + 2)["x"], F.lit(1), F.get(s, i + 1)["x"], F.lit(2), x["x"]).alias("b"),
            ),
        )

    # outer: else the optimiser makes the array twice, once to filter on its size
    return docs.select("doc_id", "key", F.explode_outer(let(_numbered(text_of()), make)).alias("w")).where("w is not null").select("doc_id", "key", "w.*")


def _merged(spans: Column) -> Column:
    """Sorted spans (first, last) with overlapping ones merged."""
    kind = "array<struct<first:int,last:int>>"
    end = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["last"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["last"], s["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(s))),
    )


def _without(lines: Column, spans: Column) -> Column:
    """The lines outside merged spans."""
    n = F.size(spans)
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["last"] + 1)
    stop = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(spans, i)["first"])
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, start(i) + 1, F.greatest(stop(i) - start(i), F.lit(0)))))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): per document with repeats, the merged line spans to remove. key is xxhash64(text)."""
    windows = _windows(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"))
    at = F.struct("doc_id", "key", "first")
    repeated = windows.groupBy("a", "b").agg(F.min(at).alias("kept"), F.max(at).alias("top")).where("kept <> top").select("a", "b", "kept")
    later = windows.join(repeated, ["a", "b"]).where(at != F.col("kept"))
    return later.groupBy("doc_id", "key").agg(_merged(F.array_sort(F.collect_set(F.struct("first", "last")))).alias("spans"))


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the spans to remove in a new column, matched by doc_id and text; the column's name."""
    i, k, key, name = fresh(docs, "_id", "_k", "_key", "_spans")
    spans = covered(docs).select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("spans").alias(name))
    marked = docs.withColumn(key, F.xxhash64("text"))
    return marked.join(spans, (F.col(key) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i)), "left"), name


def _text_left(spans: str) -> Column:
    return F.when(F.col(spans).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), lambda x: F.array_join(_without(x, F.col(spans)), "\n")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed and the text that is left."""
    marked, spans = _cleaned(docs.select("doc_id", "text"))
    gone = F.aggregate(F.coalesce(spans, F.array().cast("array<struct<first:int,last:int>>")), F.lit(0).cast("bigint"), lambda s, x: s + (x["last"] - x["first"] + 1))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    return marked.select("doc_id", n.alias("n_lines"), gone.alias("n_removed"), _text_left(spans).alias("text"))


def clean_documents(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated lines gone from text, and n_chars (where there is one) the new length.

    Every row stays, unless drop_emptied is set: then rows go that had words and lost them all, as every line of theirs
    is in an earlier document.
    """
    out, spans = _cleaned(docs)
    out = out.withColumn("text", _text_left(spans))
    if drop_emptied:
        out = out.where(F.col(spans).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))


#: CTEs that give table `cleaned`(doc_id, text, n_lines, n_removed, cleaned) from table `src`(doc_id, text).
SQL_STEPS = r"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src
),
worded AS (
  SELECT doc_id, i AS first, x AS a,
    lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, lead(i, 2) OVER w AS last
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
ranked AS (
  SELECT doc_id, first, last, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS nth
  FROM worded WHERE last IS NOT NULL
),
gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN ranked r
    ON r.nth > 1 AND l.doc_id = r.doc_id AND l.i BETWEEN r.first AND r.last
),
cleaned AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS cleaned
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
"""
ORACLE = f"WITH src AS (SELECT doc_id, text FROM documents), {SQL_STEPS} SELECT doc_id, n_lines, n_removed, cleaned AS text FROM cleaned"
