"""Operator 9: quality rules as weak supervision, in DataFrame functions only.

Each rule votes 1 (good), 0 (bad) or abstains (-1). The votes of a document form a pattern; the corpus
is reduced to a histogram of patterns (at most 3**rules rows whatever the input), expectation-maximisation
runs over that histogram as one fold inside a single row, and each document gets its pattern's posterior.

Defined results: a null or empty text has no words, fails the base rules and is rejected; repeated rows are
judged alike; an empty table gives an empty table; extra columns of the input are ignored (quality) or
carried through unchanged (filter_documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, broadcast_if_small, fresh, let, read, text_of, words_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ITERATIONS = 25
SMOOTHING = 1.0
#: Starting posterior of a pattern with a vote of bad.
START_BAD = 0.02
#: Positions take the low bits of a packed sort key, the window's hash the rest.
POSITION_BITS = 24

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """The rules as votes over the measured columns; every rule abstains in its grey zone."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / words
    return {
        "length": _vote(F.col("n_words") < 40, F.col("n_words") >= 50),
        "word_length": _vote((mean < 2.0) | (mean > 14), (mean >= 3.0) & (mean <= 10.0)),
        "symbols": _vote(F.col("n_symbols") / words > 0.20, F.col("n_symbols") / words < 0.02),
        "symbol_share": _vote(F.col("n_symbols") / chars > 0.06, F.col("n_symbols") / chars < 0.01),
        "lines": _vote(F.col("n_dup_lines") / lines > 0.50, F.col("n_dup_lines") / lines < 0.20),
        "repetition": _vote(F.col("n_repeat_words") / words > 0.50, F.col("n_repeat_words") / words < 0.30),
        "upper": _vote(F.col("n_upper") / chars > 0.40, F.col("n_upper") / chars < 0.15),
    }


def _covered(positions: Column) -> Column:
    """Words that windows of three starting at these sorted positions cover."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("bigint"), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: its id, the columns in keep, and what the rules read. Long texts cost n log n."""
    low = (1 << POSITION_BITS) - 1
    df = docs.select(id_col, *keep, text_of(text_col).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = lambda chars: (F.size(F.split("_t", f"[{chars}]")) - 1).cast("bigint")
    df = df.select(
        id_col,
        *keep,
        let(
            words_of(F.col("_t")),
            lambda w: F.struct(
                F.transform(w, lambda x: F.xxhash64(x)).alias("h"),
                F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("c"),
            ),
        ).alias("_w"),
        found("#*$%&|<>").alias("n_symbols"),
        found("A-Z").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).cast("bigint").alias("d"))).alias("_l"),
    )
    base = [id_col, *keep, "n_symbols", "n_upper"]
    # a column that is read more than once stays a column: the optimiser does not inline it into the lambdas
    n = F.size("_w.h")
    window = lambda a, i: F.xxhash64(a, F.get(F.col("_w.h"), i + 1), F.get(F.col("_w.h"), i + 2))
    df = df.select(
        *base,
        F.col("_l.n").alias("n_lines"),
        (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
        F.col("_w.c").alias("word_chars"),
        n.cast("bigint").alias("n_words"),
        F.transform(F.slice("_w.h", 1, F.greatest(n - 2, F.lit(0))), window).alias("_h"),
    )
    base += ["n_lines", "n_dup_lines", "word_chars", "n_words"]
    packed = F.transform("_h", lambda h, i: F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("bigint")))
    df = df.select(*base, "_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(packed)).alias("_p"))
    at = lambda x: F.get(F.col("_h"), x.bitwiseAND(F.lit(low)).cast("int"))
    top = lambda i: F.shiftright(F.get(F.col("_p"), i), POSITION_BITS)
    # places i of the sorted keys whose upper bits equal those at i + 1
    near = F.filter(F.sequence(F.lit(0), F.size("_p") - 2), lambda i: top(i) == top(i + 1))
    df = df.select(*base, "_h", "_p", F.size("_p").alias("_np"), F.when(F.col("_p").isNotNull(), near).alias("_i"))
    # rarely two windows share those bits only: then whole hashes are sorted instead
    collide = F.exists("_i", lambda i: at(F.get(F.col("_p"), i)) != at(F.get(F.col("_p"), i + 1)))
    pairs = F.flatten(F.transform("_i", lambda i: F.array(F.get(F.col("_p"), i).bitwiseAND(F.lit(low)), F.get(F.col("_p"), i + 1).bitwiseAND(F.lit(low)))))
    quick = _covered(F.array_sort(F.array_distinct(pairs)))
    whole = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))
    slow = let(whole, lambda s: _covered(F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))))
    repeat = F.when(F.col("_p").isNull(), F.lit(0)).when((F.col("n_words") > low) | collide, slow).otherwise(quick)
    return df.select(*base, F.coalesce(repeat, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(votes: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """Posterior quality for each vote pattern: (votes, posterior).

    votes has the array column votes. A two-class model with conditionally independent rules, each with a
    probability of voting good, bad or abstaining in either class; started from the belief that a
    document with any vote of bad is bad. Only the
    pattern histogram meets in one task; its size is bounded by 3**n_rules and does not grow with the input.
    """
    hist = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = hist.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    start = F.transform(
        "p",
        lambda x: F.struct(
            x["votes"].alias("v"),
            x["n"].alias("n"),
            F.when(F.exists(x["votes"], lambda a: a == 0), START_BAD).otherwise(1 - START_BAD).alias("q"),
        ),
    )
    total = lambda p, f: F.aggregate(p, F.lit(0.0), lambda s, x: s + f(x))

    def weights(p: Column) -> Column:
        """Log odds of each rule's three votes, and of the prior."""

        def odds(j: Column, v: Column) -> Column:
            hit = lambda x: x["v"][j] == v
            good = total(p, lambda x: F.when(hit(x), x["n"] * x["q"]).otherwise(0.0)) + SMOOTHING
            bad = total(p, lambda x: F.when(hit(x), x["n"] * (1 - x["q"])).otherwise(0.0)) + SMOOTHING
            return F.log(good) - F.log(bad)

        all_good = total(p, lambda x: x["n"] * x["q"])
        all_bad = total(p, lambda x: x["n"] * (1 - x["q"]))
        rest = F.log(all_good + 3 * SMOOTHING) - F.log(all_bad + 3 * SMOOTHING)
        return F.struct(
            F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: odds(j, v) - rest)).alias("w"),
            (F.log(all_good + SMOOTHING) - F.log(all_bad + SMOOTHING)).alias("prior"),
        )

    def step(p: Column) -> Column:
        return let(
            weights(p),
            lambda m: F.transform(
                p,
                lambda x: F.struct(
                    x["v"].alias("v"),
                    x["n"].alias("n"),
                    (1 / (1 + F.exp(-F.aggregate(F.sequence(F.lit(0), F.lit(n_rules - 1)), m["prior"], lambda s, j: s + m["w"][j][x["v"][j] + 1])))).alias("q"),
                ),
            ),
        )

    done = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda p, _: step(p)).alias("p"))
    return done.select(F.explode("p").alias("x")).select(F.col("x.v").alias("votes"), F.col("x.q").alias("posterior"))


def quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: measures, base_failed, votes, posterior and kept."""
    named = rules()
    # read twice, for the histogram and for the verdicts: the texts are measured once
    measured = written(measure(docs, id_col, text_col, keep).withColumn("votes", F.array(*named.values())), "measures")
    posterior = fit(measured.select("votes"), len(named))
    # at most 3**rules rows, so the broadcast is bounded
    return (
        measured.join(F.broadcast(posterior), "votes", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= threshold))
    )


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their columns as they were.

    Verdicts are joined back by doc_id; a doc_id that repeats with different texts keeps each row by its own text.
    """
    key, i, k = fresh(docs, "_key", "_id", "_k")
    marked = docs.withColumn(key, F.xxhash64("text"))
    judged = quality(marked.select("doc_id", F.col(key).alias("_key"), "text"), threshold, keep=("_key",))
    gone = broadcast_if_small(written(judged.where("not kept").select(F.col("doc_id").alias(i), F.col("_key").alias(k)).distinct(), "rejected"))
    return marked.join(gone, (F.col(key) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i)), "left_anti").drop(key)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(read(spark, sf_dir, "documents"))
    return q.select("doc_id", *FEATURES, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
