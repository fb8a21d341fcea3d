"""Operator 1: toxicity with a noisy channel in front.

A trigram character model is counted over every document. A disguised token (leet characters, letters set apart,
repeated letters) becomes a lattice of readings, and Viterbi search under that model gives its best readings. The
lexicon holds words and word beginnings whose odds in toxic documents stand out among labelled training rows; a
logistic curve over a document's strongest evidence gives the score. labels, lang, source and doc_id never enter
a score, and rows whose crc32(doc_id) mod 5 is 0 never enter training.

A lattice is searched only if some path of it spells a word or beginning of the lexicon: one pass over the characters
with the set of the lexicon's prefixes that paths may have spelled so far tells. No other lattice can score, so this
changes no score, and hashes, encoded data and spelled-out text cost little more than reading them. While the lexicon
is fitted there is none yet: there the words and beginnings that stand out among undisguised words are searched for.

Defined results: null and empty texts score what no evidence scores; repeated rows score alike; without usable
labels every score is the prior 0.5 times nothing known, 0.0; a doc_id labelled twice counts with its larger label;
an empty table gives an empty table; extra columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, text_of, written

FOLDS = 5
#: The classifier is fitted on at most so many labelled rows, those with the least hash of doc_id.
MAX_LABELLED = 20_000
#: The lexicon holds at most so many words and beginnings.
MAX_LEXICON = 5_000
MIN_TOXIC_DOCS = 2
MIN_LOG_ODDS = 1.2
BEGINNINGS = (4, 5, 6, 7)
CACHED_TOKENS = 400_000
#: Fitting searches lattices for at most so many words and beginnings, those found in most toxic documents undisguised.
MAX_CANDIDATES = 20_000
#: Steps of the lexicon's prefixes, and readings, that are remembered.
CACHED_STEPS = 200_000
#: Longer tokens are decoded in pieces of so many characters.
PIECE = 40
#: Readings kept for a token; each state of the search keeps as many, so they are the best of all.
READINGS = 3

#: What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = ".-_*~'·,/\\:"
COST = {"leet": 1.0, "separator": 0.5, "repeat": 0.7, "drop": 9.0, "break": 0.5}

_LETTER = re.compile("[a-zß-öø-ž]")
_EDGES = re.compile(r"^[^\w$@!|+(€£]+|[^\w$@|€£]+$")
_JUNK_END = re.compile(r"([$@|&%#*!+])\1+$")
_DISGUISED = re.compile(r"[0-9@$!|+(€£¡.\-_*~·/\\:]|(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")


class CharModel:
    """Interpolated trigram probabilities of characters; ^ begins and $ ends a word."""

    def __init__(self, grams: dict[str, int]) -> None:
        self.tri = grams
        self.bi: Counter = Counter()
        self.pre: Counter = Counter()
        self.uni: Counter = Counter()
        for g, n in grams.items():
            self.bi[g[1:]] += n
            self.pre[g[:2]] += n
            self.uni[g[2]] += n
        self.first: Counter = Counter()
        for g, n in self.bi.items():
            self.first[g[0]] += n
        self.total = sum(self.uni.values()) or 1
        self.seen: dict[str, float] = {}
        self.read: dict[tuple[str, bool], list[str]] = {}
        self.spreads: dict[frozenset[str], float] = {}

    def spread(self, letters: frozenset[str]) -> float:
        """What two contexts of these letters can differ by in all that follows: the costs of two letters, as contexts know no more."""
        got = self.spreads.get(letters)
        if got is None:
            before = [*letters, "^"]
            one = max(max(x) - min(x) for c in [*letters, "$"] for x in [[self.cost(a, b, c) for a in before for b in before]])
            two = max((max(x) - min(x) for b in letters for c in [*letters, "$"] for x in [[self.cost(a, b, c) for a in before]]), default=0.0)
            got = self.spreads[letters] = one + two + 1e-6
        return got

    def cost(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        got = self.seen.get(key)
        if got is None:
            p = 0.6 * self.tri.get(key, 0) / max(1, self.pre[a + b]) + 0.3 * self.bi[b + c] / max(1, self.first[b]) + 0.1 * (self.uni[c] + 1) / (self.total + 100)
            got = -math.log(p)
            self.seen[key] = got
        return got

    def readings(self, token: str, breaks: bool = False) -> list[str]:
        """The best readings of a token's lattice, best first; with breaks, of words with blanks between them.

        A state is dropped when READINGS paths of another lead it by more than their contexts can make up for.
        """
        known = self.read.get((token, breaks))
        if known is not None:
            return known
        slack = self.spread(frozenset(c for ch in token for c in (ch if _LETTER.match(ch) else LEET.get(ch, ""))))
        states: dict[tuple[str, str], list[tuple[float, str]]] = {("^", "^"): [(0.0, "")]}
        last = ""
        for ch in token:
            arcs: list[tuple[str, float]] = []
            if _LETTER.match(ch):
                arcs.append((ch, 0.0))
                if ch == last:
                    arcs.append(("", COST["repeat"]))
            else:
                arcs += [(c, COST["leet"]) for c in LEET.get(ch, "")]
                arcs.append(("", COST["separator"] if ch in SEPARATORS or ch.isspace() else COST["drop"]))
                if ch == last:
                    arcs.append(("", COST["repeat"]))
            moves = []
            for (a, b), paths in states.items():
                for c, cost in arcs:
                    moves.append((((b, c), c, cost + self.cost(a, b, c)) if c else ((a, b), "", cost), paths))
                if breaks and b != "^":  # a word ends before this character
                    end = self.cost(a, b, "$") + COST["break"]
                    moves += [((("^", c), f" {c}", end + cost + self.cost("^", "^", c)), paths) for c, cost in arcs if c]
            most = min((paths[-1][0] + step for (state, _, step), paths in moves if len(paths) == READINGS and state[1] != "^"), default=math.inf) + slack
            after: dict[tuple[str, str], dict[str, float]] = {}
            for (state, c, step), paths in moves:
                if paths[0][0] + step > most:
                    continue
                known = after.get(state)
                if known is None:
                    known = after[state] = {}
                for s, out in paths:
                    to, s = out + c, s + step
                    if s < known.get(to, math.inf):
                        known[to] = s
            kept = {k: sorted(zip(v.values(), v, strict=True))[:READINGS] for k, v in after.items()}
            most = min((v[-1][0] for k, v in kept.items() if len(v) == READINGS and k[1] != "^"), default=math.inf) + slack
            states = {k: v for k, v in kept.items() if v[0][0] <= most}
            last = ch
        done = sorted((s + self.cost(a, b, "$"), out) for (a, b), paths in states.items() for s, out in paths if out)
        out = list(dict.fromkeys(out for _, out in done))[:READINGS]
        if len(self.read) >= CACHED_STEPS:
            self.read.clear()
            self.spreads.clear()
        self.read[token, breaks] = out
        return out


class Spellings:
    """Whether a lattice has a path that spells an entry (a word, or a beginning with *): its prefixes, followed all at once."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: set[int] = set()
        for e in entries:
            at = 0
            for c in e.rstrip("*"):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            self.ends.add(at)
        self.steps: dict[tuple[frozenset, str, bool, bool], frozenset] = {}

    def _step(self, state: frozenset, ch: str, again: bool, breaks: bool) -> frozenset:
        letters, stays = (ch, again) if _LETTER.match(ch) else (LEET.get(ch, ""), True)
        to = {self.next[i][c] for i in state for c in letters if c in self.next[i]}
        if stays:
            to |= state
        if breaks:
            to.add(0)
        out = frozenset() if not to else frozenset({-1}) if to & self.ends else frozenset(to)
        if len(self.steps) >= CACHED_STEPS:
            self.steps.clear()
        self.steps[state, ch, again, breaks] = out
        return out

    def met(self, token: str, breaks: bool = False) -> bool:
        state, last, steps = frozenset({0}), "", self.steps
        for ch in token:
            key = (state, ch, ch == last, breaks)
            state = steps[key] if key in steps else self._step(*key)
            if not state:
                return False
            if -1 in state:
                return True
            last = ch
        return False


def core(token: str) -> str:
    """A lower-case token without the punctuation around it."""
    return _EDGES.sub("", _JUNK_END.sub("", token))


def forms(token: str, model: CharModel, wanted: Spellings | None = None) -> list[str]:
    """A token as written and, where it looks disguised and may spell an entry, as the channel restores it."""
    if token[:1] == " ":
        return list(dict.fromkeys(w for p in pieces(token[1:]) for w in [*forms(p, model, wanted), *segments(p, model, wanted)]))
    c = core(token)
    if not c:
        return []
    plain = c.strip("$@|€£!+(")
    if len(c) > PIECE and _LETTER.search(c) and _DISGUISED.search(c):
        return list(dict.fromkeys([*([plain] if plain else []), *(w for p in pieces(c) for w in segments(p, model, wanted))]))
    if len(c) > PIECE or not _LETTER.search(c) or not _DISGUISED.search(c):
        return [plain] if plain else []
    return list(dict.fromkeys([plain, *(model.readings(c) if wanted is None or wanted.met(c) else ())]))


def pieces(run: str) -> list[str]:
    """A run in pieces of PIECE characters that overlap by half."""
    return [run[i : i + PIECE] for i in range(0, max(1, len(run) - PIECE // 2), PIECE // 2)]


def segments(run: str, model: CharModel, wanted: Spellings | None = None) -> list[str]:
    """The words of a run set apart where they may spell an entry, and the run without a one-letter word at either end."""
    return [*(w for r in (model.readings(run, True) if wanted is None or wanted.met(run, True) else ()) for w in r.split()), *(w for w in (run[1:], run[:-1]) if len(w) > 2)]


def undoubled(word: str) -> list[str]:
    """A word with each doubled letter written once, and with all of them."""
    at = [i for i in range(1, len(word)) if word[i] == word[i - 1]]
    return list(dict.fromkeys([*(word[:i] + word[i + 1 :] for i in at), re.sub(r"(.)\1", r"\1", word)])) if at else []


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def spaced(text: str) -> list[str]:
    """Runs of single characters set apart, as tokens."""
    return ["".join(m.group().split()) for m in _SPACED.finditer(text)]


def tokens(text: str) -> set[str]:
    low = text.lower()
    return {*low.split(), *(f" {run}" for run in spaced(low))}


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the words of whole texts; their number is bounded by the alphabet."""
    grams: Counter = Counter()
    words: Counter = Counter()

    def flush() -> None:
        for w, n in words.items():
            if len(w) <= 40 and w.isalpha():
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    grams[w[i : i + 3]] += n
        words.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words.update(text.lower().split())
            if len(words) > CACHED_TOKENS:
                flush()
    flush()
    ok = [(g, n) for g, n in grams.items() if all(c in "^$" or _LETTER.match(c) for c in g)]
    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in ok], pa.string()), pa.array([n for _, n in ok], pa.int64())], ["gram", "n"])


def char_model(docs: DataFrame) -> dict[str, int]:
    """Trigram counts over all texts; at most (alphabet + 2) cubed of them reach the driver."""
    counted = docs.select(text_of().alias("text")).mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


def _found(grams: dict[str, int], candidates: list[str]):
    """Per labelled document its distinct features, counted by label; lattices are searched for the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted = CharModel(grams), Spellings(candidates)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for t in tokens(text) for w in forms(t, model, wanted) for f in features(w)}:
                    counts.setdefault(f, [0, 0])[toxic] += 1
        items = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in items], pa.string()), pa.array([n[0] for _, n in items], pa.int64()), pa.array([n[1] for _, n in items], pa.int64())], ["feature", "n0", "n1"])

    return run


def _evidence(grams: dict[str, int], lexicon: dict[str, float]):
    """Text to (largest weight, second, sum): the evidence that the curve reads."""
    model, wanted = CharModel(grams), Spellings(lexicon)
    known: dict[str, float] = {}
    beginnings = {f[:4] for f in lexicon}
    digits = set(LEET) | set(SEPARATORS)

    def weight(token: str) -> float:
        got = known.get(token)
        if got is None:
            ws = forms(token, model, wanted) if token[:4] in beginnings or not token.isalpha() or _DISGUISED.search(token) else ()
            got = max((lexicon.get(f, 0.0) for w in ws for f in features(w)), default=0.0)
            if not got and token.isalpha():  # unknown as written
                got = max((lexicon.get(f, 0.0) for w in undoubled(token) for f in features(w)), default=0.0)
            if len(known) < CACHED_TOKENS:
                known[token] = got
        return got

    def of(text: str) -> tuple[float, float, float]:
        top = sorted((w for w in map(weight, tokens(text)) if w), reverse=True)
        return (top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, min(10.0, float(len(top))))

    return of


def _scored(grams: dict[str, int], lexicon: dict[str, float], curve: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _evidence(grams, lexicon)
        for batch in batches:
            x = np.array([of(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)) * 0.1, a.T @ (y - p) - 0.1 * ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, grams: dict[str, int]) -> tuple[dict[str, float], list[float]]:
    """Lexicon and curve from at most MAX_LABELLED labelled training rows."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    sample = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    rows = written(docs.join(sample, "doc_id").select(text_of().alias("text"), "toxic"), "labelled")
    n = dict(rows.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return {}, [-30.0, 0.0, 0.0, 0.0]
    def counted(candidates: list[str]) -> DataFrame:
        found = rows.mapInArrow(_found(grams, candidates), "feature string, n0 long, n1 long")
        return found.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    plain = counted([]).where((F.col("n1") >= 1) & (F.col("n1") * n[0] > F.col("n0") * n[1]) & (F.length("feature") >= 3))
    counts = counted([r["feature"] for r in plain.orderBy(F.desc("n1"), "n0", "feature").limit(MAX_CANDIDATES).collect()])
    # the lower end of the log odds' confidence interval: rare features need to be purer
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (n[1] + 1)) - F.log(b / (n[0] + 1)) - 2 * F.sqrt(1 / a + 1 / b)
    strong = counts.where(f"n1 >= {MIN_TOXIC_DOCS}").select("feature", odds.alias("w"), "n1").where(f"w >= {MIN_LOG_ODDS}").orderBy(F.desc(F.col("w") * F.log1p("n1")), "feature").limit(MAX_LEXICON)
    lexicon = {r["feature"]: r["w"] for r in strong.collect()}

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _evidence(grams, lexicon)
        for batch in batches:
            x = [of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(3)), batch.column(1)], ["a", "b", "c", "toxic"])

    got = rows.mapInArrow(evidence, "a double, b double, c double, toxic int").collect()
    return lexicon, _curve(np.array([r[:3] for r in got], float), np.array([r[3] for r in got], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score in 0..1, predicted."""
    docs = docs.select("doc_id", "text")
    grams = char_model(docs)
    lexicon, curve = fit(docs, labels.select("doc_id", "toxic"), grams)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(_scored(grams, lexicon, curve), "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
