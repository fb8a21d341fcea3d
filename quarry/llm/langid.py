"""Operator 12: language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one from the left and one from the right, read the bytes of a word (lower case, after the
blank that leads to it; longer words in windows of WINDOW bytes), and a softmax over both states labels every position
with language probabilities. A document's probabilities are the mean over the positions of its words that have a
letter. The network is written in numpy and trained by backpropagation through time with Adam. As the states start
anew at each word, equal words have equal labels: a task reads each distinct word once and remembers its sums.

Training reads text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2 and no other column: at most
MAX_DOCS documents of each language, those with the least hash of doc_id, and at most MAX_WORDS words of them in all,
shared out evenly among languages and drawn with odds in proportion to their counts (words of 4 windows and more are no
examples). Every document is predicted
from its whole text.

Defined results: null texts, and texts without a letter, are und with score 0.0, as is every text where no language
can be learned; with one language alone its score is 1.0; null doc_ids count as not held out and keep their rows;
repeated rows are predicted alike (in training they count each); equal probabilities go to the language that sorts
first; an empty table gives an empty table; extra columns are ignored. A text of any length is one pass over it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, read, written

FOLDS, HELD_OUT = 4, 2
#: The network is fitted on at most so many documents of each language, and at most so many words in all.
MAX_DOCS = 1000
MAX_WORDS = 60_000
#: States of each direction, bytes of a window, passes over the words, words of a step.
HIDDEN = 16
WINDOW = 24
EPOCHS = 6
STEP = 256
RATE = 0.01
#: Distinct words that a task remembers; it forgets them all when there are more.
REMEMBERED = 400_000
#: Positions that are read at once.
AT_ONCE = 1 << 14
UNKNOWN = "und"

_BLANK = 0x20


@dataclass
class Network:
    """Languages in order, and the weights by name: for each direction inputs of bytes (x), of states (u), bias of states' candidates (c); out and bias of labels."""

    langs: list[str]
    w: dict[str, np.ndarray]


def fresh_weights(n: int, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w[f"c{d}"] = np.zeros(hidden)
    return {**w, "out": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, n)), "bias": np.zeros(n)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(w: dict[str, np.ndarray], d: str, x: np.ndarray, real: np.ndarray, keep: bool = False):
    """States (time, words, hidden) of one direction; x and real are (time, words), states stay where real is 0."""
    u, c = w[f"u{d}"], w[f"c{d}"]
    size = len(u)
    h = np.zeros((x.shape[1], size), u.dtype)
    states, kept = np.empty((*x.shape, size), u.dtype), []
    inputs = w[f"x{d}"][x]
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        i, s = inputs[t], h @ u
        zr = _sigmoid(i[:, : 2 * size] + s[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        inner = s[:, 2 * size :] + c
        n = np.tanh(i[:, 2 * size :] + r * inner)
        g = real[t][:, None] * (1 - z)
        new = h + g * (n - h)
        if keep:
            kept.append((t, h, z, r, n, inner, g))
        states[t] = h = new
    return states, kept


def _probabilities(w: dict[str, np.ndarray], f: np.ndarray, b: np.ndarray) -> np.ndarray:
    logits = np.concatenate([f, b], -1) @ w["out"] + w["bias"]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def labelled(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Label probabilities (time, words, languages) of every position."""
    return _probabilities(w, _run(w, "f", x, real)[0], _run(w, "b", x, real)[0])


def gradients(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy of all positions, and its gradient by backpropagation through time."""
    runs = {d: _run(w, d, x, real, True) for d in "fb"}
    size = len(w["uf"])
    p = _probabilities(w, runs["f"][0], runs["b"][0])
    share = real * weight
    share = share / share.sum()
    at = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0]
    loss = float(-(share * np.log(at + 1e-12)).sum())
    dl = p * share[:, :, None]
    np.put_along_axis(dl, np.broadcast_to(y[None, :, None], (*x.shape, 1)), (at * share - share)[:, :, None], 2)
    both = np.concatenate([runs["f"][0], runs["b"][0]], -1)
    flat = dl.reshape(-1, dl.shape[-1])
    g = {"out": both.reshape(-1, 2 * size).T @ flat, "bias": flat.sum(0)}
    ds = dl @ w["out"].T
    for k, d in enumerate("fb"):
        u = w[f"u{d}"]
        dh = np.zeros((x.shape[1], size), u.dtype)
        gu, gc, gi = np.zeros_like(u), np.zeros(size, u.dtype), np.empty((*x.shape, 3 * size), u.dtype)
        for t, h, z, r, n, inner, gate in reversed(runs[d][1]):
            dh = dh + ds[t][:, k * size : (k + 1) * size]
            dn = dh * gate * (1 - n * n)
            dz = -dh * (n - h) * real[t][:, None] * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dstate = np.concatenate([dz, dr, dn * r], 1)
            gi[t] = np.concatenate([dz, dr, dn], 1)
            gu += h.T @ dstate
            gc += (dn * r).sum(0)
            dh = dh * (1 - gate) + dstate @ u.T
        gx = np.zeros_like(w[f"x{d}"])
        flat, seen = gi.reshape(-1, 3 * size), x.ravel()
        order = np.argsort(seen, kind="stable")
        starts = np.flatnonzero(np.diff(seen[order], prepend=-1))
        gx[seen[order][starts]] = np.add.reduceat(flat[order], starts, 0)
        g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
    return loss, g


def windows(word: bytes) -> list[bytes]:
    """A blank and the word's bytes, in windows."""
    word = b" " + word
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word), WINDOW)]


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, words) bytes and which of them are real."""
    lens = np.array(list(map(len, parts)))
    width = int(lens.max())
    x = np.frombuffer(b"".join(p.ljust(width, b" ") for p in parts), np.uint8).reshape(len(parts), width).T.astype(np.intp)
    return x, np.arange(width)[:, None] < lens[None, :]


def train(langs: list[str], words: list[tuple[str, int, int]], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network from (word, place of its language, count); Adam over steps of words of like length."""
    parts = [(p, y, n) for word, y, n in words for p in windows(word.encode())]
    parts.sort(key=lambda p: (len(p[0]), zlib.crc32(p[0])))
    steps = [parts[i : i + STEP] for i in range(0, len(parts), STEP)]
    rng = np.random.default_rng(seed)
    w = {k: v.astype(np.float32) for k, v in fresh_weights(len(langs), seed=seed).items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    done, total = 0, epochs * len(steps)
    for _ in range(epochs):
        for i in rng.permutation(len(steps)).tolist():
            x, real = _padded([p for p, _, _ in steps[i]])
            y, n = (np.array([p[j] for p in steps[i]]) for j in (1, 2))
            _, g = gradients(w, x, real.astype(np.float32), y, np.sqrt(n).astype(np.float32))
            done += 1
            rate = RATE * (1 - 0.9 * done / total)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w[k] -= (rate * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return Network(langs, w)


def word_sums(net: Network, words: list[bytes]) -> np.ndarray:
    """Per word: sums of its positions' probabilities, how many positions each language has, and their number."""
    n = len(net.langs)
    out = np.zeros((len(words), 2 * n + 1), np.float32)
    parts = [(len(p), p, i) for i, word in enumerate(words) for p in windows(word)]
    parts.sort(key=lambda p: p[0])
    at = 0
    while at < len(parts):
        size = max(1, AT_ONCE // max(parts[min(len(parts) - 1, at + AT_ONCE // parts[at][0])][0], 1))
        some = parts[at : at + size]
        x, real = _padded([p for _, p, _ in some])
        p = labelled(net.w, x, real.astype(np.float32)) * real[:, :, None]
        best = np.zeros_like(p)
        np.put_along_axis(best, p.argmax(2)[:, :, None], real[:, :, None].astype(p.dtype), 2)
        np.add.at(out, [i for _, _, i in some], np.concatenate([p.sum(0), best.sum(0), real.sum(0)[:, None]], 1))
        at += size
    return out


def _lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


class Memory(dict):
    """Places of words' sums in a table; 0 is the row of words without a letter."""

    def __init__(self, net: Network) -> None:
        self.net, self.new = net, []
        self.table = np.zeros((1, 2 * len(net.langs) + 1), np.float32)
        self.size = 1

    def __missing__(self, word: str) -> int:
        if _lettered(word):
            self.new.append(word.encode())
            out = self.size
            self.size += 1
        else:
            out = 0
        self[word] = out
        return out

    def learn(self) -> None:
        if self.new:
            if self.size > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(self.size, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
            self.table[self.size - len(self.new) : self.size] = word_sums(self.net, self.new)
            self.new = []

    def forget(self) -> None:
        self.clear()
        self.size = 1


_RESULT = "doc_id long, held_out boolean, lang_pred string, score double, probabilities array<double>, positions array<long>"


def _identified(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(net.langs)
        memory = Memory(net)
        pooled = np.zeros(2 * n + 1)

        def of(text: str | None) -> np.ndarray:
            """Sums over a text's words; of a long text, by stretches of words."""
            total = np.zeros_like(pooled)
            words = (text or "").lower().split()
            for i in range(0, len(words), REMEMBERED):
                places = list(map(memory.__getitem__, words[i : i + REMEMBERED]))
                memory.learn()
                total += memory.table[places].sum(0, dtype=np.float64)
                if len(memory) > REMEMBERED:
                    memory.forget()
            return total

        def several(texts: list[str | None]) -> np.ndarray:
            """Sums of several texts, whose new words are read together."""
            every, sizes = [], []
            for t in texts:
                words = t.lower().split() if t else ()
                sizes.append(len(words))
                every.extend(map(memory.__getitem__, words))
            memory.learn()
            rows = memory.table[every]
            ends = np.cumsum(sizes)
            out = np.array([rows[e - s : e].sum(0, dtype=np.float64) for s, e in zip(sizes, ends, strict=True)])
            if len(memory) > REMEMBERED:
                memory.forget()
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums, some, held = [], [], 0
            for t in [*texts, None]:
                size = len(t or "")
                if some and (held + size > 1 << 22 or len(sums) + len(some) == len(texts)):
                    sums += list(several(some))
                    some, held = [], 0
                if len(sums) + len(some) == len(texts):
                    break
                if size > 1 << 22:
                    sums.append(of(t))
                else:
                    some.append(t)
                    held += size
            s = np.array(sums).reshape(-1, 2 * n + 1)
            known = s[:, -1] > 0
            p = s[:, :n] / np.maximum(s[:, -1:], 1)
            best = p.argmax(1)
            langs = [net.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(p[np.arange(len(s)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(list(p), pa.list_(pa.float64())), pa.array(list(s[:, n : 2 * n].astype(np.int64)), pa.list_(pa.int64()))],
                ["doc_id", "held_out", "lang_pred", "score", "probabilities", "positions"],
            )

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, word) of words with a letter."""
    for batch in batches:
        counts = Counter((lang, w) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in (text or "").lower().split() if len(w.encode()) < 4 * WINDOW and _lettered(w))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Network:
    """A network from the bounded sample of docs (doc_id, text, lang) that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    first = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "doc_id")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("size")), "sizes")
    # of a large language only the least hashes are ranked: some twice the documents that are wanted
    hashed = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).join(broadcast_if_small(sizes), "lang")
    low = F.pmod(F.col("h"), F.lit(1 << 30)) * F.col("size") <= F.lit(2 * max_docs << 30)
    ranked = hashed.where(low).drop("size").distinct().withColumn("k", F.row_number().over(first))
    ids = written(ranked.where(F.col("k") <= max_docs).select("lang", "doc_id"), "sample")
    picked = rows.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "text")
    counts = picked.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    share = max(200, max_words // max(1, len(langs)))
    # a draw with odds in proportion to n: the least of exponential times
    u = (F.pmod(F.xxhash64("word", "lang"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    drawn = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(-F.log(u) / F.col("n"), "word"))).where(F.col("k") <= share)
    words = sorted((r["word"], langs.index(r["lang"]), r["n"]) for r in drawn.collect())
    return train(langs, words) if words else Network([], fresh_weights(0))


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, and for net.langs in order the pooled probabilities and how many positions each labels."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    if not net.langs:
        none = F.array()
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), none.cast("array<double>").alias("probabilities"), none.cast("array<long>").alias("positions"))
    return rows.mapInArrow(_identified(net), _RESULT)


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
