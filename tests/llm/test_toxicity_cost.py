"""The toxicity decoder: nothing is lost where lattices are left out or states dropped, and odd texts cost little."""

import random
import time
from collections import Counter

import pytest

from quarry.llm import toxicity

LEXICON = {"idiot": 3.0, "idio*": 3.0, "loser": 2.5, "lose*": 2.5, "trash": 2.0, "tras*": 2.0, "scum": 2.0, "é": 0.1, "moron": 2.2}
SOUND = "the house of the river is green and a loser is no idiot in his trash with lasso total stile geboten dog bad cafe decade".split()


@pytest.fixture(scope="module")
def model():
    grams = Counter()
    rng = random.Random(1)
    for w in SOUND * 50 + ["".join(rng.choice("aeioulstrndm") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]:
        w = f"^^{w}$"
        grams.update(w[i : i + 3] for i in range(len(w) - 2))
    return toxicity.CharModel(grams)


class Everything(toxicity.Spellings):
    """Leaves no lattice out."""

    def met(self, token, breaks=False):
        return True


def all_paths(model, token, breaks):
    """Every reading of a short lattice with its least cost, by walking all paths."""
    found = {}

    def walk(i, a, b, out, cost):
        if i == len(token):
            if out:
                cost += model.cost(a, b, "$")
                found[out] = min(cost, found.get(out, 1e9))
            return
        ch, again = token[i], i and token[i] == token[i - 1]
        letter = bool(toxicity._LETTER.match(ch))
        arcs = [(ch, 0.0)] if letter else [(c, toxicity.COST["leet"]) for c in toxicity.LEET.get(ch, "")]
        if not letter:
            arcs.append(("", toxicity.COST["separator"] if ch in toxicity.SEPARATORS or ch.isspace() else toxicity.COST["drop"]))
        if again:
            arcs.append(("", toxicity.COST["repeat"]))
        for c, n in arcs:
            if not c:
                walk(i + 1, a, b, out, cost + n)
                continue
            walk(i + 1, b, c, out + c, cost + n + model.cost(a, b, c))
            if breaks and b != "^":
                walk(i + 1, "^", c, f"{out} {c}", cost + n + model.cost(a, b, "$") + toxicity.COST["break"] + model.cost("^", "^", c))

    walk(0, "^", "^", "", 0.0)
    return sorted((c, r) for r, c in found.items())


def test_readings_are_the_best_of_all_paths(model):
    rng = random.Random(4)
    for k in range(250):
        token = "".join(rng.choice(["a1d0st!", "0123456789abcdef", "a.-b11", "é1sß|0"][k % 4]) for _ in range(rng.randrange(1, 8)))
        for breaks in (False, True):
            every = all_paths(model, token, breaks)
            got = model.readings(token, breaks)
            costs = dict((r, c) for c, r in every)
            assert len(got) == min(3, len(every)) and [costs[r] for r in got] == pytest.approx([c for c, _ in every[: len(got)]])


def test_lattices_left_out_change_no_evidence(model, monkeypatch):
    rng = random.Random(5)
    leet = {"o": "0o", "i": "1i!|", "s": "5$s", "e": "3e", "a": "4@a", "t": "7t"}
    texts = []
    for _ in range(150):
        words = ["".join(rng.choice(leet.get(c, c)) + rng.choice(["", "", ".", " ", c]) for c in rng.choice([*LEXICON, *SOUND]).rstrip("*")) if rng.random() < 0.5 else "".join(rng.choice("0123456789abcdef@!|l") for _ in range(rng.randrange(1, 70))) for _ in range(5)]
        texts.append(" ".join(words))
    got = [toxicity._evidence(model.tri, LEXICON)(t) for t in texts]
    monkeypatch.setattr(toxicity, "Spellings", Everything)
    assert got == [toxicity._evidence(model.tri, LEXICON)(t) for t in texts]
    assert sum(g[0] > 0 for g in got) > 30


def test_a_megabyte_of_hex_base64_and_spaced_letters(model):
    rng = random.Random(6)
    of = toxicity._evidence(model.tri, LEXICON)
    blobs = ["".join(rng.choice("0123456789abcdef") for _ in range(1 << 20)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1 << 20)), " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 19)), "1!" * (1 << 19)]
    began = time.process_time()
    assert all(len(of(b)) == 3 for b in blobs)
    assert time.process_time() - began < 60


def test_repeated_rows_and_clashing_columns(spark):
    texts = ["you 1d10t go away", "a calm text about rivers", "what an i d i o t you are", "the house is green", None, ""]
    rows = [(i, texts[i % len(texts)], 9, 0.5, True, "x") for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, toxic int, score double, held_out boolean, weight string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % len(texts) in (0, 2)), "y") for i in range(60)], "doc_id long, toxic int, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 61 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id % len(texts)], set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
