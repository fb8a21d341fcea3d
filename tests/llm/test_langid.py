"""The byte network against finite differences and a plain walk over the bytes, and its accuracy on held-out documents."""

import math
import random
import zlib

import numpy as np
import pytest

from quarry.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, h int"
SYLLABLES = {"aa": "ka lo mi tu re na so".split(), "bb": "brg schn pf gnu ßt üch örk".split(), "cc": "ção nha lhe são ém que çal".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))).capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, prose(rng, lang, rng.randrange(1, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [6, 2, 1], k=300))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ... \n", "bb"), (None, "kalo mitu", None), (1004, "x" * 200_000, None), (1005, "KALO　mitu 7", None), out[4], (1006, "日本 kalo", None)]
    return [*out, *odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def net(docs):
    return langid.fit(docs)


def walked(net, text):
    """Position by position, without padding, batches or memory."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    size = len(w["uf"])

    def states(d, part):
        h, out = np.zeros(size), []
        for b in part:
            i, s = w[f"x{d}"][b], h @ w[f"u{d}"]
            z = 1 / (1 + np.exp(-(i[:size] + s[:size])))
            r = 1 / (1 + np.exp(-(i[size : 2 * size] + s[size : 2 * size])))
            n = np.tanh(i[2 * size :] + r * (s[2 * size :] + w[f"c{d}"]))
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    total, positions = np.zeros(len(net.langs)), 0
    for word in (text or "").lower().split():
        if not any(c.isalpha() for c in word):
            continue
        raw = b" " + word.encode()
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            for f, b in zip(states("f", part), states("b", part[::-1])[::-1], strict=True):
                e = np.exp(np.concatenate([f, b]) @ w["out"] + w["bias"])
                total += e / e.sum()
                positions += 1
    return total / max(1, positions), positions


def test_gradients_are_those_of_finite_differences():
    w = langid.fresh_weights(3, 4)
    x = np.array([[32, 97, 98], [32, 99, 120], [32, 97, 32]]).T
    real = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0]], float).T
    y, weight = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    loss, g = langid.gradients(w, x, real, y, weight)
    assert math.isfinite(loss) and set(g) == set(w)
    for k, a in w.items():
        for i in [(97, 3), (98, 5), (32, 9)] if k[0] == "x" else [tuple(np.random.default_rng(s).integers(0, n) for n in a.shape) for s in range(5)]:
            was, step = a[i], 1e-5
            a[i] = was + step
            up = langid.gradients(w, x, real, y, weight)[0]
            a[i] = was - step
            down = langid.gradients(w, x, real, y, weight)[0]
            a[i] = was
            assert abs((up - down) / (2 * step) - g[k][i]) < 1e-7


def test_predictions_are_those_of_a_walk_over_the_bytes(docs, rows, net):
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        for r in by_id[i]:
            assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
            if not text or not any(c.isalpha() for c in text):
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            assert sum(r.positions) == sum(len(b" " + w.encode()) for w in text.lower().split() if any(c.isalpha() for c in w))
            if len(text) < 200:
                p, n = walked(net, text)
                assert np.allclose(p, r.probabilities, atol=1e-4) and sum(r.positions) == n
            assert 0 <= r.score <= 1 and r.score == pytest.approx(max(r.probabilities), abs=1e-9)
            assert r.lang_pred == net.langs[int(np.argmax(r.probabilities))]


def test_held_out_accuracy(docs, rows, net):
    assert net.langs == ["aa", "bb", "cc"]
    truth = {i: lang for i, _, lang in rows[:300]}
    got = [r for r in langid.identify(docs, net).where("held_out").collect() if r.doc_id in truth]
    assert len(got) > 50
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def test_memory_that_forgets_gives_the_same(docs, net, monkeypatch):
    want = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(docs, net).collect()}
    monkeypatch.setattr(langid, "REMEMBERED", 5)
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(docs, net).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_held_out_rows_labels_and_other_columns_teach_nothing(spark, rows):
    """Nothing but training rows' text and lang changes the network."""
    changed = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (langid.fit(spark.createDataFrame([(*r, str(k), k) for r in rs], SCHEMA).coalesce(1)) for k, rs in enumerate((rows, changed)))
    assert a.langs == b.langs and all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_empty_table_and_no_languages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    some = spark.createDataFrame([(1, "some text", None, "x", 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.identify(some, langid.fit(some)).collect()] == [("und", 0.0)]
