"""Alignment of two tokenizers against tokens of whole texts laid side by side."""

import hashlib
import random
from collections import Counter

import pytest

from quarry.llm import alignment

SCHEMA = "doc_id long, text string, lang string, unit long, n int, _key string"
ODD = ["a  b   c ", " x", "  x", "\n", "\n\nA\n b", "a\n  b", "tab\there\t x", "a\r\n b ", "é ü ñ　 x", " z   y", "<|endoftext|> <s> </s> <unk> x", "▁bad ▁", "fine ▁", "日本語 テキスト🙂 ok", "ﬁ ǅ İ ́e", "\x00 a\x1c b\x85 c", "it's don't WE'LL", "aaaaaaaaaaaaaaaaaaaaaaaa aaaa", "   ", "x ", "<0x0A> \\n", "é́ क्षि", "#tag ##"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = "the house Haus größer été niño don't 12345 3.14 http://a.b/c?d=e foo_bar (x) [y]; ... naïve Straße über".split()
    seps = [" ", " ", " ", " ", "\n", "  ", "\n\n", "\t", " \n", ", ", "\r\n", " "]
    made = ["".join(rng.choice(words) + rng.choice(seps[: rng.choice([4, 5, 12])]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    made += ["".join(rng.choice("ab \n\t .é▂日🙂'　") for _ in range(rng.randrange(30))) for _ in range(80)]
    return [*made, *ODD, None, "", made[0], "q" * 5000 + " tail"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_tokenizers())


def direct(pair, text):
    """Tokens of the whole text as (id, start, end) for both sides, or none."""
    if not text:
        return [], []
    sides = []
    for ids, names in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(names[i])))
            at += len(names[i])
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return [], []
        sides.append(out)
    return sides


def brute(pair, texts):
    sides = [direct(pair, t) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 400 else None for a, b in sides]
    for k, (a, b) in enumerate(sides):
        if links[k] is None:  # a long text: walk both sides
            i = j = 0
            links[k] = []
            while i < len(a) and j < len(b):
                links[k].append((a[i][0], b[j][0]))
                x, y = a[i][2], b[j][2]
                i, j = i + (x <= y), j + (y <= x)
    counts = Counter(p for ls in links for p in ls)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    for (a, b), ls in zip(sides, links, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(t[0]) for t in side if lo < t[2] <= hi) for side in (a, b)))
            lo = hi
        yield (len(a), len(b), len(cuts), len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), ";".join(groups))


def test_alignment_matches_whole_texts(spark, texts, pair):
    df = spark.createDataFrame([(i, t, "en", 1, 2, "k") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    want = dict(enumerate(brute(pair, texts)))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df).collect()}
    assert len(got) == len(texts)
    wrong = [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong[:3]
    assert sum(w[0] == 0 for w in want.values()) >= 3 and sum(w[1] for w in want.values()) > 3000
    digests = {r.doc_id: r.groups_sha256 for r in alignment.align(df, digest=True).collect()}
    assert all(digests[i] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in want.items())


def test_small_lists_and_shuffled_counts_give_the_same(spark, texts, pair, monkeypatch):
    df = spark.createDataFrame([(None if i % 7 == 0 else i, t, "en", 1, 2, "k") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    monkeypatch.setattr(alignment, "CHUNK_DISTINCT", 40)
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda t: t)
    monkeypatch.setattr(alignment, "BLOCK_UNITS", 64)
    got = sorted(tuple(r)[1:] for r in alignment.align(df, parts=8).collect())
    assert got == sorted(brute(pair, texts))


def test_plain_characters_are_given_back(pair):
    assert all(pair.same(" a" + chr(c) + "b") for r in (range(32, 127), range(0xC0, 0x250), (9, 11, 12, 13)) for c in r)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
