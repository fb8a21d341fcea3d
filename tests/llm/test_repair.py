"""Conversation repair against all edits tried out, and its defined results on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

from quarry.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos string, alive_ int"
LEGAL = re.compile("(s?(ua)+)?")


def ordered(rows):
    """Rows of one conversation with nulls as one space, in the defined order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


INSERTS = [i for n in range(3) for i in itertools.product("ua", repeat=n)]


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit of every row, with up to two inserts at each place."""
    marks, best = faults(rows), None
    kinds = [("K", r) for r in ("",)] + [("R", "user"), ("R", "assistant"), ("D", None)]
    for edits in itertools.product(kinds, repeat=len(rows)):
        cost, bad = 0, False
        for (edit, _), mark in zip(edits, marks, strict=True):
            bad |= edit != "D" and mark in ("blank", "duplicate")
            cost += {"K": 0, "R": 1, "D": 2}[edit] + (5 if edit != "D" and mark == "truncated" else 0)
        if bad or (best and cost > best[0]):
            continue
        for places in itertools.product(INSERTS, repeat=len(rows) + 1):
            total = cost + 5 * sum(map(len, places))
            if best and total > best[0]:
                continue
            audit, said = "", []
            for i, place in enumerate(places):
                for k in place:
                    audit, said = audit + "I", [*said, ({"u": "user", "a": "assistant"}[k], "")]
                if i < len(rows):
                    audit += edits[i][0]
                    if edits[i][0] != "D":
                        said.append((edits[i][1] or rows[i][1], rows[i][2]))
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in said)) and (best is None or (total, audit) < best[:2]):
                best = (total, audit, said)
    return best


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut off", "", "  \n", None, "Why?"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    chats = {c: [(rng.choice([None, 0, 1, 2, 5]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(4))] for c in range(70)}
    chats[None] = [(1, "user", "Hi."), (1, "user", "Hi.")]
    rows = [(c, *r, "x", 1) for c, rs in chats.items() for r in rs]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == {c for c, rs in chats.items() if rs}
    for c, r in got.items():
        want = ordered(chats[c])
        marks, turns = faults(want), {t for t, _, _ in want if t is not None}
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(want))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        cost, audit, said = cheapest(want)
        assert (r.cost, r.audit, [(t.role, t.text) for t in r.turns]) == (cost, audit, said), (c, want)


def test_damage_and_conversations_that_lose_every_row(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Turn {t} of {c}. Is it?", "x", 1) for c in range(60) for t in range(4)]
    lost = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone.", "x", 1)]
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA)).where("alive").select("conv_id", "turn", "role", "text").collect()
    want = []
    for c, t, role, text, *_ in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(tuple, got)) == sorted(want)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in repair.op11_repair(spark, str(tmp_path)).collect()}
    assert len(out) == 61
    assert tuple(out[lost])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t}.", "x", 1) for t in range(3000)]
    r = repair.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.cost, len(r.turns)) == (4, 2998) and r.audit == "D" + "K" * 2998 + "D"
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
