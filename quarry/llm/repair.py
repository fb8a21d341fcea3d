"""Operator 11: conversation structure repair as one fold of Spark SQL's higher-order functions.

Windows over a conversation's rows in order give each row its first fault and count the order's own faults; the rows
are collected as sorted structs, and aggregate() carries the cheapest (cost, audit) of each of four states - nothing
yet, after a system, a user, an assistant turn - through native least() expressions. An audit names the edits in
order: K keep, R rerole, D delete, I insert. The state before an edit determines what R and I write, so the audit
alone rebuilds the repaired turns. Of equal costs the ASCII-least audit wins; appending the same edit to two audits
of one state keeps their order, as neither can begin the other (that would need inserts, which cost more).

One exchange by conversation serves the windows and the collection. A conversation is one row, since its repair and
the digest of its text are single values; appending to audits copies their length for each row of the conversation.

Defined results: null conv_id, turn, role or text: null conv_ids are one conversation, null turns sort first and
count in no gap, null roles and texts are one space (so such a text is blank); in the damage key a null is one space;
rows that tie in turn are ordered by role, then text; repeated rows are duplicates but for the first; empty texts are
blank; an empty role has no initial, so every pair with it is illegal; turns too far apart for a long give a null gap;
a conversation whose rows are all dropped has zeros, no audit and no turns; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read

#: What the edits cost; an undeleted truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Fixed by the contract: white space, sentence ends, legal pairs of role initials.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
#: The states of the fold: nothing yet, after a system, a user, an assistant turn; the first and the last may end.
STATES = ("0", "s", "u", "a")

_STATE = "struct<cost:bigint,audit:string>"


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: rows dropped (alive is then false), emptied, stripped of sentence ends, repeated, reroled."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, "".join(ENDS), "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode_outer(F.array_repeat(F.lit(True), copies)).alias("alive"))
    return rows.withColumn("alive", F.coalesce("alive", F.lit(False)))


def _flagged(rows: DataFrame) -> DataFrame:
    """Each row's place and first fault, and what its pair with the row before says; dropped rows come first and say nothing."""
    order = Window.partitionBy("conv_id").orderBy("alive", F.asc_nulls_first("turn"), "role", "text")
    said = Window.partitionBy("conv_id", "alive", "role", "text").orderBy("pos")
    alive, initial = F.col("alive"), F.substring("role", 1, 1)
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    rows = rows.withColumns(
        {
            "pos": F.row_number().over(order),
            "before": F.lag(F.when(alive, initial)).over(order),
            "turn_before": F.lag(F.when(alive, F.col("turn"))).over(order),
        }
    ).withColumn("nth", F.row_number().over(said))
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(*ENDS), "truncated")
    return rows.select(
        "conv_id", "turn", "role", "text", "alive", "pos", initial.alias("initial"),
        F.when(alive, fault).alias("fault"),
        (alive & F.col("before").isNotNull() & ~F.concat("before", initial).isin(*LEGAL)).alias("illegal"),
        (alive & F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))).alias("new_turn"),
    )


def _paid(state: Column, cost: Column, edit: str) -> Column:
    """The state after one more edit; a null state, or a null cost, gives null: it cannot be reached."""
    total = state["cost"] + cost
    return F.when(total.isNotNull(), F.struct(total.alias("cost"), F.concat(state["audit"], F.lit(edit)).alias("audit")))


def _inserted(states: dict[str, Column]) -> dict[str, Column]:
    """The states with empty turns inserted where that is cheaper: a user turn, then an assistant turn."""
    five = F.lit(INSERT).cast("bigint")
    user = F.least(states["u"], *[_paid(states[k], five, "I") for k in ("0", "s", "a")])
    return {**states, "u": user, "a": F.least(states["a"], _paid(states["u"], five, "I"), *[_paid(_paid(states[k], five, "I"), five, "I") for k in ("0", "s")])}


def _step(s: Column, r: Column) -> Column:
    """The fold over one row: inserts before it, then keep, rerole or delete it."""
    at = _inserted({k: s[k] for k in STATES})
    standing = F.when(~r["required"], F.when(r["truncated"], F.lit(TRUNCATED)).otherwise(0).cast("bigint"))
    keep = {k: F.when(r["initial"] == k, standing) for k in "sua"}
    rerole, delete = standing + REROLE, F.lit(DELETE).cast("bigint")
    gone = {k: _paid(at[k], delete, "D") for k in STATES}
    to_user = [_paid(at[k], cost, edit) for k in ("0", "s", "a") for cost, edit in ((keep["u"], "K"), (rerole, "R"))]
    return F.struct(
        gone["0"].alias("0"),
        F.least(gone["s"], _paid(at["0"], keep["s"], "K")).alias("s"),
        F.least(gone["u"], *to_user).alias("u"),
        F.least(gone["a"], _paid(at["u"], keep["a"], "K"), _paid(at["u"], rerole, "R")).alias("a"),
    )


def _cheapest(rows: Column) -> Column:
    none = F.lit(None).cast(_STATE)
    start = F.struct(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")).alias("0"), none.alias("s"), none.alias("u"), none.alias("a"))

    def ended(s: Column) -> Column:
        return F.least(s["0"], _inserted({k: s[k] for k in STATES})["a"])

    return F.aggregate(rows, start, _step, ended)


def _repaired(rows: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit makes of the rows; next is the row that the next edit but I is about."""
    named = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("asked"), F.array().cast("array<struct<place:int,role:string,edit:string>>").alias("out"))

    def edited(s: Column, edit: Column) -> Column:
        row = F.try_element_at(rows, s["next"])
        role = F.when(edit == "K", row["role"]).otherwise(F.when(s["asked"] == 1, "assistant").otherwise("user"))
        user = F.when(edit == "D", s["asked"]).when(F.substring(role, 1, 1) == "u", 1).otherwise(0)
        made = F.when(edit == "D", F.array().cast("array<struct<place:int,role:string,edit:string>>")).otherwise(F.array(F.struct(F.when(edit != "I", s["next"]).alias("place"), role.alias("role"), edit.alias("edit"))))
        return F.struct((s["next"] + F.when(edit == "I", 0).otherwise(1)).alias("next"), user.alias("asked"), F.concat(s["out"], made).alias("out"))

    edits = F.filter(F.split(audit, ""), lambda e: e != "")
    placed = F.aggregate(edits, start, edited, lambda s: s["out"])
    return F.transform(placed, lambda p: named(p["role"], F.coalesce(F.try_element_at(rows, p["place"])["text"], F.lit(""))))


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text; alive where it is given, false for rows that are gone):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns array<struct<role, text>>.
    """
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), alive.alias("alive"))
    one = F.struct("pos", "role", "text", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("required"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))
    turn = F.when(F.col("alive"), F.col("turn"))
    span = F.try_add(F.try_subtract(F.max(turn), F.min(turn)), F.lit(1).cast("bigint"))
    chats = _flagged(rows).groupBy("conv_id").agg(
        F.when(F.count(turn) > 0, span - F.count_if("new_turn")).otherwise(0).alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.when(F.col("alive"), one))).alias("rows"),
    )
    chats = chats.withColumn("best", _cheapest(F.col("rows")))
    return chats.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _repaired(F.col("rows"), F.col("best.audit")).alias("turns"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = repair(damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return chats.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL: states are strings of a cost in 12 digits and its audit, folded row by row in a recursive query."""
    ws, tail = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    paid = lambda x, cost, edit: f"(lpad(CAST(CAST({x}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {x}[13:] || '{edit}')"
    i = lambda x: paid(x, INSERT, "I")
    standing = f"CASE WHEN required THEN NULL WHEN truncated THEN {TRUNCATED} ELSE 0 END"
    keep = lambda k: f"CASE WHEN initial = '{k}' THEN {standing} END"
    rerole = f"({standing} + {REROLE})"
    inserted = lambda t: f"{t}.n, least({t}.u, {i(f'{t}.n')}, {i(f'{t}.s')}, {i(f'{t}.a')}) AS u"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
),
kinds AS (SELECT *, {crc} % 20 AS kind FROM named),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, role[1:1] AS initial FROM rows),
faults AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before, CASE
    WHEN NOT regexp_matches(text, '{ws}') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '{tail}') THEN 'truncated' END AS fault FROM placed
),
judged AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS required, coalesce(fault = 'truncated', false) AS truncated FROM faults
),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM judged GROUP BY conv_id
),
fold AS (
  SELECT conv_id, 0 AS pos, lpad('', 12, '0') AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, {paid("n", DELETE, "D")}, least({paid("s", DELETE, "D")}, {paid("n", keep("s"), "K")}),
    least({paid("u", DELETE, "D")}, {", ".join(paid(k, c, e) for k in "nsa" for c, e in ((keep("u"), "K"), (rerole, "R")))}),
    least({paid("a", DELETE, "D")}, {paid("u", keep("a"), "K")}, {paid("u", rerole, "R")})
  FROM (
    SELECT *, least(a0, {i("u")}) AS a FROM (
      SELECT judged.*, fold.s, fold.a AS a0, {inserted("fold")}
      FROM fold JOIN judged ON judged.conv_id IS NOT DISTINCT FROM fold.conv_id AND judged.pos = fold.pos + 1
    )
  )
),
best AS (
  SELECT fold.conv_id, least(n, a, {i("u")}, {i(i("n"))}, {i(i("s"))}) AS best FROM fold
  LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM fold.conv_id WHERE pos = coalesce(size, 0)
),
told AS (
  SELECT conv_id, 1 AS k, 1 AS next, false AS asked, []::VARCHAR[] AS said, best[13:] AS audit FROM best
  UNION ALL
  SELECT conv_id, k + 1, CASE WHEN edit = 'I' THEN next ELSE next + 1 END,
    CASE WHEN edit = 'D' THEN asked ELSE made[1:1] = 'u' END,
    CASE WHEN edit = 'D' THEN said ELSE list_append(said, made || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END, audit
  FROM (
    SELECT told.*, audit[k:k] AS edit, judged.text,
      CASE WHEN audit[k:k] = 'K' THEN judged.role WHEN asked THEN 'assistant' ELSE 'user' END AS made
    FROM told LEFT JOIN judged ON judged.conv_id IS NOT DISTINCT FROM told.conv_id AND judged.pos = told.next WHERE k <= length(audit)
  )
)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best[1:12] AS BIGINT) AS cost, told.audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM best LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM best.conv_id
JOIN told ON told.conv_id IS NOT DISTINCT FROM best.conv_id AND told.k = length(told.audit) + 1"""


ORACLE = _sql()
