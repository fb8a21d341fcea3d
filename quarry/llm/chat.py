"""Operator 7: chat formatting by a finite-state machine and a declarative template, in DataFrame functions only.

Control strings inside texts are escaped reversibly: a backslash becomes \\e, and the first character of a control
string becomes \\l (for <) or \\b (for [), so formatted text holds control strings only where the template put them.

Defined results: a null text is empty; a null role is the role ''; a role the template does not name gets a marker
with its escaped name; turns that tie are ordered by role, then text; rows without conv_id are one conversation; a
conversation whose turn order the machine rejects is formatted all the same, with valid = false; repeated rows are
repeated turns; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, read


@dataclass(frozen=True)
class Template:
    """Markers around the text of each role, the roles whose texts carry loss, and the machine's transitions."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" [OUT]", "[/OUT]</s>\n")})
    #: Around the name of any other role, and after its text.
    other: tuple[str, str, str] = ("<|role ", "|>", "<|end|>\n")
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "<|role ", "|>", "<|end|>")
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("user", "assistant")


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in sorted(template.control, key=len, reverse=True):
        first = {"<": "\\l", "[": "\\b", "|": "\\p"}[c[0]]
        out = F.replace(out, F.lit(c), F.lit(first + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\p", "|"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _segments(turn: Column, template: Template) -> Column:
    """The turn as (text, loss) segments: marker, escaped text, marker."""
    role = turn["role"]
    head = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
    tail = F.lit(template.other[2])
    for name, (before, after) in template.markers.items():
        head, tail = F.when(role == name, F.lit(before)).otherwise(head), F.when(role == name, F.lit(after)).otherwise(tail)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(part(head, F.lit(False)), part(escape(turn["text"], template), role.isin(*template.loss_roles)), part(tail, F.lit(False)))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, valid, segments array<struct<text, loss>> and formatted (their texts in order)."""
    template = template or Template()
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.transitions.items() for x in (f"{s}\n{r}", to)])
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), t["role"])), F.lit("rejected")))
    chats = chats.select("conv_id", state.isin(*template.accepting).alias("valid"), F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"))
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that formatted text holds, unescaped."""
    template = template or Template()
    name, close, end = template.other
    ends = [after for _, after in template.markers.values()] + [end]
    pieces = F.filter(F.split(formatted, "(?:" + "|".join(_quoted(x) for x in ends) + ")", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        named = F.substring_index(F.substr(p, F.lit(len(name) + 1)), close, 1)
        out = F.struct(unescape(named).alias("role"), unescape(F.substr(p, F.length(named) + len(name) + len(close) + 1)).alias("text"))
        for role, (before, _) in template.markers.items():
            out = F.when(p.startswith(before), F.struct(F.lit(role).alias("role"), unescape(F.substr(p, F.lit(len(before) + 1))).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def _quoted(x: str) -> str:
    return "".join(c if c.isalnum() or c in "\n <>/" else "\\" + c for c in x)


def loss_text(segments: Column) -> Column:
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


#: The contract's conversation -1: control strings in both texts.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = format_chats(turns.union(probe)).withColumn("loss_text", loss_text(F.col("segments"))).withColumn("turns", parse_chats(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def _sql() -> str:
    t = Template()
    escaped = "replace(text, '\\', '\\e')"
    for c in sorted(t.control, key=len, reverse=True):
        escaped = f"replace({escaped}, '{c}', '{ {'<': chr(92) + 'l', '[': chr(92) + 'b', '|': chr(92) + 'p'}[c[0]] + c[1:]}')"
    sizes = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.markers.items())
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
),
ordered AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped}) + CASE role {sizes} ELSE {sum(map(len, t.other))} + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN nth = 1 THEN role IN ('system', 'user')
    ELSE before || '>' || role IN ('system>user', 'user>assistant', 'assistant>user') END)
    AND arg_max(role, nth) IN ('user', 'assistant') AS valid
FROM ordered GROUP BY conv_id"""


ORACLE = _sql()
