"""Text and path columns: line metrics, languages, package paths, slices (MET-1, MET-18, PAR-13, PRJ-1, PRJ-2, PRJ-8, PRJ-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every break that Python's splitlines knows, and Unicode white space for strip.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
WHITE = "[\\s\x1c-\x1f\u0085   -     　]"
INK = WHITE.replace("[", "[^", 1)

#: Language by file suffix; other suffixes are OTHER.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".less": "css", ".c": "c", ".h": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".swift": "swift", ".rb": "ruby", ".php": "php",
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """The lines of a text, without an empty last one; null and empty give none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return let(parts, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{WHITE}+|{WHITE}+$", "")


def line_counts(text: Column, comment: str = "#") -> Column:
    """struct(loc, blank_lines, comment_lines); comment is the line prefix that marks comments.

    The text is split once and a line is tested by one search that stops at its first visible character.
    """
    begin = "^" + WHITE + "*"
    shown = lambda x: x.rlike(INK)
    noted = lambda x: x.contains(comment) & x.rlike(begin + "".join(c if c.isalnum() else "\\" + c for c in comment))
    number = lambda a: F.size(a).cast("bigint")
    return let(lines(text), lambda x: F.struct(number(x).alias("loc"), (number(x) - number(F.filter(x, shown))).alias("blank_lines"), number(F.filter(x, noted)).alias("comment_lines")))


def line_metrics(counts: Column) -> dict[str, Column]:
    """loc, blank_lines, comment_lines, sloc and comment_density from a column of line_counts."""
    loc, blank, notes = (counts[c] for c in ("loc", "blank_lines", "comment_lines"))
    return {"loc": loc, "blank_lines": blank, "comment_lines": notes, "sloc": F.greatest(loc - blank - notes, F.lit(0).cast("bigint")), "comment_density": F.when(loc > 0, notes / loc).otherwise(0.0)}


def physical_lines(text: Column) -> Column:
    """Newlines, and one more where text follows the last."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("bigint")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1."""
    return F.array_join(F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def truncated(text: Column, limit: int, marker: str = "# ... truncated ...") -> Column:
    """At most limit lines, with a marker line where some were cut."""
    found = lines(text)
    return F.when(F.size(found) > limit, F.concat(F.array_join(F.slice(found, 1, limit), "\n"), F.lit("\n" + marker))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix(path)), F.lit("other"))


def package_path(path: Column) -> Column:
    """pkg/sub/mod.py to pkg.sub.mod; an __init__ stands for its package."""
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?<=[^/.])\.[^./]+$", "")
    return F.replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def safe_name(raw: Column, limit: int = 120) -> Column:
    """Letters, digits, dots, dashes and underscores; runs of others become one dash."""
    name = F.substring(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""), 1, limit)
    return F.when(name == "", "project").otherwise(name)


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a quote in front (SNK-10)."""
    return F.when(cell.rlike(r"^[=+@-]"), F.concat(F.lit("'"), cell)).otherwise(cell)
