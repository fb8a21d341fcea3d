"""Source texts to entity rows: a Python parser in one Arrow pass, and a pattern parser as columns (PAR-1..12, MET-2..6, MET-10..15)."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: First parameters that stand for the object, and numbers that are not magic.
RECEIVERS = frozenset({"self", "cls", "mcs", "metacls"})
BENIGN = (0, 1, -1, 2)

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_TRIES = (ast.Try, ast.TryStar)

#: The operator that a kind of syntax node counts as.
OPERATORS = {
    "If": "if", "IfExp": "if-exp", "For": "for", "AsyncFor": "async-for", "While": "while", "Try": "try", "TryStar": "try", "ExceptHandler": "except", "With": "with", "AsyncWith": "async-with",
    "Return": "return", "Yield": "yield", "YieldFrom": "yield-from", "Await": "await", "Raise": "raise", "Assert": "assert", "Lambda": "lambda", "Delete": "del", "Global": "global", "Nonlocal": "nonlocal",
    "Import": "import", "ImportFrom": "import-from", "Break": "break", "Continue": "continue", "Pass": "pass", "Match": "match", "Starred": "*", "Slice": "slice", "Call": "()", "Subscript": "[]",
    "Attribute": ".", "Assign": "=", "AnnAssign": ":=", "NamedExpr": ":=", "List": "[]-literal", "Tuple": "()-literal", "Dict": "{}-literal", "Set": "{}-set",
}

ENTITY_DDL = (
    "project string, path string, seq int, entity_id string, entity_type string, name string, qualified_name string, parent string, start_line int, end_line int, parse_error string, "
    "references array<string>, called_names array<string>, accessed_fields array<string>, base_names array<string>, declared_fields array<string>, decorators array<string>, imports map<string,string>, "
    "attribute_roots array<string>, parameter_count int, has_self boolean, has_docstring boolean, cyclomatic int, cognitive int, nesting int, n_returns int, max_chain int, magic_numbers int, n_locals int, "
    "n1 int, n2 int, total_operators int, total_operands int, text string"
)


def _tail(node: ast.AST) -> str | None:
    """The name that an expression ends in: of a.b, b."""
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _chain(node: ast.Attribute) -> tuple[int, str | None]:
    """Number of links of an attribute chain, and the name at its root."""
    links, at = 0, node
    while isinstance(at, ast.Attribute):
        links, at = links + 1, at.value
    return links, at.id if isinstance(at, ast.Name) else None


def _thinking(node: ast.AST, nesting: int) -> int:
    """Boolean sequences and ternaries of an expression."""
    return sum(1 if isinstance(x, ast.BoolOp) else 1 + nesting for x in ast.walk(node) if isinstance(x, (ast.BoolOp, ast.IfExp)))


def cognitive(entity: ast.AST) -> int:
    """Cognitive complexity; a work list of (statement, nesting, whether it continues an if)."""
    work = [(s, 0, False) for s in getattr(entity, "body", [])]
    total = 0
    while work:
        node, depth, goes_on = work.pop()
        deeper: list[ast.stmt] = []
        level: list[ast.stmt] = []
        if isinstance(node, ast.If):
            total += (1 if goes_on else 1 + depth) + _thinking(node.test, depth)
            deeper = node.body
            if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
                work.append((node.orelse[0], depth, True))
            elif node.orelse:
                total += 1
                deeper = deeper + node.orelse
        elif isinstance(node, _LOOPS):
            total += 1 + depth + _thinking(node.test if isinstance(node, ast.While) else node.iter, depth) + bool(node.orelse)
            deeper = node.body + node.orelse
        elif isinstance(node, _TRIES):
            total += len(node.handlers) * (1 + depth)
            level = node.body + node.orelse + node.finalbody
            deeper = [s for h in node.handlers for s in h.body]
        elif isinstance(node, ast.Match):
            total += 1 + depth
            deeper = [s for c in node.cases for s in c.body]
        elif isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            deeper = node.body
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            level = node.body
        else:
            total += _thinking(node, depth)
        work += [(s, depth + 1, False) for s in deeper] + [(s, depth, False) for s in level]
    name = getattr(entity, "name", None)
    return total + any(isinstance(x, ast.Call) and name and _tail(x.func) == name for x in ast.walk(entity))


def nesting(entity: ast.AST) -> int:
    """Deepest nesting of control statements; except blocks are as deep as their try."""
    best, work = 0, [(s, 0) for s in getattr(entity, "body", [])]
    while work:
        node, depth = work.pop()
        depth += isinstance(node, (ast.If, *_LOOPS, *_TRIES, ast.Match))
        best = max(best, depth)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt):
                work.append((child, depth))
            elif isinstance(child, ast.ExceptHandler):
                work += [(s, depth) for s in child.body]
    return best


class Facts:
    """Everything one walk over an entity's nodes gives."""

    def __init__(self, entity: ast.AST) -> None:
        self.operators: Counter = Counter()
        self.operands: Counter = Counter()
        self.references: set[str] = set()
        self.called: list[str] = []
        self.own: set[str] = set()
        self.roots: list[str] = []
        self.bound: set[str] = set()
        self.paths, self.returns, self.longest, self.magic = 1, 0, 0, 0
        for node in ast.walk(entity):
            kind = type(node).__name__
            if kind in OPERATORS:
                self.operators[OPERATORS[kind]] += 1
            note = getattr(self, f"on_{kind}", None)
            if note:
                note(node)

    def _branch(self, node: ast.AST) -> None:
        self.paths += 1

    on_If = on_IfExp = on_ExceptHandler = on_Assert = on_For = on_AsyncFor = on_While = on_match_case = _branch

    def on_BoolOp(self, node: ast.BoolOp) -> None:
        self.paths += len(node.values) - 1
        self.operators[type(node.op).__name__] += max(1, len(node.values) - 1)

    def on_comprehension(self, node: ast.comprehension) -> None:
        self.paths += 1 + len(node.ifs)

    def _applied(self, node: ast.BinOp | ast.UnaryOp) -> None:
        self.operators[type(node.op).__name__] += 1

    on_BinOp = on_UnaryOp = _applied

    def on_AugAssign(self, node: ast.AugAssign) -> None:
        self.operators[type(node.op).__name__ + "="] += 1

    def on_Compare(self, node: ast.Compare) -> None:
        self.operators.update(type(op).__name__ for op in node.ops)

    def on_Return(self, node: ast.Return) -> None:
        self.returns += 1

    def on_Name(self, node: ast.Name) -> None:
        self.operands[node.id] += 1
        self.references.add(node.id)
        if isinstance(node.ctx, ast.Store):
            self.bound.add(node.id)

    def on_Attribute(self, node: ast.Attribute) -> None:
        self.operands[node.attr] += 1
        links, root = _chain(node)
        self.longest = max(self.longest, links)
        self.references.add(node.attr)
        if root:
            self.references.add(root)
            self.roots.append(root)
        if links == 1 and root in RECEIVERS:
            self.own.add(node.attr)

    def on_Constant(self, node: ast.Constant) -> None:
        self.operands[f"const:{node.value!r}"] += 1
        self.magic += isinstance(node.value, (int, float)) and not isinstance(node.value, bool) and node.value not in BENIGN

    def on_arg(self, node: ast.arg) -> None:
        self.operands[node.arg] += 1

    def _named(self, node: ast.FunctionDef | ast.ClassDef) -> None:
        self.operands[node.name] += 1

    on_FunctionDef = on_AsyncFunctionDef = on_ClassDef = _named

    def on_Call(self, node: ast.Call) -> None:
        name = _tail(node.func)
        if name:
            self.called.append(name)


def _parameters(node: ast.AST) -> list[str]:
    a = getattr(node, "args", None)
    if not isinstance(a, ast.arguments):
        return []
    return [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]


def _fields(node: ast.ClassDef) -> set[str]:
    """Names assigned in a class body, and attributes of the object assigned in its methods."""
    out: set[str] = set()
    for s in node.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        out |= {t.id for t in targets if isinstance(t, ast.Name)}
        for x in ast.walk(s) if isinstance(s, _FUNCTIONS) else ():
            targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AnnAssign, ast.AugAssign)) else []
            out |= {t.attr for t in targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id in RECEIVERS}
    return out


def _imports(tree: ast.AST) -> dict[str, str]:
    """Local name to dotted origin; the dots of relative imports do not count."""
    out: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.update((a.asname or a.name.partition(".")[0], a.name) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.update((a.asname or a.name, ".".join(filter(None, (node.module, a.name)))) for a in node.names)
    return out


def python_entities(project: str, path: str, module: str, text: str) -> list[dict]:
    """Rows of one file: its module, classes, functions and methods; one row with parse_error where it does not parse."""
    base = {"project": project, "path": path, "seq": 0, "entity_id": f"{path}::{module}", "entity_type": "module", "name": path.rpartition("/")[2], "qualified_name": module, "start_line": 1, "end_line": 1}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{**base, "parse_error": f"{type(e).__name__}: {e}"}]
    imports, lines, rows = _imports(tree), text.splitlines(), []

    def add(node: ast.AST, kind: str, name: str, qualified: str, parent: str | None) -> None:
        f = Facts(node)
        last = max((getattr(x, "end_lineno", None) or 0 for x in ast.walk(node)), default=1) if kind == "module" else node.end_lineno
        start = 1 if kind == "module" else node.lineno
        end = max(last or start, start)
        names = _parameters(node)
        positional = [x.arg for x in [*node.args.posonlyargs, *node.args.args]] if isinstance(node, _FUNCTIONS) else []
        origin = lambda b: b.value if isinstance(b, ast.Subscript) else b
        called = lambda d: d.func if isinstance(d, ast.Call) else d
        body = node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str)
        rows.append(base | {
            "seq": len(rows), "entity_id": f"{path}::{qualified}", "entity_type": kind, "name": name, "qualified_name": qualified, "parent": parent, "start_line": start, "end_line": end, "imports": imports,
            "references": sorted(f.references), "called_names": f.called, "accessed_fields": sorted(f.own) if kind in ("method", "function") else [], "attribute_roots": f.roots,
            "base_names": [t for b in node.bases if (t := _tail(origin(b)))] if kind == "class" else [], "declared_fields": sorted(_fields(node)) if kind == "class" else [],
            "decorators": [t for d in getattr(node, "decorator_list", []) if (t := _tail(called(d)))], "parameter_count": len(names), "has_self": bool(positional) and positional[0] in RECEIVERS, "has_docstring": bool(body),
            "cyclomatic": f.paths, "cognitive": cognitive(node), "nesting": nesting(node), "n_returns": f.returns, "max_chain": f.longest, "magic_numbers": f.magic, "n_locals": len(f.bound - set(names)),
            "n1": len(f.operators), "n2": len(f.operands), "total_operators": f.operators.total(), "total_operands": f.operands.total(), "text": "\n".join(lines[start - 1 : end]),
        })

    add(tree, "module", base["name"], module, None)
    work = [(s, module, False) for s in reversed(tree.body)]
    while work:
        node, scope, in_class = work.pop()
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            is_class, qualified = isinstance(node, ast.ClassDef), f"{scope}.{node.name}"
            add(node, "class" if is_class else "method" if in_class else "function", node.name, qualified, scope)
            work += [(s, qualified, is_class) for s in reversed(node.body)]
    return rows


_COLUMNS = [c.strip().split(" ")[0] for c in ENTITY_DDL.replace("map<string,string>", "map").split(",")]


def parse_python(files: DataFrame) -> DataFrame:
    """Entities of files (project, path, package, text); one parse of each file gives every syntactic fact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, path, module, text in pdf.itertuples(index=False) for r in python_entities(p, path, module, text)]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLUMNS})

    return files.select("project", "path", "package", "text").mapInPandas(run, ENTITY_DDL)


#: How class-like and function-like lines look in other languages, and names that are no functions.
CLASS_LINE = r"^\s*(?:public|private|protected|export|abstract|final|static)*\s*(?:class|interface|struct|type|enum)\s+([A-Za-z0-9_]+)"
FUNCTION_LINE = r"^\s*(?:public|private|protected|export|async|static|function|func|fn|def|void|int|float|double|char|boolean|bool|String|var|let|const)*\s*([A-Za-z0-9_]+)\s*\(([^)]*)\)"
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "return", "class", "interface", "struct")
CLASS_SPAN, FUNCTION_SPAN = 40, 15


def parse_lines(files: DataFrame, key: str, text: Column, bare_name: Column | None = None) -> DataFrame:
    """Entities by line patterns: (key, entity_type, name, owner, start_line, end_line, parameter_count) (PAR-11).

    A function belongs to the last class above it. A file without any entity is one class that holds 'execute', by the
    name bare_name; an empty file has no entity.
    A file stays one row until its entities are known: its lines are split once, and the patterns are tried only on
    lines that can match them.
    """
    rows = files.select(key, T.lines(text).alias("lines"), (F.lit("MainComponent") if bare_name is None else bare_name).alias("bare"))
    likely = lambda x: x.contains("(") | x.rlike("class|interface|struct|type|enum")
    rows = rows.select(key, "bare", F.size("lines").alias("n"), F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), x.alias("x"))), lambda s: likely(s["x"])).alias("seen"))
    matched = F.transform("seen", lambda s: F.struct(s["at"].alias("at"), F.when(s["x"].rlike("class|interface|struct|type|enum"), F.regexp_extract(s["x"], CLASS_LINE, 1)).otherwise("").alias("c"), F.when(s["x"].contains("("), F.regexp_extract(s["x"], FUNCTION_LINE, 0)).otherwise("").alias("m")))
    rows = rows.select(key, "bare", "n", F.filter(matched, lambda s: (s["c"] != "") | (s["m"] != "")).alias("met"))
    named = F.transform("met", lambda s: F.struct(s["at"].alias("at"), s["c"].alias("c"), F.when(s["c"] == "", F.regexp_extract(s["m"], FUNCTION_LINE, 1)).otherwise("").alias("f"), F.regexp_extract(s["m"], FUNCTION_LINE, 2).alias("args")))
    rows = rows.select(key, "bare", "n", F.filter(named, lambda s: (s["c"] != "") | ((s["f"] != "") & ~s["f"].isin(*NOT_FUNCTIONS))).alias("es"))
    rows = rows.withColumn("classes", F.filter("es", lambda s: s["c"] != ""))
    made = lambda kind, name, owner, start, end, count: F.struct(kind.alias("entity_type"), name.alias("name"), owner.cast("string").alias("owner"), start.alias("start_line"), end.alias("end_line"), count.alias("parameter_count"))

    def entity(s: Column) -> Column:
        is_class = s["c"] != ""
        owner = F.try_element_at(F.filter("classes", lambda c: c["at"] <= s["at"]), F.lit(-1))["c"]
        count = F.size(F.filter(F.split(s["args"], ","), lambda a: F.trim(a) != ""))
        end = F.least(F.col("n"), s["at"] + F.when(is_class, CLASS_SPAN).otherwise(FUNCTION_SPAN))
        return made(F.when(is_class, "class").otherwise("method"), F.when(is_class, s["c"]).otherwise(s["f"]), F.when(~is_class, owner), s["at"], end, F.when(is_class, 0).otherwise(count))

    bare = F.array(made(F.lit("class"), F.col("bare"), F.lit(None), F.lit(1), F.col("n"), F.lit(0)), made(F.lit("method"), F.lit("execute"), F.col("bare"), F.lit(1), F.col("n"), F.lit(1)))
    # outer: else the optimiser makes the array a second time to filter on its size
    return rows.select(key, F.explode_outer(F.when(F.size("es") > 0, F.transform("es", entity)).when(F.col("n") > 0, bare)).alias("e")).where("e is not null").select(key, "e.*")
