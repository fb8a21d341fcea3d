"""Source trees to findings: parser facts, metrics, graph, rules."""

import textwrap

import pytest
from pyspark.sql import functions as F

from quarry.operators import rules as R
from quarry.plans import analyze as A
from quarry.sources import inventory as I
from quarry.sources import parse as P


def method(body):
    rows = P.python_entities("p", "m.py", "m", textwrap.dedent(body))
    return next(r for r in rows if r["entity_type"] in ("function", "method"))


@pytest.mark.parametrize(
    "body, cyclomatic",
    [
        ("def f():\n    return 1", 1),
        ("def f(a):\n    if a:\n        return 1", 2),
        ("def f(a):\n    if a: x=1\n    elif a>1: x=2\n    elif a>2: x=3", 4),
        ("def f(a,b,c):\n    if a and b and c:\n        return 1", 4),
        ("def f(a):\n    for x in a:\n        try:\n            g()\n        except E:\n            pass", 3),
        ("def f(a):\n    return [x for x in a if x if x > 1]", 4),
    ],
)
def test_cyclomatic(body, cyclomatic):
    assert method(body)["cyclomatic"] == cyclomatic


@pytest.mark.parametrize(
    "body, cognitive, nesting",
    [
        ("def f(a):\n    if a:\n        for x in a:\n            if x and a or b:\n                pass", 1 + 2 + 3 + 2, 3),
        ("def f(a):\n    if a: pass\n    elif b: pass\n    else: pass", 3, 2),
        ("def f(a):\n    return f(a - 1) if a else 0", 2, 0),
        ("def f(a):\n    try:\n        g()\n    except E:\n        if a: pass", 1 + 2, 2),
        ("def f(a):\n    with a:\n        while b: pass", 1, 1),
        ("def f(a):\n    match a:\n        case 1: pass\n        case 2:\n            if b: pass", 1 + 2, 1),
    ],
)
def test_cognitive_and_nesting(body, cognitive, nesting):
    got = method(body)
    assert (got["cognitive"], got["nesting"]) == (cognitive, nesting)


def test_facts_of_a_class():
    src = '''
    import os.path as p, sys
    from .base import Base
    class A(Base, Generic[T]):
        """doc"""
        x = 1
        y: int = 2
        @property
        def go(self, a, *b, k=3, **c):
            self.z = a.b.c.d()
            self.x += 7
            total = p.join(a)
            return self.z
        def go(self): pass
    '''
    rows = P.python_entities("p", "pkg/m.py", "pkg.m", textwrap.dedent(src))
    cls, go = rows[1], rows[2]
    assert [r["qualified_name"] for r in rows] == ["pkg.m", "pkg.m.A", "pkg.m.A.go", "pkg.m.A.go"]
    assert cls["base_names"] == ["Base", "Generic"] and cls["declared_fields"] == ["x", "y", "z"] and cls["has_docstring"]
    assert go["decorators"] == ["property"] and go["parameter_count"] == 5 and go["has_self"] and go["accessed_fields"] == ["x", "z"]
    assert go["max_chain"] == 3 and go["magic_numbers"] == 2 and go["n_locals"] == 1 and go["n_returns"] == 1
    assert dict(cls["imports"]) == {"p": "os.path", "sys": "sys", "Base": "base.Base"} and go["called_names"] == ["join", "d"] or sorted(go["called_names"]) == ["d", "join"]
    assert P.python_entities("p", "bad.py", "bad", "def (")[0]["parse_error"].startswith("SyntaxError")


FILES = {
    "repo.py": "class Repository:\n    def find(self, k):\n        return k\n",
    "service.py": "from repo import Repository\nclass Service(Repository):\n    def __init__(self):\n        self.repo = Repository()\n        self.n = 0\n    def one(self):\n        if self.n:\n            for x in self.repo:\n                self.n += len(x) + len(str(x))\n        return helper()\n    def _two(self):\n        return self.repo\n",
    "deep.py": "from service import Service\nclass Deep(Service):\n    pass\nclass Loop(Loop):\n    pass\n",
    "build/skip.py": "class No:\n    pass\n",
    "env2/pyvenv.cfg": "home = x",
    "env2/lib/m.py": "class NoVenv:\n    pass\n",
    "bad.py": "def (",
    "gen_pb2.py": "x = 1",
    "app.js": "export class Cart {\n  add(item, n) {\n  }\n}\nif (x) {\n}\n",
    "latin.py": "# caf\xe9\nx = 1\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode("latin-1"))
    (root / "blob.py").write_bytes(b"a\0b")
    return root


def test_features(spark, tree):
    files, rejected, found = A.analyze(spark, str(tree))
    assert {r.path for r in files.collect()} == {"repo.py", "service.py", "deep.py", "bad.py", "app.js", "latin.py"}
    assert {r.path for r in found.collect()} == {"repo.py", "service.py", "deep.py", "app.js", "latin.py"}
    assert {(r.path, r.reason) for r in rejected.collect()} == {("build/skip.py", "excluded_path"), ("gen_pb2.py", "excluded_path"), ("blob.py", "binary")}
    by = {r.qualified_name: r for r in found.collect()}
    service, deep, repo, loop = (by[x] for x in ("service.Service", "deep.Deep", "repo.Repository", "deep.Loop"))
    assert (service.number_of_methods, service.number_of_public_methods, service.number_of_fields, service.wmc) == (3, 1, 2, 5)
    assert (service.cbo, service.fan_in, repo.cbo, repo.fan_in) == (1, 1, 0, 1)
    assert (repo.dit, service.dit, deep.dit, loop.dit) == (0, 1, 2, 1) and (repo.noc, service.noc, loop.noc) == (1, 1, 1)
    assert service.rfc == 3 + len({"Repository", "len", "str", "helper"})
    assert (service.lcom1, service.average_method_complexity) == (0, pytest.approx(5 / 3))
    assert service.cyclomatic_complexity is None and by["service.Service.one"].wmc is None
    assert by["service.Service.one"].nesting_depth == 2 and by["service"].loc == 12
    assert {k: len(v) for k, v in A.SCHEMA.items()} == {"class": 32, "method": 33, "function": 33, "module": 18}


def test_findings_of_a_tree(spark, tree):
    got = {(r.qualified_name, r.smell) for r in A.detect(spark, str(tree)).collect()}
    assert ("repo.Repository", "lazy_class") in got and ("deep.Deep", "refused_bequest") in got
    assert not any(q == "service.Service" and s == "god_class" for q, s in got)


def test_other_languages(spark):
    rows = spark.createDataFrame([("a.js", FILES["app.js"]), ("b.txt", "nothing\nhere")], "path string, text string")
    got = {(r.path, r.entity_type, r.name, r.owner, r.start_line, r.end_line, r.parameter_count) for r in P.parse_lines(rows, "path", F.col("text")).collect()}
    assert got == {("a.js", "class", "Cart", None, 1, 6, 0), ("a.js", "method", "add", "Cart", 2, 6, 2), ("b.txt", "class", "MainComponent", None, 1, 2, 0), ("b.txt", "method", "execute", "MainComponent", 1, 2, 1)}


def test_languages_by_their_parsers(spark, tree):
    rows = {r.entity_id: r for r in A.analyze(spark, str(tree), compatible=True)[2].where("language <> 'python'").collect()}
    cart, add, module = rows["cls:app.js:Cart:1"], rows["mth:app.js:add:2"], rows["mod:app.js"]
    assert (cart.qualified_name, add.qualified_name, add.parent, module.qualified_name) == ("app.js.Cart", "app.js.Cart.add", "app.js.Cart", "app.js")
    assert (cart.number_of_fields, cart.wmc, cart.loc, add.cyclomatic_complexity, add.parameter_count, add.maintainability_index) == (4.0, 1.0, 6.0, 2.0, 2.0, 0.0)
    assert cart.is_default and cart.cyclomatic_complexity is None
    plain = {r.entity_id: r for r in A.analyze(spark, str(tree))[2].where("language <> 'python'").collect()}
    assert plain["mth:app.js:add:2"].cyclomatic_complexity is None and plain["mth:app.js:add:2"].loc == 5.0
    smells = {(r.entity_id, r.smell) for r in A.detect(spark, str(tree), compatible=True).collect()}
    assert ("cls:app.js:Cart:1", "data_class") in smells
    assert A.wiring() == {"parsers": 2, "rules": 13, "class_features": 32, "method_features": 33, "function_features": 33, "module_features": 18}


def test_summary_of_entities(spark, tree):
    files = A.analyze(spark, str(tree))[0].where("language = 'python'").withColumn("project", F.lit("p"))
    assert {r.entity_type: r.n for r in A.summary(P.parse_python(files)).collect()} == {"class": 4, "method": 4, "function": 0, "module": 4, "failed": 1, "unresolved_bases": 0}
    with pytest.raises(ValueError):
        A.vectors_of(spark.range(1).withColumn("entity_type", F.lit("class")), "class")


def test_rules(spark):
    rows = [("a", "class", "A", [], [], 60.0, 0.9, 9.0), ("b", "class", "B", ["Enum"], [], 60.0, 0.9, 9.0), ("c", "class", "C", [], ["dataclass"], 200.0, 0.9, 30.0), ("d", "function", "d", [], [], 60.0, 0.9, 9.0), ("e", "class", "E", [], [], 188.0, 2.9, 20.0)]
    e = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, base_names array<string>, decorators array<string>, wmc double, lcom_hs double, cbo double")
    got = {r.entity_id: (r.smell, r.severity) for r in R.detect(e).collect()}
    assert got == {"a": ("god_class", "low"), "e": ("god_class", "critical")}
    assert len(R.built_in()) == 13 and sum(r.relative() for r in R.built_in()) == 9
    text = "version: 1\nexemption_sets:\n  s: {name_matches: ['X.*']}\nsmells:\n  big:\n    entity_type: class\n    exempt_if: {use: [s]}\n    conditions: [{metric: wmc, op: '>=', absolute: 47, percentile: 90}]\n"
    (rule,) = R.load_rules(text)
    assert rule.names == ("X.*",) and rule.relative()
    for bad in ("version: 2\nsmells: {}", text.replace("'>='", "'=='"), text.replace("90", "100"), text.replace("[s]", "[t]")):
        with pytest.raises(ValueError):
            R.load_rules(bad)


def test_archives(spark):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("ok.py", "x = 1"), ("../up.py", "x"), ("/abs.py", "x"), ("bomb.txt", "0" * 3_000_000)):
            z.writestr(name, text)
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "ok.py")
    members = I.unpack(spark.createDataFrame([("a.zip", raw.getvalue())], "path string, content binary"))
    why = {r.path: r.why for r in members.select("path", I.screen_member(F.col("path"), F.col("size"), F.col("packed"), F.col("kind")).alias("why")).collect()}
    assert why == {"ok.py": None, "../up.py": "path_traversal", "/abs.py": "absolute_path", "bomb.txt": "compression_ratio", "link": "symlink"}
    assert I.archive_totals(members).first().broken == "compression_ratio"
