"""Manifests, addresses, sheets, reports and models."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.sources import manifests as M
from quarry.sources import tables as T


def test_manifests(spark):
    toml = '[tool.poetry.dependencies]\npython = "^3.11"\nFastAPI = "*"\nsqlalchemy = "*"\n'
    files = spark.createDataFrame([("pyproject.toml", toml), ("requirements-dev.txt", "# c\npandas>=2\n-r x\nhttps://x\n\nNumPy"), ("a/setup.py", "")], "path string, text string")
    assert {r.tool for r in M.build_tools(files).collect()} == {"poetry", "pip"}
    assert M.pyproject(toml)[1] == ["fastapi", "sqlalchemy"] and M.pyproject("[") == ([], [])
    deps = M.requirements(files)
    assert {r.dependency for r in deps.collect()} == {"pandas", "numpy"}
    assert {r.framework for r in M.frameworks(deps).collect()} == {"pandas", "NumPy"}


@pytest.mark.parametrize(
    "url, problem, normal",
    [
        ("https://github.com/a/b", None, "https://github.com/a/b.git"),
        (" https://GitHub.com:443/a/b.git?x#y ", None, "https://github.com/a/b.git"),
        ("http://github.com/a/b", "not https", None),
        ("https://u:p@github.com/a/b", "credentials", None),
        ("https://evil.com/a/b", "host not allowed", None),
        ("https://github.com:8443/a/b", "port", None),
        ("https://github.com/a", "no owner and repository", None),
        ("", "empty", None),
    ],
)
def test_addresses(spark, url, problem, normal):
    r = spark.createDataFrame([(url,)], "u string").select(M.repository(F.col("u")).alias("r")).first().r
    assert (r.problem, r.normal) == (problem, normal)


def test_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("t1", 'a "q"\nb', "1.5"), ("t2", "=x", "nan?")], "task_id string, note string, feature__loc string")
    T.write_sheet(rows, str(tmp_path / "s"), ("task_id", "note", "feature__loc"))
    assert {tuple(r) for r in T.read_sheet(spark, str(tmp_path / "s"), ("task_id", "note")).collect()} == {("t1", 'a "q"\nb'), ("t2", "=x")}
    assert {(r.task_id, r.loc) for r in T.read_training(spark, str(tmp_path / "s"), ("task_id",)).collect()} == {("t1", 1.5), ("t2", None)}
    with pytest.raises(ValueError):
        T.read_sheet(spark, str(tmp_path / "s"), ("absent",))
    assert T.write_report({"notes": (rows, ["task_id"])}, str(tmp_path / "r"), 1) == {"notes": True}
    assert T.digest(rows, rows.columns) == T.digest(rows.repartition(3), rows.columns)
    assert "&lt;b&gt;" in T.html_table(rows, "<b>")


def test_models_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(float(x), int(x > 4)) for x in range(10)], "loc double, y int")
    sha = T.save_model(E.fit_logistic(df, ["loc"], "y"), str(tmp_path / "m"), {"features": ["loc"]})
    model, card = T.load_model(str(tmp_path / "m"), ["loc"], sha)
    assert E.positive_probability(model, df).where("predicted <> y").count() == 0
    for features, digest in ((["cc"], None), (["loc"], "0" * 64)):
        with pytest.raises(ValueError):
            T.load_model(str(tmp_path / "m"), features, digest)
