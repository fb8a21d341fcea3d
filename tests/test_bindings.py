"""Every bound query against its SQL in DuckDB, and what the operators promise beside it."""

from pathlib import Path

import pytest

import __spark_entry__
from quarry.operators import dataset as D
from quarry.operators import evaluation as E
from quarry.operators import query as Q
from quarry.plans import bindings

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        return str(round(float(v), 5) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(bindings.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = bindings.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.sql(bindings.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_entry(spark):
    if DATA.exists():
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_kappa_of_chance(spark):
    a = spark.createDataFrame([(1, "present"), (2, "present"), (3, "absent"), (4, "absent")], "task_id int, label string")
    b = spark.createDataFrame([(1, "present"), (2, "absent"), (3, "present"), (4, "absent"), (5, "absent")], "task_id int, label string")
    r = D.agreement(a, b, "task_id", "label").first()
    assert (r.common, r.conflicts, r.only_second, r.kappa) == (4, 2, 1, 0.0)
    assert D.conflicts(a, b, "task_id", "label").count() == 2


def test_split_is_by_project_and_repeats():
    names = [f"p{i}" for i in range(8)]
    both = {n: {0, 1} for n in names}
    train, test = E.split_projects(names, both, 0.25, 1)
    assert len(test) == 2 and not set(train) & set(test) and (train, test) == E.split_projects(names[::-1], both, 0.25, 1)


def test_models(spark):
    rows = [(f"p{p}", 8.0 + 25 * ((p + r) % 2) + p, 1.0 + 7 * ((p + r) % 2) + r / 10, (p + r) % 2) for p in range(4) for r in range(6)]
    df = spark.createDataFrame(rows, "project string, loc double, cc double, y int")
    model = E.fit_logistic(df, ["loc", "cc"], "y")
    scored = E.positive_probability(model, df)
    m = E.binary_metrics(scored, [], "y", "predicted").first()
    assert m.f1 == 1.0 and E.ranking(scored, [], "y", "p").first().roc_auc == 1.0
    assert E.fit_tree(df, ["loc", "cc"], "y", "decision_tree").transform(df).where("prediction <> y").count() == 0


def test_pages_and_sections(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    items, total = Q.page(df, ["k"], 10, 5)
    assert [r.k for r in items.collect()] == list(range(5, 15)) and total == 30
    with pytest.raises(ValueError):
        Q.page(df, ["k"], 0)
    assert Q.section(df, ["k"], 30)[1] is False and Q.section(df, ["k"], 29)[1] is True


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    Q.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "job int, v string"), path, "job")
    Q.replace_partition(spark.createDataFrame([(2, "c")], "job int, v string"), path, "job")
    assert {(r.job, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


@pytest.mark.parametrize("name", ["controls_sampled", "bundle_counters"])
def test_entities_and_findings_are_not_broadcast(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = bindings.queries()[name](spark, str(DATA))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "LeftAnti" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("LeftAnti" in x or "c_custkey" in x or ("_b#" in x and "BuildLeft" in x))]
