"""What the folder registers: names, kinds of oracles, and every SQL against its query."""

from pathlib import Path

import pytest

import __spark_entry__
from quarry.llm import registry

DATA = Path("/root/testdata/sf0.001")


def test_oracles_are_text():
    assert all(isinstance(v, str) for v in __spark_entry__.oracle_sql().values())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, str(DATA))
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())
