"""Every registered query with SQL gives the same rows in DuckDB on the smallest test set."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, norm  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert "value_rmean_7" in out.columns and out.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    relation = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    index = [relation.columns.index(c) for c in order]
    want = sorted(tuple(norm(r[i]) for i in index) for r in relation.fetchall())
    assert got == want
