"""Every registered query against its DuckDB oracle on the smallest tables:
row count, column names and an order-insensitive hash of the values."""

import pytest

import __spark_entry__ as E
from cirrus.plans import registry
from tools.check_oracle import TABLES, digest

registry.load_all()
QUERIES = registry.QUERIES
SQL = registry.ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_small):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_query_has_a_section():
    from cirrus.plans.registry import SECTIONS
    assert set(SECTIONS) == set(QUERIES)
    assert len(QUERIES) >= 130


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, sf_small, duck, key):
    df = QUERIES[key](spark, sf_small)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    orows = [tuple(r[ocols.index(c)] for c in cols) for r in cur.fetchall()]
    assert len(rows) == len(orows)
    assert digest(cols, rows, True)[0] == digest(cols, orows, True)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_small, key):
    assert QUERIES[key](spark, sf_small).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["tenant_id", "tenant_name"]
