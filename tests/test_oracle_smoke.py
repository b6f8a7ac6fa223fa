"""Every registered query against its DuckDB twin on the smallest tables
(the driver's gate runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMOKE_DIR
from sqlstrata.plans import registry
from tools.check_oracle import TABLES, digest

registry.load_all()
KEYS = sorted(registry.QUERIES)  # those of the optional subpackage have their own tests


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = registry.QUERIES[key](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.ORACLES.get(key)
    if sql is None:
        assert len(rows) > 0
        return
    res = duck.execute(sql)
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(cols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "query_id" in df.columns and "tables" in df.columns
