"""Every query outside llm against its oracle in DuckDB, at the smallest scale: values and column names."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows
from lattice.plans.registry import ORACLES, QUERIES
from lattice.sources.tables import TABLES, read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "l_linenumber", "c"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    with pytest.raises(ValueError):
        read_table(spark, SF, "nothing")
