"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from spindrift.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(map(repr, rel.select(*columns).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
