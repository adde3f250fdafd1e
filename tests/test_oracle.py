"""Every query with SQL against DuckDB on a small table set."""

import math
import os

import duckdb
import pytest

from spindrift.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got, name
    if name not in registry.ORACLE_SQL:
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def test_rectangle_distance_of_every_place(spark, tmp_path):
    """Places repeat every 36 000 ids of a sign; inside the rectangle one differed by the last bit of a cosine (record 2171: 0.095 m)."""
    at = str(tmp_path / "documents.parquet")
    ids = spark.range(-36000, 36001, numPartitions=4).union(spark.sql("SELECT CAST(NULL AS long)"))
    ids.selectExpr("id AS doc_id", "'a' AS text", "'en' AS lang", "'src1' AS source", "1L AS n_chars").write.parquet(at)
    got = dict(registry.QUERIES["rectangle_distance"](spark, str(tmp_path)).select("record_id", "metres").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    want = dict(con.sql(f"SELECT record_id, metres FROM ({registry.ORACLE_SQL['rectangle_distance']})").fetchall())
    assert len(want) == 72002
    assert {k: (v, got.get(k)) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)
