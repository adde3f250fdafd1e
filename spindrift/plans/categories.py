"""Categories over the test tables: derived coordinates, cleaned fields and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.tsv import columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(ident: Column) -> dict[str, Column]:
    """Coordinates that follow from an id."""
    f = lambda k, m, off: ((ident * k) % m / 100.0 - off).cast("float").cast("double")
    return {"lat": f(104729, 18000, 90), "lon": f(7919, 36000, 180)}


def category(df: DataFrame, ident: str, text: dict[str, str], numbers: dict[str, str]) -> DataFrame:
    """record_id, raw_line, lat, lon, txt, tok and num of a table; text and numbers map fields to its columns."""
    at = place(F.col(ident))
    made = columns({n: F.col(c) for n, c in text.items()}, {n: F.col(c).cast("double") for n, c in numbers.items()})
    raw = F.concat_ws("\t", F.col(ident).cast("string"), *(F.col(c).cast("string") for c in [*text.values()]))
    return df.select(F.col(ident).cast("long").alias("record_id"), raw.alias("raw_line"), at["lat"].alias("lat"), at["lon"].alias("lon"), *made)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category(table(spark, sf_dir, "documents"), "doc_id", {"text": "text", "lang": "lang", "source": "source"}, {"n_chars": "n_chars"})


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category(table(spark, sf_dir, "customer"), "c_custkey", {"name": "c_name", "segment": "c_mktsegment"}, {"acctbal": "c_acctbal", "nationkey": "c_nationkey"})


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category(table(spark, sf_dir, "supplier"), "s_suppkey", {"name": "s_name"}, {"acctbal": "s_acctbal", "nationkey": "s_nationkey"})


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category(table(spark, sf_dir, "part"), "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type"}, {"size": "p_size", "retailprice": "p_retailprice"})
