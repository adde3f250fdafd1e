"""Tab-separated records: reading, validation and the category's columns."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import number
from spindrift.functions.text import clean_text, tokens
from spindrift.sources.schema import SchemaSpec


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """record_id and raw_line of each line, with its file and where its block begins; ids rise in the order of files and lines, with gaps."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("record_id"), F.col("value").alias("raw_line"), *where)


def located(rejects: DataFrame, lines: DataFrame) -> DataFrame:
    """rejects with file and line_no, from 1 on in each file.

    Lines of a block have consecutive ids, so a block's first id and the lines of the blocks before it say which
    line an id is.  Only counts by block, and the rejects, are shuffled.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    found = rejects.join(lines.select("record_id", "file", "block"), "record_id") if "file" not in rejects.columns else rejects
    out = found.join(blocks, ["file", "block"]).withColumn("line_no", F.col("before") + F.col("record_id") - F.col("first") + 1)
    return out.select("record_id", "raw_line", "reason", "file", "line_no")


def checked(lines: DataFrame, spec: SchemaSpec) -> DataFrame:
    """lines with parts, lat, lon and reason, which is null for good records."""
    d = lines.withColumn("parts", F.split("raw_line", "\t", -1))
    value = lambda name: F.get("parts", F.lit(spec.position(name))).try_cast("double")
    d = d.withColumns({"lat": value(spec.latitude), "lon": value(spec.longitude)})
    bad = lambda c, most: F.col(c).isNull() | F.isnan(c)  # noqa: E731, ARG005
    reason = (
        F.when(F.size("parts") != len(spec.fields), F.concat(F.lit("expected "), F.lit(len(spec.fields)), F.lit(" fields, found "), F.size("parts")))
        .when(bad("lat", 90) | bad("lon", 180), "coordinates are not numbers")
        .when(F.abs("lat") > 90, "latitude out of range")
        .when(F.abs("lon") > 180, "longitude out of range")
    )
    return d.withColumn("reason", reason)


def columns(text: dict[str, Column], numbers: dict[str, Column]) -> list[Column]:
    """The struct columns txt, tok and num from raw field values."""
    cleaned = {n: clean_text(c) for n, c in text.items()}
    struct = lambda xs: F.struct(*(c.alias(n) for n, c in xs.items())) if xs else F.struct(F.lit(None).cast("string").alias("_none"))
    return [struct(cleaned).alias("txt"), struct({n: tokens(c) for n, c in cleaned.items()}).alias("tok"), struct(numbers).alias("num")]


def parse(lines: DataFrame, spec: SchemaSpec) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): records have the category's columns, rejects record_id, raw_line, reason and, if lines have them, file and block."""
    d = checked(lines, spec)
    raw = lambda name: F.col("parts")[spec.position(name)]
    made = columns({n: raw(n) for n in spec.text}, {n: number(raw(n)) for n in spec.number})
    good = d.filter("reason IS NULL").select("record_id", "raw_line", "lat", "lon", *made)
    return good, d.filter("reason IS NOT NULL").select("record_id", "raw_line", "reason", *(c for c in ("file", "block") if c in lines.columns))


def fetched(spark: SparkSession, url: str, to: str, on_bytes: Callable[[int], None] | None = None) -> int:
    """Copies a URL to a new file that Spark's file systems reach; gives the bytes, and tells of them every 64 MB."""
    at = spark._jvm.org.apache.hadoop.fs.Path(to)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    n = told = 0
    try:
        with urllib.request.urlopen(url) as source:
            while chunk := source.read(1 << 20):
                out.write(bytearray(chunk))
                n += len(chunk)
                if on_bytes and n - told >= 64 << 20:
                    on_bytes(n)
                    told = n
    finally:
        out.close()
    if on_bytes:
        on_bytes(n)
    return n
