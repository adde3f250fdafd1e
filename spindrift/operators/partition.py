"""Space-filling partitions, their bounds, and pruning by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import geo


def by_cell(category: DataFrame, parts: int) -> DataFrame:
    """Records in so many ranges of their grid cells, with the cell; ranges come from a sample."""
    d = category.withColumn("cell", geo.cell(F.col("lat"), F.col("lon")))
    return d.repartitionByRange(parts, "cell", "record_id").sortWithinPartitions("cell", "record_id")


def numbered(category: DataFrame, parts: int) -> DataFrame:
    return by_cell(category, parts).withColumn("part", F.spark_partition_id())


def write(category: DataFrame, path: str, parts: int, header: str | None = None) -> None:
    """One folder for each part, each with a copy of the header in _header; an existing path is an error."""
    numbered(category, parts).write.mode("errorifexists").partitionBy("part").parquet(path)
    if header is not None:
        spark = category.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for x in fs.listStatus(root):
            if x.isDirectory():
                out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_header"))
                out.write(bytearray(header.encode()))
                out.close()


def bounds(records: DataFrame, key: str) -> DataFrame:
    """For each key: the number of records, the rectangle of their points, its area, and bounds of the numbers."""
    names = [n for n in records.schema["num"].dataType.names if n != "_none"]
    numbers = [f(F.when(~F.isnan(f"num.{n}"), F.col(f"num.{n}"))).alias(f"{n}_{a}") for n in names for f, a in ((F.min, "min"), (F.max, "max"))]
    out = records.groupBy(key).agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), *numbers)
    return out.withColumn("area", geo.area(F.col("south"), F.col("west"), F.col("north"), F.col("east")))


def parts_in_reach(bounds_: DataFrame, lat: float, lon: float, radius: float) -> list[int]:
    """Parts whose rectangle meets the box of a circle; the bounds have one row a part."""
    south, north, spans = geo.bounding_box(lat, lon, radius)
    meets = (F.col("south") <= north) & (F.col("north") >= south)
    if spans is not None:
        east = F.lit(False)
        for a, b in spans:
            east = east | ((F.col("west") <= b) & (F.col("east") >= a))
        meets = meets & east
    return sorted(r.part for r in bounds_.filter(meets).select("part").collect())


def pruned(partitioned: DataFrame, bounds_: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """The partitions that a circle can reach; Spark reads no other folder."""
    return partitioned.filter(F.col("part").isin(parts_in_reach(bounds_, lat, lon, radius)))
