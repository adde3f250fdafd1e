"""Records that arrive as files: a stream of parsed records appended to a category's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.sources.schema import SchemaSpec
from spindrift.sources.tsv import parse


def record_stream(spark: SparkSession, folder: str, spec: SchemaSpec) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of the text files that come into a folder; ids are hashes of file, place and line."""
    lines = spark.readStream.schema("value string").text(folder).select(
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "value").alias("record_id"), F.col("value").alias("raw_line")
    )
    return parse(lines, spec)


def append(records: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
