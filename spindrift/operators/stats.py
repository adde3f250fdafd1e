"""Counts of a search and of a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_stats(result: DataFrame) -> DataFrame:
    """Hits and characters of a search's lines."""
    return result.agg(F.count("*").alias("hits"), F.coalesce(F.sum(F.length("raw_line")), F.lit(0)).alias("chars"))


def false_positives(category: DataFrame, coarse: Column, exact: Column) -> DataFrame:
    """Records that a coarse filter takes and the exact one does not, in one pass."""
    return category.agg(F.count_if(coarse & ~exact).alias("false_positives"))
