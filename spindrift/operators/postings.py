"""Inverted lists: terms of fields to records, and searches by joining them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.predicates import ANY_FIELD, Op


def postings(category: DataFrame) -> DataFrame:
    """(record_id, term, field): distinct terms of each text field; zero numbers are the empty term of their field."""
    text = [n for n in category.schema["tok"].dataType.names if n != "_none"]
    number = [n for n in category.schema["num"].dataType.names if n != "_none"]
    each = [F.struct(F.lit(n).alias("field"), F.col(f"tok.{n}").alias("terms")) for n in text]
    each += [F.struct(F.lit(n).alias("field"), F.when(F.col(f"num.{n}") == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")).alias("terms")) for n in number]
    one = category.select("record_id", F.explode(F.array(*each)).alias("f"))
    return one.select("record_id", F.explode("f.terms").alias("term"), F.col("f.field").alias("field"))


def write(posted: DataFrame, path: str) -> None:
    """Sorted by term, so that a search reads few row groups."""
    posted.repartitionByRange("term").sortWithinPartitions("term", "field", "record_id").write.mode("overwrite").parquet(path)


def lengths(posted: DataFrame) -> DataFrame:
    """(term, field, df): how many records a posting list has."""
    return posted.groupBy("term", "field").agg(F.count("*").alias("df"))


def matching(posted: DataFrame, records: DataFrame, field: str, op: Op, keywords: list[str]) -> DataFrame:
    """records that have all, any or none of the keywords in a field, or in any one."""
    hits = posted.filter(F.col("term").isin(keywords))
    if field != ANY_FIELD:
        hits = hits.filter(F.col("field") == field)
    if op is Op.ALL:
        ids = hits.groupBy("record_id").agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(set(keywords))).select("record_id")
        return records.join(ids, "record_id", "left_semi")
    return records.join(hits.select("record_id"), "record_id", "left_semi" if op is Op.ANY else "left_anti")


def bitmaps(posted: DataFrame) -> DataFrame:
    """(term, field, block, bitmap): for each block of 32 768 record ids the bits of those that have the term."""
    b = posted.withColumns({"block": F.bitmap_bucket_number("record_id"), "bit": F.bitmap_bit_position("record_id")})
    return b.groupBy("term", "field", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def any_field(maps: DataFrame) -> DataFrame:
    """The union of the fields' bitmaps."""
    return maps.groupBy("term", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def document_frequency(maps: DataFrame) -> DataFrame:
    return maps.groupBy("term", "field").agg(F.sum(F.bitmap_count("bitmap")).alias("df"))


def combined(maps: DataFrame, terms: list[str], how: str) -> DataFrame:
    """(block, bitmap) of the records that have all, any or none of the terms, from any-field bitmaps (any_field).

    Blocks in which no record can qualify are left out.
    """
    terms = list(dict.fromkeys(terms))
    own = maps.filter(F.col("term").isin(terms)).groupBy("block")
    if how == "all":
        both = own.agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n")).filter(F.col("n") == len(terms)).select("block", "bitmap")
        return both.filter(F.bitmap_count("bitmap") > 0)
    some = own.agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    if how == "any":
        return some
    every = maps.groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("every"))
    left = every.join(some, "block", "left")
    # Members of a block are listed and tested, as there is no complement of a bitmap.
    ids = members(left.select("block", F.col("every").alias("bitmap"))).join(members(left.filter("bitmap IS NOT NULL").select("block", "bitmap")), "record_id", "left_anti")
    return ids.groupBy(F.bitmap_bucket_number("record_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("record_id")).alias("bitmap"))


def members(blocks: DataFrame) -> DataFrame:
    """record_id of each set bit."""
    byte = F.conv(F.substring(F.hex("bitmap"), 2 * F.col("i") + 1, F.lit(2)), 16, 10).cast("int")
    each = blocks.select("block", "bitmap", F.explode(F.sequence(F.lit(0), F.octet_length("bitmap") - 1)).alias("i")).select("block", "i", byte.alias("byte")).filter("byte > 0")
    bits = each.select("block", "i", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).filter("(shiftright(byte, j) & 1) = 1")
    # Block 1 starts with id 1; blocks of ids from 0 down count the other way.
    at = F.col("i") * 8 + F.col("j")
    return bits.select(F.when(F.col("block") > 0, (F.col("block") - 1) * 32768 + at + 1).otherwise(F.col("block") * 32768 - at).cast("long").alias("record_id"))
