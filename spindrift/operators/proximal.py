"""Greedy removal of near neighbours: a row closer than a distance to the last kept one goes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page at least; the driver holds one page at a time.
PAGE = 2048


def miles(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    c = math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(lon1 - lon2))
    return round(math.degrees(math.acos(max(-1.0, min(1.0, c)))) * 60 * 1.1515, 6)


def fold(rows: Iterable, limit: float, last=None) -> Iterator:
    """The rows that stay, in order; last is the row kept before them."""
    for r in rows:
        if last is None or miles(last.lat, last.lon, r.lat, r.lon) >= limit:
            last = r
            yield r


def kept(rows: DataFrame, limit: float, k: int | None) -> DataFrame:
    """rows (with miles, record_id, lat, lon) by distance, without those within limit miles of the last kept one.

    The rule needs the rows one after another.  For k hits it goes through pages of the nearest rows,
    each a distributed top-n, until k are kept.  Without k one task folds the sorted rows.
    """
    order = ["miles", "record_id"]
    if k is None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = None
            for b in batches:
                good = list(fold(b.itertuples(), limit, last))
                last = good[-1] if good else last
                yield b.loc[[r.Index for r in good]]

        return rows.repartition(1).sortWithinPartitions(*order).mapInPandas(run, rows.schema).orderBy(*order)
    found, at = [], None
    while len(found) < k:
        page = rows if at is None else rows.filter((F.col("miles") > at.miles) | ((F.col("miles") == at.miles) & (F.col("record_id") > at.record_id)))
        got = page.orderBy(*order).limit(max(PAGE, 4 * k)).collect()
        found += fold(got, limit, found[-1] if found else None)
        if len(got) < max(PAGE, 4 * k):
            break
        at = got[-1]
    return rows.sparkSession.createDataFrame(found[:k], rows.schema).orderBy(*order)
