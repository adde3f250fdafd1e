"""Nearest records under predicates: one lazy plan for a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spindrift.functions import geo
from spindrift.operators import predicates as P
from spindrift.operators.proximal import kept

#: Degrees of a cell's sides in the histogram that bounds a point's nearest records.
CELL = 5.0


def matching(category: DataFrame, request, watch: dict[str, Observation] | None = None) -> DataFrame:
    """The records that satisfy everything but order and number, with miles, metres and compass.

    watch: observations of the rows read, of those that pass the coarse tests, and of those that match.
    """
    seen = lambda df, what: df.observe(watch[what], F.count(F.lit(1)).alias("rows")) if watch else df
    text, number = _fields(category)
    tests: list[Column] = []
    # Cheap tests come first in the conjunction; ranges and the box reach the scan.
    tests += [p.column(request.compat) for p in request.numbers]
    if request.window:
        tests.append(geo.in_rectangle(F.col("lat"), F.col("lon"), *request.window))
    radius = request.effective_radius()
    if radius is not None:
        tests.append(geo.in_box(F.col("lat"), F.col("lon"), geo.bounding_box(request.lat, request.lon, radius)))
    tests += [p.column(text, number) for p in request.texts] + [r.column() for r in request.ranges]
    if request.discard_approximate:
        tests.append(~geo.approximate(F.col("lat"), F.col("lon")))
    out = seen(seen(category, "read").filter(P.conjunction(tests)), "candidates").withColumn("miles", geo.miles(request.lat, request.lon, F.col("lat"), F.col("lon")))
    if radius is not None:
        out = out.filter(F.col("miles") <= round(radius, geo.DECIMALS))
    return seen(out, "matches").withColumns({"metres": F.round(F.col("miles") * geo.METRES, 3), "compass": geo.compass(request.lat, request.lon, F.col("lat"), F.col("lon"))})


def search(category: DataFrame, request, watch: dict[str, Observation] | None = None) -> DataFrame:
    """The k nearest matching records in order: record_id, raw_line, lat, lon, miles, metres, compass.

    Without k all of them, in no order: a sort of everything would evaluate the tests twice, to find its ranges first.
    """
    out = matching(category, request, watch).select("record_id", "raw_line", "lat", "lon", "miles", "metres", "compass")
    if request.proximal:
        return kept(out, request.proximal, request.k)
    return out if request.k is None else out.orderBy("miles", "record_id").limit(request.k)


def histogram(category: DataFrame) -> DataFrame:
    """Records by grid cell of CELL degrees: row, column, n.  There are at most 180 x 360 / CELL squared rows."""
    at = lambda c, low, most: F.least(F.floor((F.col(c) + low) / CELL), F.lit(int(2 * low / CELL) - 1)).cast("int").alias(most)
    return category.select(at("lat", 90, "row"), at("lon", 180, "column")).groupBy("row", "column").agg(F.count("*").alias("n"))


def nearest_batch(category: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The k nearest records of each query point (point_id, lat, lon), however many points there are.

    A histogram of the records bounds a point's k-th distance: the circles around the nearest cells' centres
    that hold k records.  The point then meets only the records of cells which that distance reaches, by an
    equi-join on the cell.  The histogram has a fixed number of cells at most, and is all that is broadcast.
    """
    cells = histogram(category).select("row", "column", "n", ((F.col("row") + 0.5) * CELL - 90).alias("y"), ((F.col("column") + 0.5) * CELL - 180).alias("x"))
    listed = cells.agg(F.collect_list(F.struct("row", "column", "n", "y", "x")).alias("cells"))  # a row of at most 180 x 360 / CELL squared
    # A cell's points lie within half its height and half its width, in miles at the equator, of its centre.
    reach = CELL * 60 * 1.1515 + 0.001
    q = points.select("point_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).join(F.broadcast(listed), F.lit(True))
    far = F.transform("cells", lambda c: F.struct(geo.miles(F.col("q_lat"), F.col("q_lon"), c["y"], c["x"]).alias("d"), c["n"].alias("n"), c["row"].alias("row"), c["column"].alias("column")))
    q = q.select("point_id", "q_lat", "q_lon", F.sort_array(far).alias("far"))
    enough = F.aggregate("far", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1.0).alias("d")), lambda a, c: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + c["n"]).alias("n"), c["d"].alias("d"))))
    q = q.withColumn("limit", enough["d"] + 2 * reach)
    q = q.select("point_id", "q_lat", "q_lon", F.explode(F.filter("far", lambda c: c["d"] <= F.col("limit"))).alias("c")).select("point_id", "q_lat", "q_lon", "c.row", "c.column")
    at = lambda c, low, name: F.least(F.floor((F.col(c) + low) / CELL), F.lit(int(2 * low / CELL) - 1)).cast("int").alias(name)
    each = category.select("record_id", "lat", "lon", at("lat", 90, "row"), at("lon", 180, "column")).join(q, ["row", "column"])
    d = each.select("point_id", geo.miles(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")).alias("miles"), "record_id")
    w = Window.partitionBy("point_id").orderBy("miles", "record_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _fields(category: DataFrame) -> tuple[list[str], list[str]]:
    names = lambda c: [n for n in category.schema[c].dataType.names if n != "_none"]
    return names("tok"), names("num")
