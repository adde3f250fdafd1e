"""Geography as Column expressions: degrees in, miles out unless said otherwise."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nautical and statute miles of a degree, kilometres and nautical miles of a mile, metres of a
# mile as a float32, and the radius used for distances to rectangles.
DEGREE_MILES = 60 * 1.1515
KILOMETRES, NAUTICAL = 1.609344, 0.8684
METRES = 1609.343994140625
EARTH_RADIUS_M = 6371229.0
EPSILON = 9.999999747378752e-06
#: Decimals of distances: before a comparison or a sort, results of different mathematics libraries agree.
DECIMALS = 6


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def distance(lat1, lon1, lat2, lon2, unit: str = "M") -> Column:
    """Great-circle distance by the law of cosines, in miles (M), kilometres (K) or nautical miles (N)."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon1 - lon2))
    miles = F.degrees(F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))) * 60 * 1.1515
    return miles * KILOMETRES if unit == "K" else miles * NAUTICAL if unit == "N" else miles


def miles(lat1, lon1, lat2, lon2) -> Column:
    return F.round(distance(lat1, lon1, lat2, lon2), DECIMALS)


def compass(lat, lon, lat2, lon2) -> Column:
    """One of eight directions from a point to another; N if they are the same."""
    lat, lon, lat2, lon2 = map(_col, (lat, lon, lat2, lon2))
    ns = F.when(lat < lat2, "N").when(lat > lat2, "S").otherwise("")
    ew = F.when(lon < lon2, "E").when(lon > lon2, "W").otherwise("")
    both = F.concat(ns, ew)
    return F.when(both == "", "N").otherwise(both)


def approximate(lat: Column, lon: Column) -> Column:
    """Whether the decimals mark a place as approximate.  Fixed values: ***107 and ***001, 004, 020, 100 or 999."""
    text = lambda c: F.regexp_extract(c.cast("string"), r"\.(.*)$", 1)
    return text(lat).rlike("^[0-9]{3}107$") & text(lon).rlike("^[0-9]{3}(001|004|020|100|999)$")


def in_rectangle(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def _arc():
    """Angle between two points from their latitudes and the difference of longitudes, all in radians.

    In Arrow, with the C library's functions: near an angle of 0 the last bit of a cosine is a decimetre on the ground, and
    the JVM's functions differ from the C library's in it.
    """

    def arc(lat1: pa.Array, lat2: pa.Array, lon: pa.Array) -> pa.Array:
        c = pc.add(pc.multiply(pc.multiply(pc.cos(lat1), pc.cos(lat2)), pc.cos(lon)), pc.multiply(pc.sin(lat1), pc.sin(lat2)))
        return pc.acos(pc.max_element_wise(pc.min_element_wise(c, 1.0), -1.0))

    return F.arrow_udf(arc, T.DoubleType())


def rectangle_distance(lat, lon, south, west, north, east) -> Column:
    """Metres from a point to the nearest point of a rectangle, by clamping its coordinates."""
    lat, lon, south, west, north, east = map(_col, (lat, lon, south, west, north, east))
    y, x = F.greatest(south, F.least(lat, north)), F.greatest(west, F.least(lon, east))
    return F.lit(EARTH_RADIUS_M) * _arc()(F.radians(y), F.radians(lat), F.radians(x - lon))


def area(south, west, north, east) -> Column:
    south, west, north, east = map(_col, (south, west, north, east))
    return (north - south) * (east - west)


def bounding_box(lat: float, lon: float, radius: float) -> tuple[float, float, list[tuple[float, float]] | None]:
    """(south, north, longitude intervals or None for all) that a circle of so many miles lies in.

    Both sides of the antimeridian have an interval of their own.
    """
    d = (radius + 1e-5) / DEGREE_MILES
    south, north = lat - d, lat + d
    if south <= -90 or north >= 90:
        return max(south, -90.0), min(north, 90.0), None
    ratio = math.sin(math.radians(min(d, 90.0))) / math.cos(math.radians(lat))
    if d >= 90 or ratio >= 1:
        return south, north, None
    w = math.degrees(math.asin(ratio)) + 1e-9
    low, high = lon - w, lon + w
    if high - low >= 360:
        return south, north, None
    if low < -180:
        return south, north, [(-180.0, high), (low + 360, 180.0)]
    if high > 180:
        return south, north, [(low, 180.0), (-180.0, high - 360)]
    return south, north, [(low, high)]


def in_box(lat: Column, lon: Column, box) -> Column:
    south, north, spans = box
    out = lat.between(south, north)
    if spans is not None:
        east = lon.between(*spans[0])
        for s in spans[1:]:
            east = east | lon.between(*s)
        out = out & east
    return out


def _spread(c: Column) -> Column:
    """Sixteen bits with a zero after each, in five steps."""
    c = c.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def cell(lat: Column, lon: Column) -> Column:
    """Morton number of a point on a grid of 65 536 by 65 536 cells: neighbours have near numbers."""
    grid = lambda c, low, span: F.least(F.greatest(F.floor((c - low) / span * 65536), F.lit(0)), F.lit(65535))
    return F.shiftleft(_spread(grid(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(grid(lon, -180.0, 360.0)))


def zorder(lat: Column, lon: Column) -> Column:
    """Interleaved bits of the two float32 numbers, the latitude's first; not in the order of negative coordinates."""
    bits = lambda c: F.conv(F.hex(_float_bytes(c)), 16, 10).cast("long")
    half = lambda c, k: F.shiftright(c, 16 * k).bitwiseAND(F.lit(0xFFFF))
    y, x = bits(lat), bits(lon)
    part = lambda k: F.shiftleft(_spread(half(y, k)), 1).bitwiseOR(_spread(half(x, k)))
    return F.shiftleft(part(1), 32).bitwiseOR(part(0))


def _float_bytes(c: Column) -> Column:
    """The four IEEE 754 bytes of a number as float32, from its sign, exponent and fraction."""
    f = c.cast("float").cast("double")
    a = F.abs(f)
    e = F.when(a > 0, F.floor(F.log2(a))).otherwise(F.lit(-127)).cast("int")
    e = F.when((a > 0) & (a < F.pow(F.lit(2.0), e)), e - 1).when((a > 0) & (a >= F.pow(F.lit(2.0), e + 1)), e + 1).otherwise(e)
    normal = e >= -126
    fraction = F.when(a == 0, 0).when(normal, F.round((a / F.pow(F.lit(2.0), e) - 1) * 8388608)).otherwise(F.round(a / F.pow(F.lit(2.0), F.lit(-126)) * 8388608)).cast("long")
    number = F.shiftleft(F.when((a > 0) & normal, e + 127).otherwise(0).cast("long"), 23).bitwiseOR(fraction)
    number = number.bitwiseOR(F.when((f < 0) | (f.cast("string") == "-0.0"), F.lit(0x80000000)).otherwise(F.lit(0)))
    return F.unhex(F.lpad(F.hex(number), 8, "0"))
