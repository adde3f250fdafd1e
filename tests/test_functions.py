"""Golden values of normal forms, distances and predicates."""

import math

import pytest
from pyspark.sql import functions as F

from spindrift.functions import geo, numeric, text
from spindrift.operators.predicates import NumberPredicate, Op, TextRange

TEXT = {
    "Joe's 007-Bar & Grill, 8th St. #0042!": "joe s 7 bar grill 8 st 42", "_NULL": "", "null": "null", "000 Main": "0 main", "Café Ünï": "café ünï", "a+b*c_d": "a b c d", "3.5": "3 5",
    "2011-05-03": "2011 5 3", "21st 22nd x3rd": "21 22 x3rd", "0th": "th", "Customer#000000001": "customer 1", "  Lead  ": "lead", "": "", "é] x": "x", "a\tb": "a\tb",
}
NUMBER = {
    "$1,234.50": 1234.5, "_null": 0, "": 0, "0.00": 0, "-0": 0, "abc": math.nan, "0.50": 0.5, "-05": -5, "1e5": 15, "2011-05-03": 2110503, "1999-12-31 23:59": 1991231, "1850-01-01": 1500101,
    "12-34": math.nan, "+7": 7, " 00120 ": 120, "2011-5-3": math.nan, "2011-05-03 1:00": math.nan,
}


def test_text(spark):
    rows = spark.createDataFrame([(k,) for k in TEXT], "s string").select("s", text.clean_text(F.col("s"))).collect()
    assert {a: b for a, b in rows} == TEXT
    assert {k: text.clean_text_value(k) for k in TEXT} == TEXT
    got = spark.createDataFrame([("b a b",), ("",), (None,)], "s string").select(text.tokens(text.clean_text(F.col("s")))).collect()
    assert [r[0] for r in got] == [["b", "a"], [""], [""]]


def test_numbers(spark):
    same = lambda a, b: a == b or math.isnan(a) and math.isnan(b)
    rows = spark.createDataFrame([(k,) for k in NUMBER], "s string").select("s", numeric.number(F.col("s"))).collect()
    for s, v in rows:
        assert same(v, NUMBER[s]) and same(numeric.number_value(s), NUMBER[s]), s


def test_distances(spark):
    cases = [((0, 0, 0, 1), (69.09, 111.189577, 59.997756)), ((25.7617, -80.1918, 28.5383, -81.3792), (205.250106, 330.318027, 178.239192)), ((0, 179, 0, -179), (138.18, 222.379154, 119.995512)), ((0, 0, 0, 180), (12436.2, 20014.123853, 10799.59608))]
    one = spark.range(1)
    for point, want in cases:
        got = one.select(*(F.round(geo.distance(*point, u), 6) for u in "MKN")).first()
        assert tuple(got) == want
    d = lambda *p: one.select(geo.compass(*p)).first()[0]
    assert [d(0, 0, 1, 1), d(0, 0, 1, 0), d(0, 0, 0, -1), d(0, 0, 0, 0), d(0, 0, -1, -1)] == ["NE", "N", "W", "N", "SW"]


def test_approximate(spark):
    rows = [(25.761107, -80.123001, True), (25.761107, -80.123004, True), (25.761107, -80.123999, True), (25.761107, -80.1231, False), (25.7611, -80.123001, False)]
    for lat, lon, want in spark.createDataFrame(rows, "lat double, lon double, want boolean").select("lat", "lon", "want").collect():
        assert spark.range(1).select(geo.approximate(F.lit(lat), F.lit(lon))).first()[0] == want


def test_box_loses_no_point(spark):
    pts = spark.range(4000).select((F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon")).cache()
    for lat, lon, r in [(0, 0, 500), (89, 10, 300), (-60, 179.5, 900), (45, -179, 3000), (10, 20, 9000), (70, 0, 4000), (0, 180, 50)]:
        near = pts.filter(geo.miles(lat, lon, F.col("lat"), F.col("lon")) <= r)
        assert near.count() == near.filter(geo.in_box(F.col("lat"), F.col("lon"), geo.bounding_box(lat, lon, r))).count()


def test_number_predicates(spark):
    values = [5.0, 5.000009, 5.00002, math.nan, 19.99, 0.1]
    df = spark.createDataFrame([((v,),) for v in values], "num struct<x: double>")
    hold = lambda op, v, compat=False: [r[0] for r in df.select(NumberPredicate("x", op, v).column(compat)).collect()]
    assert hold(Op.ALL, 5.0) == [True, True, False, False, False, False]
    assert hold(Op.ALL, 5.0, True)[:4] == [True, False, False, False]
    assert hold(Op.NONE, 5.0) == [False, True, True, True, True, True]
    assert hold(Op.LE, 5.0) == [True, False, False, False, False, True]
    assert hold(Op.GT, 5.0) == [False, True, True, False, True, False]
    assert hold(Op.ALL, 19.99)[4] and not hold(Op.ALL, 19.99, True)[4]
    assert hold(Op.LE, 0.1)[5] and not hold(Op.LE, 0.1, True)[5]
    assert not any(hold(Op.ANY, 5.0, True))


@pytest.mark.parametrize(
    ("operand", "value", "le", "ge"),
    [("100", "99", True, False), ("9", "10 main", False, True), ("100", "", True, False), ("100", "abc", True, False), ("m", "lead", True, False), ("2011 5 3", "2011 10 3", True, False)],
)
def test_text_ranges(spark, operand, value, le, ge):
    df = spark.createDataFrame([((value,),)], "txt struct<f: string>")
    assert [df.select(TextRange("f", op, operand).column()).first()[0] for op in (Op.LE, Op.GE)] == [le, ge]


def test_zorder_interleaves_float_bits(spark):
    import struct

    def want(lat, lon):
        y, x = (struct.unpack(">I", struct.pack(">f", v))[0] for v in (lat, lon))
        z = sum(((y >> k & 1) << 2 * k + 1) | ((x >> k & 1) << 2 * k) for k in range(32))
        return z - (1 << 64) if z >> 63 else z

    pts = [(0.0, 0.0), (1.5, -2.25), (-89.99, 179.5), (25.7617, -80.1918), (1e-40, 3.0), (-0.1, 0.3)]
    for lat, lon, z in spark.createDataFrame(pts, "lat double, lon double").select("lat", "lon", geo.zorder(F.col("lat"), F.col("lon"))).collect():
        assert z == want(lat, lon), (lat, lon)
