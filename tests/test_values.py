"""Strict conversions, number text and map functions."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.functions import geo, values
from pointloom.functions.scales import axis_bounds, log10_scale, normalize_axis, scale_value, unlog10, unscale_value

TIMES = {
    "2026-03-08": "2026-03-08T00:00:00.000Z", "2026-03-08T10:00": "2026-03-08T10:00:00.000Z", "2026-03-08 10:00:30": "2026-03-08T10:00:30.000Z",
    "2026-03-08t10:00:30.5z": "2026-03-08T10:00:30.500Z", "2026-03-08T10:00:30.123456789Z": "2026-03-08T10:00:30.123Z",
    "2026-03-08+02:00": "2026-03-07T22:00:00.000Z", "2026-10-02T10:00z": "2026-10-02T10:00:00.000Z", " 2026-03-08T10:00-0530 ": "2026-03-08T15:30:00.000Z",
    "2026-03-08T10:00:00+14:00": "2026-03-07T20:00:00.000Z", "2024-02-29": "2024-02-29T00:00:00.000Z", "1969-12-31T23:59:59.999": "1969-12-31T23:59:59.999Z",
    "2026-02-29": None, "2026-13-01": None, "2026-03-08T24:00": None, "2026-03-08T10:60": None, "2026-03-08T10:00:60": None, "2026-03-08T10": None,
    "2026-03-08T10:00:00+14:01": None, "2026-03-08T10:00:00+15:00": None, "2026-03-08T10:00:00+05:75": None, "08/03/2026": None, "1741428000000": None, "": None,
    "2026-3-8": None, "2026-03-08T10:00:00.1234567890": None, "tomorrow": None,
}


def test_times_are_read_alike_on_rows_and_literals(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r.t: r.iso for r in df.select("t", values.utc_iso(values.parse_utc(F.col("t"))).alias("iso")).collect()}
    assert got == TIMES
    for text, want in TIMES.items():
        millis = values.parse_utc_millis(text)
        assert (None if millis is None else values.iso_from_millis(millis)) == want, text


def test_display_drops_only_empty_milliseconds(spark):
    df = spark.createDataFrame([("2026-03-08T10:00:30.5",), ("2026-03-08",), ("no",)], "t string")
    got = [r[0] for r in df.select(values.format_utc(values.parse_utc(F.col("t")))).collect()]
    assert got == ["2026-03-08 10:00:30.500 UTC", "2026-03-08 00:00:00 UTC", "Invalid UTC time"]


@pytest.mark.parametrize("text,want", [("1", 1.0), (" +1.5e3 ", 1500.0), (".5", 0.5), ("5.", 5.0), ("-0", -0.0), (" 7 ", 7.0), ("0x10", None), ("Infinity", None),
                                       ("NaN", None), ("1e999", None), ("1d", None), ("1,5", None), ("", None), ("1 2", None), ("1" * 400, None)])
def test_numbers_are_strict(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(values.to_number(F.col("t"))).first()[0] == want


def test_booleans_and_blanks(spark):
    df = spark.createDataFrame([("TRUE",), (" false ",), ("1",), ("",), ("　\t",), (None,)], "t string")
    rows = df.select(values.to_boolean(F.col("t")), values.is_blank(F.col("t")), values.to_flag(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, None), (False, False, None), (None, False, True), (None, True, None), (None, True, None), (None, True, None)]


@pytest.mark.parametrize("v,want", [(12.0, "12"), (-0.0, "0"), (0.1, "0.1"), (1e7, "10000000"), (12345678.9, "12345678.9"), (1e20, "100000000000000000000"), (1e21, "1e+21"),
                                    (1.5e300, "1.5e+300"), (0.000123, "0.000123"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.25e-9, "1.25e-9"), (123456789012.5, "123456789012.5"),
                                    (-2.5, "-2.5"), (9007199254740993.0, "9007199254740992"), (0.00001234567890123, "0.00001234567890123")])
def test_number_text_has_no_surprises(spark, v, want):
    assert spark.createDataFrame([(v,)], "v double").select(values.number_text(F.col("v"))).first()[0] == want


def test_natural_order(spark):
    texts = ["item 10", "Item 9", "item 2", "item 02b", "b", "a", "B1", "é", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in df.orderBy(values.natural_key(F.col("t")), "t").collect()]
    assert got.index("a") < got.index("b") < got.index("B1") < got.index("é") < got.index("item 2") < got.index("Item 9") < got.index("item 10") < got.index("z")


def test_haversine_and_units(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 180.0, 0.0), (None, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    m = [r[0] for r in df.select(geo.haversine(*map(F.col, "abcd"))).collect()]
    assert m[0] == pytest.approx(111195.0802335329, rel=1e-12) and m[1] == pytest.approx(math.pi * geo.EARTH_RADIUS) and m[2] is None
    one = df.limit(1).select(geo.to_feet(F.lit(1.0)), geo.to_nautical_miles(F.lit(1852.0))).first()
    assert one[0] == pytest.approx(3.280839895) and one[1] == 1.0


def test_mercator_clamps_but_keeps_missing(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-180.0, 90.0), (180.0, -90.0), (1.0, None)], "lon double, lat double")
    rows = df.select(geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat")), geo.is_clamped(F.col("lat"))).collect()
    assert rows[0][:2] == pytest.approx((0.5, 0.5))
    assert rows[1][:2] == pytest.approx((0.0, 0.0), abs=1e-9) and rows[1][2] is True
    assert rows[2][:2] == pytest.approx((1.0, 1.0), abs=1e-9)
    assert rows[3][1] is None
    assert geo.mercator_point(0, 0) == pytest.approx((0.5, 0.5))
    with pytest.raises(ValueError):
        geo.mercator_point(181, 0)


def test_coordinate_text(spark):
    assert spark.range(1).select(geo.format_coordinate(F.lit(-1.55), F.lit(53.99))).first()[0] == "Lat 53.99000°  Lon -1.55000°"


def test_scales(spark):
    assert axis_bounds(5, 5) == (4.0, 6.0) and axis_bounds(-100, -100) == (-105.0, -95.0) and axis_bounds(7, 7, date=True) == (-993.0, 1007.0)
    assert axis_bounds(None, None) == (0.0, 1.0) and axis_bounds(-1, 5, "log10") == (1.0, 10.0)
    assert axis_bounds(10, 10, "log10") == pytest.approx((10 / math.sqrt(10), 10 * math.sqrt(10)))
    assert math.isnan(scale_value(0, "log10")) and unscale_value(400, "log10") == values.MAX_DOUBLE and unscale_value(-400, "log10") == values.MIN_DOUBLE
    df = spark.createDataFrame([(-1.0,), (0.0,), (100.0,), (None,)], "v double")
    assert [r[0] for r in df.select(log10_scale(F.col("v"))).collect()] == [None, None, 2.0, None]
    assert [r[0] for r in df.select(unlog10(log10_scale(F.col("v")))).collect()] == [None, None, 100.0, None]
    wide = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)], "v double")
    assert [r[0] for r in wide.select(normalize_axis(F.col("v"), -1.7e308, 1.7e308)).collect()] == [-1.0, 0.0, 1.0]
