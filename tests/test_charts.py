"""Bins, charts and comparisons. The contract: rows a bin's filter selects == count of the bin."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.functions.values import parse_utc
from pointloom.operators.axes import (OTHER, axis_for, bin_edges, build_axis, cell_predicate, chart_domain, range_predicate, segments_predicate, shared_domain)
from pointloom.operators.charts import (ChartSpec, default_charts, hist_bar, log_y_omit, missing_count, pie_shares, prepare, run_charts, scatter_binned, scatter_raw,
                                        time_series)
from pointloom.operators.expressions import compile_expression, rule
from pointloom.operators.series import Series, combine_raw, combine_series
from pointloom.operators.timeline import pick_time_field, relative_window, timeline_extent, union_extents
from pointloom.table import Field, describe


def duality(t, axis):
    """Count every bin twice: by the bin expression and by its filter."""
    by_bin = {r[0]: r[1] for r in t.df.groupBy(axis.bin(t).alias("b")).count().collect()}
    tests = [F.count_if(compile_expression(t, axis.predicate(i))) for i in range(axis.size)]
    by_filter = list(t.df.agg(*tests).first()) if tests else []
    assert [by_bin.get(i, 0) for i in range(axis.size)] == by_filter
    assert sum(by_bin.values()) - by_bin.get(None, 0) == sum(by_filter)
    return by_filter


def numbers(table, values):
    return table("v double", [(None if v is None else float(v),) for v in values])


HARD = {"digits": range(1, 10), "huge": [-1.7e308, -1e308, 0, 1e308, 1.7e308], "tiny": [5e-324, 1e-323, 1.5e-323, 2e-323, 1e-322], "tenths": [i * 0.1 for i in range(61)],
        "narrow": [1e16, 1e16 + 2, 1e16 + 4, 1e16 + 10], "mixed": [-3.5, 0, 1e-9, 7, 7, 123.456, None], "thirds": [i / 3 for i in range(100)]}


@pytest.mark.parametrize("name", HARD)
@pytest.mark.parametrize("bins", [2, 7, 24, 64])
def test_numeric_bins_are_their_filters(table, name, bins):
    t = numbers(table, HARD[name])
    axis = axis_for(t, "v", bins)
    assert axis.edges[0] == min(v for v in HARD[name] if v is not None) and axis.size == bins
    duality(t, axis)


@pytest.mark.parametrize("values", [[0, -10, None, 0.01, 0.1, 1, 10, 100, 1000], [10 ** (i / 7) for i in range(-40, 40)], [1, 1 + 1e-15, 1 + 4e-15], [5e-324, 1e-300, 1e308]])
def test_log_bins_are_their_filters(table, values):
    t = numbers(table, values)
    for bins in (2, 5, 24):
        got = duality(t, axis_for(t, "v", bins, "log10"))
        assert sum(got) == sum(1 for v in values if v is not None and v > 0)
    assert axis_for(t, "v", 5, "log10").edges[-1] == max(v for v in values if v is not None)


def test_dates_a_millisecond_apart(spark, table):
    t = table("day string", [(f"2024-01-01T00:00:00.{i:03d}",) for i in range(17)] + [(None,)])
    t = describe(t.df.withColumn("day", parse_utc(F.col("day"))), row="row_id", id="point_id", lon="lon", lat="lat")
    assert sum(duality(t, axis_for(t, "day", 24))) == 17
    # Microseconds belong to the millisecond they fall in.
    fine = t.with_df(t.df.withColumn("day", F.col("day") + F.expr("interval 700 microseconds")))
    assert sum(duality(fine, axis_for(fine, "day", 24))) == 17


def test_constant_empty_boolean_and_log_edges(table):
    t = table("c double, e double, b boolean, text string", [(5.0, None, True, None), (5.0, None, None, None)])
    assert axis_for(t, "c").labels == ("5",) and duality(t, axis_for(t, "c")) == [2]
    assert axis_for(t, "e").size == 0 and axis_for(t, "text").size == 0
    assert duality(t, axis_for(t, "b")) == [0, 1]
    assert bin_edges(1, 1000, 3, scale="log10") == pytest.approx((1, 10, 100, 1000))
    got = {r.cell: r["count"] for r in hist_bar(t, "e").collect()}
    assert got == {-1: 2}
    for bad in (dict(bins=1), dict(bins=65), dict(bins=2.5), dict(scale="sqrt")):
        with pytest.raises(ValueError):
            build_axis("v", chart_domain(t, "c"), **{"bins": 24, **bad})
    with pytest.raises(ValueError):
        build_axis("b", chart_domain(t, "b"), 4, "log10")


def test_categories_ties_and_the_rest(table):
    values = [f"v{i:02d}" for i in range(30)] * 2 + ["v29"] * 20 + [None, "", "it's \\ \"odd\"", OTHER]
    t = table("text string", [(v,) for v in values])
    axis = axis_for(t, "text")
    assert axis.labels[:3] == ("v29", "v00", "v01") and axis.size == 24 and axis.labels[-1] == OTHER
    counts = duality(t, axis)
    assert counts[0] == 22 and sum(counts) == len(values) - 1
    few = table("text string", [("a'b",), ("c\\",), ("a'b",), (None,), ("Other categories",)])
    assert axis_for(few, "text").labels == ("a'b", "c\\", "Other categories") and duality(few, axis_for(few, "text")) == [2, 1, 1]


def test_bins_do_not_move_under_a_filter(table):
    t = table("v double, text string", [(float(i), "a" if i % 2 else "b") for i in range(100)])
    for expression, selected in ((None, 100), (rule("v", "lt", 10), 10), (rule("v", "gt", 1000), 0)):
        rows = run_charts(t, [ChartSpec("v", "bar", "v", bins=10), ChartSpec("t", "bar", "text")], expression).collect()
        assert len([r for r in rows if r.chart_id == "v"]) == 11 and len([r for r in rows if r.chart_id == "t"]) == 3
        for chart in ("v", "t"):
            assert sum(r["count"] for r in rows if r.chart_id == chart) == selected


MEASURES = "x double, day string, y double, text string"


def test_time_series_measures(table):
    t = table(MEASURES, [(float(i), f"2024-01-{i + 1:02d}", None if i == 9 else float(i * i), "k") for i in range(10)])
    t = describe(t.df.withColumn("day", parse_utc(F.col("day"))), row="row_id", id="point_id", lon="lon", lat="lat")
    values = {}
    for aggregate in ("sum", "mean", "min", "max"):
        rows = sorted(time_series(t, "day", "y", aggregate, 3).collect(), key=lambda r: r.cell)
        assert [r["count"] for r in rows] == [1, 3, 3, 3]
        values[aggregate] = [r.value for r in rows[1:]]
    assert values == {"sum": [5, 50, 149], "mean": [5 / 3, 50 / 3, 149 / 3], "min": [0, 9, 36], "max": [4, 25, 64]}
    counted = sorted(time_series(t, "day", bins=3).collect(), key=lambda r: r.cell)
    assert [r["count"] for r in counted] == [0, 3, 3, 4] and all(r.value is None for r in counted)
    assert missing_count(time_series(t, "day", "y", "sum", 3)).first().missing == 1
    for bad in (ChartSpec("t", "time", "x"), ChartSpec("t", "time", "day", "text", aggregate="sum"), ChartSpec("t", "time", "day", aggregate="mean"),
                ChartSpec("t", "time", "day", "y", aggregate="median"), ChartSpec("s", "scatter", "x"), ChartSpec("p", "donut", "x"), ChartSpec("x", "bar", "nope")):
        with pytest.raises(ValueError):
            prepare(t, [bad])
    with pytest.raises(ValueError):
        prepare(t, [ChartSpec(str(i), "bar", "x") for i in range(13)])


def test_scatter_cells_and_their_filters(table):
    t = table("x double, y double", [(float(i % 7), float(i % 5)) for i in range(100)] + [(None, 1.0), (1.0, None)])
    chart, = prepare(t, [ChartSpec("s", "scatter", "x", "y", bins=4)])
    cells = {r.cell: r["count"] for r in scatter_binned(t, "x", "y", 4).collect()}
    assert len(cells) == 17 and cells[-1] == 2 and sum(cells.values()) == 102
    for y in range(4):
        for x in range(4):
            test = compile_expression(t, cell_predicate(chart.x, chart.y, (x, y), (x, y)))
            assert t.df.where(test).count() == cells[y * 4 + x]
    block = compile_expression(t, cell_predicate(chart.x, chart.y, (3, 2), (1, 0)))
    assert t.df.where(block).count() == sum(cells[y * 4 + x] for x in (1, 2, 3) for y in (0, 1, 2))


def test_segments_runs_and_pie(table):
    t = table("text string", [(c,) for c in "aaabbc"] + [(None,)])
    axis = axis_for(t, "text")
    assert segments_predicate(axis, [2, 0]) == {"op": "or", "children": [rule("text", "eq", "a"), rule("text", "eq", "c")]}
    assert segments_predicate(axis, [1]) == rule("text", "eq", "b")
    shares = {r.cell: round(r.percent, 6) for r in pie_shares(t, "text").collect()}
    assert shares == {0: 50.0, 1: 33.333333, 2: 16.666667}
    assert {r.percent for r in pie_shares(t, "text", expression=rule("text", "eq", "zz")).collect()} == {0.0}


def test_raw_scatter_positions_and_brush(table):
    t = table("x double, y double, text string", [(0.0, 10.0, "a"), (5.0, 15.0, "b"), (10.0, 20.0, "a"), (None, 1.0, "a"), (2.0, None, None)])
    raw = scatter_raw(t, "x", "y")
    assert sorted(tuple(r) for r in raw.rows.collect()) == [(0, -1.0, pytest.approx(-0.05263157894736836)), (1, 0.0, pytest.approx(0.4736842105263157)), (2, 1.0, 1.0)]
    assert raw.missing().first().missing == 2 and raw.bounds == (0.0, 1.0, 10.0, 20.0)
    labels = scatter_raw(t, "x", "text")
    assert sorted((r.row, r.y) for r in labels.rows.collect()) == [(0, -0.5), (1, 0.5), (2, -0.5)]
    extent = raw.extent().first()
    assert (extent.x0, extent.x1) == (0.0, 1.0)
    fit = raw.fit().first()
    assert fit.x0 == pytest.approx(-0.04) and fit.x1 == pytest.approx(1.04)
    test = compile_expression(t, range_predicate(axis_for(t, "x"), (0.0, 10.0), 0.0, 0.5))
    assert sorted(r[0] for r in t.df.where(test).select("row_id").collect()) == [0, 1, 4]
    picked = compile_expression(t, range_predicate(axis_for(t, "text"), (0.0, 2.0), 0.0, 0.4))
    assert sorted(r[0] for r in t.df.where(picked).select("row_id").collect()) == [0, 2, 3]


def test_log_y_leaves_out_what_it_cannot_show(table):
    t = numbers(table, [1, 1, 2, 9])
    assert {r.cell: r["count"] for r in log_y_omit(hist_bar(t, "v", 4)).collect()} == {0: 3, 3: 1}


def test_shared_axes(table):
    a = table("x double, kind string", [(0.0, "red"), (5.0, "green"), (None, None)])
    b = table("v double, label string", [(10.0, "blue"), (5.0, "green"), (7.0, None)])
    parts = [Series("a", a, "x"), Series("b", b, "v")]
    rows = combine_series(ChartSpec("n", "bar", "", bins=2), parts).collect()
    got = {(r.source_id, r.cell): r["count"] for r in rows}
    assert got == {("a", -1): 1, ("a", 0): 1, ("a", 1): 1, ("b", -1): 0, ("b", 0): 0, ("b", 1): 3, (None, -1): 1, (None, 0): 1, (None, 1): 4}
    labels = combine_series(ChartSpec("l", "bar", ""), [Series("a", a, "kind"), Series("b", b, "label")]).collect()
    assert {r.cell: r["count"] for r in labels if r.source_id is None} == {-1: 2, 0: 1, 1: 2, 2: 1, 3: 0}
    hidden = combine_series(ChartSpec("n", "bar", "", bins=2), parts, hidden=["a", "b"]).collect()
    assert {(r.source_id, r.cell, r["count"]) for r in hidden} == {(None, -1, 0), (None, 0, 0), (None, 1, 0)}
    raw = combine_raw([Series("a", a, "x", "x"), Series("b", b, "v", "v")]).collect()
    assert sorted((r.source_id, r.row, r.x) for r in raw) == [("a", 0, -1.0), ("a", 1, 0.0), ("b", 0, 1.0), ("b", 1, 0.0), ("b", 2, pytest.approx(0.4))]
    with pytest.raises(ValueError):
        shared_domain([chart_domain(a, "x"), chart_domain(b, "label")])
    with pytest.raises(ValueError):
        shared_domain([])


def test_timeline(table):
    t = table("day string", [("2024-01-01",), ("2024-01-03T00:00+02:00",), (None,), ("bad",), ("2024-01-02",), ("2023-12-31T22:00-03:00",)])
    e = timeline_extent(t, "day").first()
    assert (e.valid, e.missing, e.start, e.end) == (4, 2, 1704067200000, 1704232800000)
    u = union_extents([timeline_extent(t, "day"), timeline_extent(t, "day")]).first()
    assert (u.valid, u.missing) == (8, 4)
    fields = [Field("a", "date"), Field("n", "number")]
    assert pick_time_field(fields) == "a" and pick_time_field(fields, "ns:a") == "a" and pick_time_field(fields, "zz") == ""
    assert pick_time_field([*fields, Field("b", "date")]) == ""
    from datetime import datetime, timezone
    assert relative_window(24, datetime(2024, 1, 2, tzinfo=timezone.utc)) == ("2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z")


def test_default_charts():
    fields = [Field("id", "number"), Field("t", "date"), Field("name", "string"), Field("a", "number"), Field("b", "number")]
    assert [(c.type, c.x, c.y) for c in default_charts(fields)] == [("bar", "name", None), ("time", "t", None), ("scatter", "a", "b")]
    assert [(c.type, c.x, c.y) for c in default_charts([Field("id", "number")])] == [("scatter", "id", "id")]


def test_labels_read_well(table):
    t = numbers(table, [0, 1.23456, 100000])
    assert axis_for(t, "v", 2).labels == ("0 – 50000", "50000 – 100000")
    assert math.isclose(axis_for(t, "v", 2).edges[1], 50000)
