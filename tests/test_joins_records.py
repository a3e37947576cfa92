"""Joins, records, exports, colours, highlights and picking on small tables."""

import glob
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pointloom.functions.colors import COLOR_COUNT, gradient, gradient_hex
from pointloom.functions.geo import mercator_x, mercator_y
from pointloom.functions.geo import mercator_point
from pointloom.operators.axes import axis_for
from pointloom.operators.charts import ChartSpec, prepare, scatter_raw
from pointloom.operators.coloring import Coloring, category_color, category_palette, color_codes, excluded_count, legend_table, map_visibility, settle_codes
from pointloom.operators.ellipses import EllipseConfig, ellipse_outlines, ellipse_params, ellipse_samples, invalid_ellipses, stride_sample, thinning_stride
from pointloom.operators.expressions import compile_expression, rule
from pointloom.operators.highlights import chart_rows, highlight_counts, highlight_scatter
from pointloom.operators import joins, ordering
from pointloom.operators.joins import JoinOptions, join_guard, join_inner, join_left, join_preview, join_report, join_schema, row_bits, semi_applied
from pointloom.operators.ordering import with_position
from pointloom.operators.picking import grid_groups, pick_radius, pick_rectangle, viewport_rows, world_cells
from pointloom.operators.records import get_records, load_limit, record_at, records_index, records_json, records_page, records_sort
from pointloom.sinks.export import export_headers, export_records_csv, export_selection_csv, safe_export_name, save_joined

LEFT = [("001", 1.0), ("x", 2.0), ("  ", 3.0), ("001", None)]
RIGHT = [("001", "a"), ("001", "b"), ("x", "c"), ("X", "d"), (None, "e")]


@pytest.fixture
def sides(table):
    return (table("key string, value double", LEFT, name="L"), table("key string, note string", RIGHT, name="R"))


def test_report_equals_the_join(sides):
    for mode, rows in (("inner", 5), ("left", 6)):
        options = JoinOptions("key", "key", mode)
        report = join_report(*sides, options).first().asDict()
        assert report == {"left_rows": 4, "right_rows": 5, "matched_left": 3, "unmatched_left": 1, "missing_left": 1, "missing_right": 1, "duplicate_right_keys": 1,
                          "output_rows": rows}
        joined = (join_inner if mode == "inner" else join_left)(*sides, options)
        assert joined.count() == rows
        preview = [(r.lrow, r.rrow) for r in join_preview(*sides, options).collect()]
        assert preview == sorted(((r.lrow, r.rrow) for r in joined.collect()), key=lambda p: (p[0], -1 if p[1] is None else p[1]))


def test_preview_stops_at_eight(table):
    left = table("k double", [(float(i % 2),) for i in range(40)])
    right = table("k double", [(1.0,) for _ in range(30)] + [(0.0,)])
    got = [(r.lrow, r.rrow) for r in join_preview(left, right, JoinOptions("k", "k")).collect()]
    assert got == [(0, 30), *[(1, i) for i in range(7)]]


def test_join_names_and_mistakes(sides, table):
    left, right = sides
    names = [n for _, _, n, _ in join_schema(left, right, JoinOptions("key", "key", left_name="S", right_name="S"))]
    assert names == ["S.key", "S.value", "S (2).key", "S (2).note", "S.@id", "S (2).@id", "S.@longitude", "S.@latitude", "S (2).@longitude", "S (2).@latitude"]
    few = JoinOptions("key", "key", left_columns=["value"], right_columns=[], left_id=False, right_id=False, right_coordinates=False)
    assert [n for _, _, n, _ in join_schema(left, right, few)] == ["Dataset 1.value", "Dataset 1.@longitude", "Dataset 1.@latitude"]
    odd = table("`@id` string, `Dataset 1.x` double", [("1", 1.0)])
    clash = [n for _, _, n, _ in join_schema(odd, odd, JoinOptions("@id", "@id"))]
    assert len(set(clash)) == len(clash) and "Dataset 1.@id_2" in clash
    for bad in (JoinOptions("value", "key"), JoinOptions("key", "key", "outer"), JoinOptions("key", "key", max_rows=0), JoinOptions("nope", "key")):
        with pytest.raises(ValueError):
            join_report(left, right, bad)
    with pytest.raises(ValueError):
        join_schema(left, right, JoinOptions("key", "key", left_columns=["gone"]))


def test_saved_join_is_a_table_of_its_own(sides, tmp_path):
    saved = save_joined(*sides, JoinOptions("key", "key", "left"), str(tmp_path / "j"))
    rows = saved.df.orderBy("row_id").select("row_id", "`Dataset 1.value`", "`Dataset 2.note`").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0, "a"), (1, 1.0, "b"), (2, 2.0, "c"), (3, 3.0, None), (4, None, "a"), (5, None, "b")]
    assert saved.df.where(compile_expression(saved, rule("Dataset 2.note", "eq", "b"))).count() == 2
    with pytest.raises(ValueError, match="above the 2 row limit"):
        save_joined(*sides, JoinOptions("key", "key", max_rows=2), str(tmp_path / "k"))
    with pytest.raises(ValueError, match="no rows"):
        join_guard(join_report(sides[0], sides[1].with_df(sides[1].df.where("false")), JoinOptions("key", "key")), JoinOptions("key", "key"))


def test_a_hot_key_stays_exact(table):
    """A third of all rows share one key; the report never builds their pairs."""
    left = table("k string", [("hot",) if i % 3 == 0 else (f"k{i}",) for i in range(900)])
    right = table("k string", [("hot",) if i % 3 == 0 else (f"k{i}",) for i in range(600)])
    report = join_report(left, right, JoinOptions("k", "k")).first()
    assert report.output_rows == 300 * 200 + 400 == join_inner(left, right, JoinOptions("k", "k")).count()


# --- records --------------------------------------------------------------

@pytest.fixture
def book(table):
    return table("value double, note string", [(9.0, "b10"), (2.0, "b9"), (None, None), (2.0, "A")], ids=["x1", None, "Y", "z"], lon=[1.5, 2.0, 3.0, -4.0], name="book")


def order(df):
    return [r[0] for r in df.select("row_id").collect()]


def test_sorting_keeps_missing_last_and_ties_in_load_order(book):
    assert order(records_sort(book, "value")) == [1, 3, 0, 2] and order(records_sort(book, "value", True)) == [0, 1, 3, 2]
    assert order(records_sort(book, "note")) == [3, 1, 0, 2] and order(records_sort(book, "note", True)) == [0, 1, 3, 2]
    assert order(records_sort(book, "@source", True)) == [0, 1, 2, 3] and order(records_sort(book, "@longitude")) == [3, 0, 1, 2]
    assert order(records_sort(book, "@id")) == [0, 2, 3, 1]


def test_search_looks_at_everything(book):
    assert order(records_sort(book, search=" NULL ")) == [1, 2] and order(records_sort(book, search="-4")) == [3] and order(records_sort(book, search="y")) == [2]
    assert order(records_sort(book, search="1.5")) == [0] and order(records_sort(book, search="9.0")) == []


def test_pages_and_positions(book):
    page, total = records_page(book, 99, 2, "value")
    assert total == 4 and order(page) == [2]
    assert order(record_at(book, 1, "value")) == [3] and order(load_limit(book, 2).df) == [0, 1]
    assert [(r.position, r.row_id) for r in records_index(book, "value").orderBy("position").collect()] == [(0, 1), (1, 3), (2, 0), (3, 2)]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            records_page(book, 0, bad)
    with pytest.raises(ValueError):
        load_limit(book, 0)


def test_dense_positions_over_many_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id").repartition(16)
    rows = with_position(df, [F.col("k"), F.col("id")]).collect()
    assert [(r.k, r.id) for r in sorted(rows, key=lambda r: r.position)] == sorted((r.k, r.id) for r in rows)
    assert sorted(r.position for r in rows) == list(range(5000))


def test_records_as_json(book):
    rows = {r.row: json.loads(r.record) for r in records_json(book).collect()}
    assert rows[2] == {"source": "book", "id": "Y", "coordinates": [3.0, 0.0], "properties": {"value": None, "note": None}}
    assert order(get_records(book, [1, 3]).orderBy("row_id")) == [1, 3]


def test_exports(book, table, tmp_path):
    t = table("longitude double, featureId string, `notes,\"quoted\"` string, ok boolean", [(1.0, "a,b", 'say "hi"\nthere', True), (None, None, None, None)])
    assert export_headers(t)[:3] == ["featureId_2", "longitude_2", "latitude"]
    path = str(tmp_path / "all")
    export_selection_csv(t, path, single=True)
    text = open(glob.glob(path + "/*.csv")[0], newline="").read()
    assert text == ('featureId_2,longitude_2,latitude,longitude,featureId,"notes,""quoted""",ok\n'
                    'p0,0,0,1,"a,b","say ""hi""\nthere",true\np1,0,0,,,,\n')
    empty = str(tmp_path / "none")
    export_selection_csv(t, empty, F.lit(False), single=True)
    assert open(glob.glob(empty + "/*.csv")[0], newline="").read().count("\n") == 1
    ordered = str(tmp_path / "records")
    export_records_csv(book, ordered, ["@id", "value", "@source"], "value", single=True)
    assert open(glob.glob(ordered + "/*.csv")[0], newline="").read() == "id,value,source\n,2,book\nz,2,book\nx1,9,book\nY,,book\n"
    assert safe_export_name("  Köln / 2024: a_b ") == "Köln-2024-a_b-filtered.csv" and safe_export_name("...") == "data-source-filtered.csv"


# --- colours and highlights -----------------------------------------------

def test_category_colors_follow_the_sorted_domain(table):
    t = table("c string", [(v,) for v in ["b", "a", None, "b", ""] + [f"n{i:02d}" for i in range(12)]])
    colors = {r.value: r.color for r in category_palette(t, "c", {"a": "#ABCDEF", "b": "red"}).collect()}
    assert colors[""] == "#4477aa" and colors["a"] == "#ABCDEF" and colors["b"] == "#228833" and len(set(colors.values())) == 15
    rows = {r.row: r.color for r in category_color(t, "c").collect()}
    assert rows[2] == "#808080" and rows[0] == rows[3] == "#228833"
    legend = legend_table(t, Coloring("c"), "s").orderBy("position").collect()
    assert legend[0].label == "(empty string)" and legend[-1].key == "missing" and len(legend) == 16


def test_clashing_codes_move_on_in_rank_order(spark):
    codes = [5, 5, 6, 5, 0xFFFFFF, 0xFFFFFF, 6]
    used, want = set(), []
    for c in codes:
        while c in used:
            c = (c + 1) % (1 << 24)
        used.add(c)
        want.append(c)
    df = spark.createDataFrame([(f"v{i}", i, c) for i, c in enumerate(codes)], "value string, rank bigint, code bigint")
    assert [r.code for r in settle_codes(df).orderBy("rank").collect()] == want


def test_log_color_codes(table):
    t = table("v double", [(v,) for v in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0, 0.0, -1.0, None)])
    assert [r.code for r in color_codes(t, "v", 8, "log10").orderBy("row").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 255, 255, 255]
    assert excluded_count(t, "v", "log10").first()[0] == 2
    for bad in (1, 65):
        with pytest.raises(ValueError):
            color_codes(t, "v", bad)


def test_visibility_tells_missing_from_text(table):
    t = table("c string", [(None,), ("",), ("missing",), ("A",), ("B",)])
    shown = lambda hidden: [r.visible for r in map_visibility(t, "c", 24, hidden).orderBy("row").collect()]
    assert shown(["missing"]) == [False, True, True, True, True] and shown(["category:missing", "category:"]) == [True, False, False, True, True]
    assert shown([]) == [True] * 5


def test_gradients():
    assert gradient_hex("viridis", 5) == ["#440154", "#3b528b", "#21918c", "#5ec962", "#fde725"] and gradient_hex("nope", 2) == ["#440154", "#fde725"]
    assert gradient(("#000000", "#ffffff"), 3)[1] == (0.5, 0.5, 0.5)


def test_row_sets_project_onto_charts(table):
    values = [f"v{i % 40}" if i % 10 else "Other categories" for i in range(400)]
    t = table("c string, x double, y double", [(v, float(i % 13), float(i % 7)) for i, v in enumerate(values)])
    for spec in (ChartSpec("c", "bar", "c"), ChartSpec("s", "scatter", "x", "y", bins=5)):
        chart, = prepare(t, [spec])
        everything = highlight_counts(t, chart, t.df.select(F.col("row_id").alias("row")))
        counts = {r.cell: r["count"] for r in everything.collect()}
        assert sum(counts.values()) == 400
        cell = max(counts)
        rows = chart_rows(t, chart, [cell])
        assert rows.count() == counts[cell]
        assert {r.cell: r["count"] for r in highlight_counts(t, chart, rows).collect()} == {cell: counts[cell]}
        half = compile_expression(t, rule("x", "lt", 6))
        assert chart_rows(t, chart, counts, half).count() == t.df.where(half).count()
    assert chart_rows(t, chart, []).count() == 0
    assert highlight_scatter(scatter_raw(t, "x", "y"), (0, 0.5), (0, 1)).count() == t.df.where("x <= 6").count()


# --- map ------------------------------------------------------------------

def test_grid_and_picking_match_a_plain_scan(table):
    lon, lat = [(i * 37 % 360) - 180.0 for i in range(500)], [(i * 53 % 170) - 85.0 for i in range(500)]
    t = table("n double", [(float(i),) for i in range(500)], lon=lon, lat=lat)
    xy = [mercator_point(a, b) for a, b in zip(lon, lat)]
    groups = grid_groups(t).collect()
    assert sum(g["count"] for g in groups) == 500 and all(0 <= g.grid_cell < 1024 for g in groups)
    box = (0.2, 0.3, 0.5, 0.6)
    inside = {i for i, (x, y) in enumerate(xy) if box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert {r.row for r in pick_rectangle(t, *box).collect()} == inside
    assert inside <= {r.row for r in viewport_rows(t, *box).collect()}
    assert viewport_rows(t, 0, 0, 1, 1).count() == 500 and viewport_rows(t, 1.5, 1.5, 2, 2).count() == 0
    x, y = xy[42]
    near = {i for i, p in enumerate(xy) if ((p[0] - x) ** 2 + (p[1] - y) ** 2) ** 0.5 * 512 * 4 <= 8}
    assert {r.row for r in pick_radius(t, x, y, 2, 10).collect()} == near and 42 in near
    assert world_cells(0, 0, 1, 1) == list(range(1024)) and len(world_cells(0.5, 0.5, 0.5, 0.5)) == 1


def test_ellipses(table):
    t = table("a double, b double, t double", [(2.0, 1.0, 30.0), (1.0, 2.0, 30.0), (1.0, 1.0, -90.0), (0.0, 1.0, 0.0), (1.0, None, 0.0), (1.0, 1.0, None), (3e7, 1.0, 0.0), (1.0, 1.0, 720.0)])
    rows = ellipse_params(t, EllipseConfig("a", "b", "t", "nm", "nm")).orderBy("row").collect()
    assert [(r.major_m, r.minor_m, r.angle) for r in rows[:3]] == [(3704.0, 1852.0, 30.0), (3704.0, 1852.0, 120.0), (1852.0, 1852.0, 270.0)]
    assert [r.valid for r in rows] == [True, True, True, False, False, False, False, True] and rows[7].angle == 0.0
    assert invalid_ellipses(ellipse_params(t, EllipseConfig("a", "b", "t"))).first()[0] == 4
    for bad in (dict(minor=""), dict(major_unit="km")):
        with pytest.raises(ValueError):
            EllipseConfig(**{"major": "a", "minor": "b", "orientation": "t", **bad})


def test_outlines_lie_on_their_ellipse(table):
    t = table("a double, b double, t double", [(100000.0, 50000.0, 0.0), (100000.0, 50000.0, 90.0)], lon=[0.0, 0.0], lat=[0.0, 0.0])
    rows = ellipse_outlines(t, EllipseConfig("a", "b", "t"), 64).collect()
    assert len(rows) == 128
    width = {r: max(p.x for p in rows if p.row == r) - min(p.x for p in rows if p.row == r) for r in (0, 1)}
    circumference = 2 * 3.141592653589793 * 6371008.8
    assert width[0] * circumference == pytest.approx(100000, rel=1e-2) and width[1] * circumference == pytest.approx(200000, rel=1e-2)
    units = ellipse_samples(16, 100.0)
    assert units.shape == (16, 2) and abs((units ** 2).sum(axis=1) - 1).max() < 1e-12
    # More vertices near the tips than a circle would have.
    assert (abs(units[:, 0]) > 0.85).sum() > (abs(ellipse_samples(16, 1.0)[:, 0]) > 0.85).sum()
    for bad in (3, 129, 4.5):
        with pytest.raises(ValueError):
            ellipse_samples(bad, 1.0)


def test_thinning_takes_one_row_per_block(table):
    t = table("n double", [(float(i),) for i in range(100)])
    kept = sorted(r.row_id for r in stride_sample(t, 8).collect())
    assert len(kept) == 13 and all(k // 8 == i for i, k in enumerate(kept))
    assert stride_sample(t, 1).count() == 100 and thinning_stride(10_000_000, 1000, 1000) == 1000 and thinning_stride(100, 10, 10) == 1
    assert axis_for(t, "n").size == 24


def test_numbers_that_are_not_finite_never_match(table):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (0.0,), (None,)]
    left, right = table("k double", rows), table("k double", [*rows, (-0.0,)])
    left, right = (t.with_df(t.df.withColumn("k", table.F.when(table.F.col("row_id") == 0, table.F.lit(float("nan"))).otherwise(table.F.col("k")))) for t in (left, right))
    options = JoinOptions("k", "k")
    assert join_report(left, right, options).first()["output_rows"] == 2 and join_inner(left, right, options).count() == 2


def test_picking_reaches_the_files(spark, table, tmp_path):
    rows = [(float(i),) for i in range(400)]
    lon, lat = [-180 + 0.9 * i for i in range(400)], [-90 + (i * 37 % 400) * 0.45 for i in range(400)]
    t = table("v double", rows, lon=lon, lat=lat)
    t.df.write.parquet(str(tmp_path / "p"))
    t = t.with_df(spark.read.parquet(str(tmp_path / "p")))
    for box in ((0.2, 0.1, 0.6, 0.4), (0.0, 0.0, 1.0, 1.0), (0.3, 0.0, 0.9, 0.5), (0.1, 0.5, 0.2, 1.0)):
        picked = pick_rectangle(t, *box)
        x, y = mercator_x(table.F.col("lon")), mercator_y(table.F.col("lat"))
        want = t.df.where(x.between(box[0], box[2]) & y.between(box[1], box[3]))
        assert sorted(r.row for r in picked.collect()) == sorted(r.row_id for r in want.collect())
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = pick_radius(t, 0.5, 0.5, 3)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{test}({c}," in plan for test in ("GreaterThanOrEqual", "LessThanOrEqual") for c in ("lon", "lat"))


def test_a_crowded_palette_settles_as_one_after_another(spark):
    ranks, codes = 100_000, lambda i: (i * 7919) % 11_600 * 1000 % COLOR_COUNT
    taken, want = {}, []
    for i in range(ranks):
        path, c = [], codes(i)
        while c in taken:
            path.append(c)
            c = taken[c]
        for p in path:
            taken[p] = c
        want.append(c)
        taken[c] = (c + 1) % COLOR_COUNT
    df = spark.range(ranks).selectExpr("concat('v', id) AS value", "id AS rank", "id * 7919 % 11600 * 1000 % 16777216 AS code")
    assert [r.code for r in settle_codes(df).orderBy("rank").collect()] == want
    ends = spark.createDataFrame([("a", 0, COLOR_COUNT - 1), ("b", 1, COLOR_COUNT - 1), ("c", 2, 0), ("d", 3, 5)], "value string, rank bigint, code bigint")
    assert [r.code for r in settle_codes(ends).orderBy("rank").collect()] == [COLOR_COUNT - 1, 0, 1, 5]


def test_row_sets_are_bits(spark, table):
    t = table("v double", [(float(i % 7),) for i in range(3000)])
    base = t.df.select(t.col(t.row)).toPandas().iloc[:, 0].tolist()
    asked = [r for r in base if r % 3 == 0] * 2 + [10 ** 12, -1, -64, None]
    ids = spark.createDataFrame([(r,) for r in asked], "row long")
    words = {r["__word"]: r["__bits"] for r in row_bits(ids).collect()}
    assert sorted(w * 64 + b for w, bits in words.items() for b in range(64) if bits >> b & 1) == sorted({r for r in asked if r is not None})
    got = semi_applied(t, ids, t.col("v") < 3)
    assert got.columns == t.df.columns
    assert sorted(r[t.row] for r in got.collect()) == [r for i, r in enumerate(base) if r % 3 == 0 and i % 7 < 3]
    assert semi_applied(t, ids.limit(0)).count() == 0


# --- many pairs from few rows ---------------------------------------------

MANY = [("hot" if i % 3 else f"k{i % 7}", float(i)) for i in range(300)] + [(None, -1.0), ("  ", -2.0), ("lonely", -3.0)]
PARTNERS = [("hot" if i % 4 else f"k{i % 5}", f"n{i}") for i in range(200)] + [(None, "x")]


def _expected(mode, left=MANY, right=PARTNERS, ids=None):
    pairs = []
    for i, (k, _) in enumerate(left):
        met = [j for j, (o, _) in enumerate(right) if k is not None and k.strip() and o == k]
        pairs += [((ids or range(len(left)))[i], j) for j in met] or ([((ids or range(len(left)))[i], None)] if mode == "left" else [])
    return sorted(pairs, key=lambda p: (p[0], -1 if p[1] is None else p[1]))


@pytest.mark.parametrize("mode", ["inner", "left"])
def test_heavy_keys_are_joined_in_blocks(table, monkeypatch, mode):
    """A key with many rows on both sides is dealt to many tasks, and each pair comes once."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 16)
    left, right = table("key string, value double", MANY), table("key string, note string", PARTNERS)
    rows = (join_inner if mode == "inner" else join_left)(left, right, JoinOptions("key", "key", mode)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(((r.lrow, r.rrow) for r in rows), key=lambda p: (p[0], -1 if p[1] is None else p[1])) == _expected(mode)
    hot = {r.lrow for r in rows if r["Dataset 1.key"] == "hot"}
    assert len(hot) == 200 and len({r.task for r in rows if r.lrow in hot}) > 1


@pytest.mark.parametrize("mode", ["inner", "left"])
def test_saved_join_is_numbered_without_sorting_pairs(table, monkeypatch, tmp_path, mode):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 16)
    left, right = table("key string, value double", MANY), table("key string, note string", PARTNERS)
    sorted_sizes = []
    fixed = ordering._fixed
    monkeypatch.setattr(ordering, "_fixed", lambda df, keys: (sorted_sizes.append(df.count()), fixed(df, keys))[1])
    saved = save_joined(left, right, JoinOptions("key", "key", mode), str(tmp_path / "j")).df.orderBy("row_id").collect()
    want = _expected(mode)
    assert [r.row_id for r in saved] == list(range(len(want)))
    assert [(r["Dataset 1.value"], r["Dataset 2.note"]) for r in saved] == [(MANY[i][1], None if j is None else PARTNERS[j][1]) for i, j in want]
    assert max(sorted_sizes) <= len(MANY)  # of thousands of pairs none is sorted


def test_saved_pairs_take_little_room(table, tmp_path):
    """Pairs are written in the order of their numbers, so that numbers and ids are kept as differences (9 bytes a pair without)."""
    left, right = table("key string, value double", [("hot", i / 7) for i in range(1200)]), table("key string, note string", [("hot", f"n{i}") for i in range(1000)])
    save_joined(left, right, JoinOptions("key", "key"), str(tmp_path / "j"))
    assert sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "j" / "*.parquet"))) < 1_200_000


def test_each_left_row_meets_lists_of_right_rows_in_order(table, monkeypatch):
    """Pairs come as runs of one left row with right rows in a row, whose columns take little room; blocks grow with the pairs."""
    assert [joins._left_rows(n) for n in (0, 2 * 1024 ** 2, 256 * 512 * 2000, 10 ** 12)] == [1024, 1024, 2000, 16_384]
    monkeypatch.setattr(joins, "BLOCK_ROWS", 16)
    monkeypatch.setattr(joins, "LIST_ROWS", 16)
    left, right = table("key string, value double", [("hot", 0.0)] * 100), table("key string, note string", [("hot", "n")] * 60)
    pairs = [(r.lrow, r.rrow) for r in join_inner(left, right, JoinOptions("key", "key")).select("lrow", "rrow").collect()]
    assert sorted(pairs) == [(i, j) for i in range(100) for j in range(60)]
    at = 0
    while at < len(pairs):
        i, j = pairs[at]
        size = min(16, 60 - j)
        assert j % 16 == 0 and pairs[at:at + size] == [(i, j + k) for k in range(size)]
        at += size
    same = left.with_df(left.df.withColumn("row_id", F.lit(7).cast("bigint")).withColumn("point_id", F.lit("p")))
    twice = right.with_df(right.df.withColumn("row_id", F.when(F.col("row_id") > 1, F.floor(F.col("row_id") / 2))))
    rows = join_inner(same, twice, JoinOptions("key", "key")).select("lrow", "rrow").collect()
    assert Counter((r.lrow, r.rrow) for r in rows) == {(7, None): 200, **{(7, j): 200 for j in range(1, 30)}}


def test_saved_join_with_repeated_and_missing_row_ids(table, tmp_path):
    left, right = table("key string, value double", MANY[:40]), table("key string, note string", PARTNERS[:40])
    again = left.with_df(left.df.withColumn("row_id", F.when(F.col("row_id") % 10 != 0, F.floor(F.col("row_id") / 2))))
    options = JoinOptions("key", "key", "left")
    pairs = join_left(again, right, options).orderBy("lrow", F.asc_nulls_first("rrow")).collect()
    saved = save_joined(again, right, options, str(tmp_path / "j")).df.orderBy("row_id").collect()
    assert [r.row_id for r in saved] == list(range(len(pairs)))
    place = {f"p{i}": (None if i % 10 == 0 else i // 2) for i in range(40)}
    number = {n: i for i, (_, n) in enumerate(PARTNERS)}
    assert [(place[r["Dataset 1.@id"]], number.get(r["Dataset 2.note"])) for r in saved] == [(r.lrow, r.rrow) for r in pairs]


def test_only_distinct_texts_are_compared_under_the_locale(table, monkeypatch, tmp_path):
    texts = ["b10", "b9", "B9", "b09", None, "a", "é", "é", "e", "b10", ""] * 20
    points = table("t string", [(t,) for t in texts])
    sizes = []
    fixed = ordering._fixed
    monkeypatch.setattr(ordering, "_fixed", lambda df, keys: (sizes.append(df.count()), fixed(df, keys))[1])
    for descending in (False, True):
        want = [r.row_id for r in records_sort(points, "t", descending).collect()]
        sizes.clear()
        assert [r.row_id for r in records_index(points, "t", descending).orderBy("position").collect()] == want
        assert sizes == [9, len(texts)]  # the locale is asked about nine texts, the rest are numbers
        assert records_page(points, 30, 50, "t", descending, shallow=0)[0].select("row_id").collect() == [(i,) for i in want[30:80]]
        path = str(tmp_path / f"e{descending}")
        export_records_csv(points, path, ["t", "@id"], "t", descending, single=True)
        with open(glob.glob(f"{path}/*.csv")[0]) as f:
            assert [line.rstrip("\n").split(",")[-1] for line in f][1:] == [f"p{i}" for i in want]
