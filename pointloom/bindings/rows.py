"""Records, colours, highlights, picking, ellipses and scalar functions over whole tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import geo, scales, values
from ..functions.colors import CATEGORY_COLORS
from ..operators.axes import axis_for
from ..operators.charts import ChartSpec, prepare, scatter_raw
from ..operators.coloring import (Coloring, category_color, category_palette, color_codes, excluded_count, gradient_color, legend_table,
                                  map_visibility)
from ..operators.ellipses import EllipseConfig, ellipse_outlines, ellipse_params, invalid_ellipses, stride_sample
from ..operators.expressions import compile_expression, rule
from ..operators.highlights import chart_rows, highlight_counts, highlight_scatter, inspect_matches
from ..operators.joins import intersect_rows
from ..operators.ordering import with_position
from ..operators.picking import grid_groups, pick_radius, pick_rectangle, viewport_rows, with_grid_cell
from ..operators.records import (choice_page, get_records, load_limit, record_at, record_texts, records_index, records_json, records_page,
                                 records_sort, sorted_domain)
from ..sinks.export import records_rows, selection_rows
from .charts import CUSTOMER, customer, part
from .filters import NESTED, NESTED_SQL
from .tables import POINTS, edges_sql, inside, points, read, register

NUMBER_TEXT = "CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"
ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us({t}) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z'"


def num(v: str) -> str:
    return NUMBER_TEXT.format(v=v)


def iso(t: str) -> str:
    return ISO.format(t=t)


# --- records --------------------------------------------------------------

SEARCHED = ("lower(point_id)", num("lon"), num("lat"), "category", num("value"), f"coalesce({num('reading')}, 'null')", f"lower({iso('ts')})",
            num("k"), "CAST(active AS VARCHAR)", 'coalesce("user", \'null\')')
SEARCH_SQL = " OR ".join(f"contains({c}, '{{needle}}')" for c in SEARCHED)


@register("records_search", f"SELECT row_id FROM {POINTS} p WHERE {SEARCH_SQL.format(needle='9.1')}")
def search(spark, folder):
    """A substring anywhere in the id, the coordinates or any value."""
    return records_sort(points(spark, folder), search="9.1").select("row_id")


@register("records_search_null", f"SELECT row_id FROM {POINTS} p WHERE {SEARCH_SQL.format(needle='null')}")
def search_null(spark, folder):
    return records_sort(points(spark, folder), search=" NULL ").select("row_id")


@register("records_sort", f"SELECT row_id, reading, row_number() OVER (ORDER BY reading DESC NULLS LAST, row_id) - 1 AS position FROM {POINTS} p")
def sort(spark, folder):
    """Descending with missing values last and ties in load order; the position shows the order."""
    return records_index(points(spark, folder), "reading", descending=True).select("row_id", "reading", "position")


@register("records_sort_text", "SELECT c_custkey AS row_id, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS position FROM customer")
def sort_text(spark, folder):
    return records_index(customer(spark, folder), "c_mktsegment").select("row_id", "c_mktsegment", "position")


@register("records_sort_natural", f"SELECT row_id, \"user\", row_number() OVER (ORDER BY CAST(substr(\"user\", 6) AS INT) NULLS LAST, row_id) - 1 AS position FROM {POINTS} p")
def sort_natural(spark, folder):
    """Digits inside text order by value: user-9 comes before user-10."""
    return records_index(points(spark, folder), "user").select("row_id", "user", "position")


PAGE_SQL = (f"WITH m AS (SELECT row_id, value, row_number() OVER (ORDER BY value, row_id) - 1 AS n, count(*) OVER () AS total FROM {POINTS} p WHERE {NESTED_SQL}) "
            "SELECT row_id, value, total FROM m WHERE n - greatest(0, least(200, total - 1)) BETWEEN 0 AND 49")
NTH_SQL = f"SELECT row_id, value FROM {POINTS} p ORDER BY value DESC, row_id LIMIT 1 OFFSET 4321"


@register("records_page", PAGE_SQL)
def page(spark, folder, **how):
    table = points(spark, folder)
    rows, total = records_page(table, 200, 50, "value", predicate=compile_expression(table, NESTED), **how)
    return rows.select("row_id", "value", F.lit(total).cast("bigint").alias("total"))


@register("records_page_deep", PAGE_SQL)
def deep_page(spark, folder):
    """The same page by the way that pages far down take."""
    return page(spark, folder, shallow=0)


@register("record_at", NTH_SQL)
def nth(spark, folder, **how):
    return record_at(points(spark, folder), 4321, "value", descending=True, **how).select("row_id", "value")


@register("record_at_deep", NTH_SQL)
def deep_nth(spark, folder):
    return nth(spark, folder, shallow=0)


@register("choice_page", f"SELECT row_id FROM {POINTS} p WHERE category = 'error' ORDER BY row_id LIMIT 30 OFFSET 60")
def choices(spark, folder):
    table = points(spark, folder)
    return choice_page(table, compile_expression(table, rule("category", "eq", "error")), 2).select("row_id")


LIMIT_SQL = f"SELECT row_id FROM {POINTS} p ORDER BY row_id LIMIT 2500"


@register("load_limit", LIMIT_SQL)
def limited(spark, folder, **how):
    return load_limit(points(spark, folder), 2500, **how).df.select("row_id")


@register("load_limit_deep", LIMIT_SQL)
def deep_limited(spark, folder):
    return limited(spark, folder, shallow=0)


@register("sorted_domain", "SELECT DISTINCT p_brand AS value FROM part WHERE contains(lower(p_brand), '#1')")
def domain(spark, folder):
    return sorted_domain(part(spark, folder), "p_brand", "#1")


@register("get_records", f"SELECT row_id, point_id, lon, lat, category, reading, ts FROM {POINTS} p WHERE row_id IN (3, 17, 34, 999) OR value > 60")
def records(spark, folder):
    """By a short list of ids and by a row set."""
    table = points(spark, folder)
    chosen = table.df.where("value > 60").select("row_id")
    few = get_records(table, [3, 17, 34, 999]).select("row_id")
    return get_records(table, chosen.union(few).distinct()).select("row_id", "point_id", "lon", "lat", "category", "reading", "ts")


@register("records_json", f"SELECT row_id AS row, point_id AS id, 'events' AS source, category, {iso('ts')} AS ts, reading FROM {POINTS} p")
def json_records(spark, folder):
    """Typed JSON text of every record, read back field by field."""
    table = points(spark, folder)
    parsed = records_json(table).select("row", F.from_json("record", "source string, id string, coordinates array<double>, "
                                                                      "properties struct<category: string, ts: string, reading: double>").alias("r"))
    return parsed.select("row", F.col("r.id").alias("id"), F.col("r.source").alias("source"), F.col("r.properties.category").alias("category"),
                         F.col("r.properties.ts").alias("ts"), F.col("r.properties.reading").alias("reading"))


@register("search_text", f"SELECT row_id AS row, category, {num('value')} AS value, coalesce({num('reading')}, 'null') AS reading, {iso('ts')} AS ts, {num('k')} AS k, "
                         f"CAST(active AS VARCHAR) AS active, coalesce(\"user\", 'null') AS \"user\" FROM {POINTS} p")
def texts(spark, folder):
    return record_texts(points(spark, folder))


# --- exports --------------------------------------------------------------

@register("export_selection_csv", f"SELECT point_id AS \"featureId\", {num('lon')} AS longitude, {num('lat')} AS latitude, category, {num('value')} AS value, {num('reading')} AS reading, "
                                  f"{iso('ts')} AS ts, {num('k')} AS k, CAST(active AS VARCHAR) AS active, \"user\" FROM {POINTS} p WHERE {NESTED_SQL}")
def exported(spark, folder):
    """Selected rows as export text."""
    table = points(spark, folder)
    return selection_rows(table, compile_expression(table, NESTED))


@register("export_records_csv", f"SELECT point_id AS id, {num('reading')} AS reading, 'events' AS source, {iso('ts')} AS ts FROM {POINTS} p WHERE {SEARCH_SQL.format(needle='12')}")
def exported_records(spark, folder):
    return records_rows(points(spark, folder), ["@id", "reading", "@source", "ts"], "reading", search="12")


# --- colours --------------------------------------------------------------

def _hex_sql(rank: str) -> str:
    fixed = "[" + ", ".join(f"'{c}'" for c in CATEGORY_COLORS) + "]"
    hue = f"((({rank})::DOUBLE * 0.618033988749895::DOUBLE) % 1 * 6)"
    c, base = f"(0.55::DOUBLE + ({rank} % 3) * 0.08::DOUBLE)", f"(0.1::DOUBLE + ({rank} % 4) * 0.035::DOUBLE)"
    x = f"({c} * (1 - abs({hue} % 2 - 1)))"
    order = {"r": "cxzzxc", "g": "xccxzz", "b": "zzxccx"}
    part_of = {"c": c, "x": x, "z": "0.0::DOUBLE"}
    channel = lambda k: "CASE floor(%s)::INT %s END" % (hue, " ".join(f"WHEN {i} THEN {part_of[v]}" for i, v in enumerate(order[k])))
    code = " || ".join(f"printf('%02x', floor((({channel(k)}) + {base}) * 255 + 0.5::DOUBLE)::INT)" for k in "rgb")
    return f"CASE WHEN {rank} < 10 THEN {fixed}[{rank} + 1] ELSE '#' || {code} END"


PALETTE = f"(SELECT v, rank, {_hex_sql('rank')} AS color FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rank FROM (SELECT DISTINCT {{v}} AS v FROM {{t}} WHERE {{v}} IS NOT NULL)))"
USERS = PALETTE.format(v='"user"', t=POINTS + " p")


@register("category_palette", f"SELECT v AS value, rank, CASE WHEN v = 'Brand#7' THEN '#123456' ELSE color END AS color FROM {PALETTE.format(v='p_brand', t='part')} c")
def palette(spark, folder):
    """Every distinct value with its colour, one of them overridden."""
    return category_palette(part(spark, folder), "p_brand", {"Brand#7": "#123456", "Brand#8": "not a colour"})


@register("category_color", f"SELECT row_id AS row, c.v AS value, coalesce(color, '#808080') AS color FROM {POINTS} p LEFT JOIN {USERS} c ON c.v = p.\"user\"")
def colored(spark, folder):
    return category_color(points(spark, folder), "user")


@register("color_codes", f"WITH b AS {edges_sql(POINTS, 'reading', 16)} SELECT row_id AS row, coalesce((SELECT b.i FROM b WHERE {inside('p.reading')}), 255) AS code FROM {POINTS} p")
def codes(spark, folder):
    return color_codes(points(spark, folder), "reading", 16)


@register("color_codes_log10", f"WITH b AS {edges_sql(CUSTOMER, 'c_acctbal', 9, scale='log10')} SELECT c_custkey AS row, coalesce((SELECT b.i FROM b WHERE {inside('p.c_acctbal')}), 255) AS code FROM customer p")
def codes_log(spark, folder):
    return color_codes(customer(spark, folder), "c_acctbal", 9, "log10")


@register("color_excluded", "SELECT count(*) AS excluded FROM customer WHERE c_acctbal <= 0")
def excluded(spark, folder):
    return excluded_count(customer(spark, folder), "c_acctbal", "log10")


@register("gradient_color", f"WITH b AS {edges_sql(POINTS, 'reading', 5)} SELECT row_id AS row, coalesce((SELECT b.i FROM b WHERE {inside('p.reading')}), 255) AS code, "
                            f"coalesce((SELECT ['#440154', '#3b528b', '#21918c', '#5ec962', '#fde725'][b.i + 1] FROM b WHERE {inside('p.reading')}), '#808080') AS color FROM {POINTS} p")
def gradient(spark, folder):
    return gradient_color(points(spark, folder), "reading", 5)


@register("map_visibility", f"WITH b AS {edges_sql(POINTS, 'reading', 8)} SELECT row_id AS row, coalesce((SELECT b.i FROM b WHERE {inside('p.reading')}) NOT IN (0, 3), FALSE) AS visible FROM {POINTS} p")
def visibility(spark, folder):
    return map_visibility(points(spark, folder), "reading", 8, ["bin:0", "bin:3", "missing"])


@register("map_visibility_category", f"SELECT row_id AS row, coalesce(\"user\" NOT IN ('user-1', 'user-2'), TRUE) AS visible FROM {POINTS} p")
def visibility_category(spark, folder):
    return map_visibility(points(spark, folder), "user", 24, ["category:user-1", "category:user-2"])


@register("legend_table", "SELECT 'parts' AS source_id, rank AS position, 'category:' || v AS key, v AS label, color FROM " + PALETTE.format(v="p_brand", t="part") +
          " c UNION ALL SELECT 'parts', (SELECT count(DISTINCT p_brand) FROM part), 'missing', 'Missing value', '#808080'")
def legend(spark, folder):
    return legend_table(part(spark, folder), Coloring("p_brand"), "parts")


# --- highlights -----------------------------------------------------------

def _chart(table):
    return prepare(table, [ChartSpec("s", "scatter", "value", "k", bins=10)])[0]


CELLS = f"bx AS {edges_sql(POINTS, 'value', 10)}, bt AS {edges_sql(POINTS, 'k', 10)}, r AS (SELECT p.*, bt.i * bx.n + bx.i AS cell FROM {POINTS} p JOIN bx ON {inside('value', 'bx')} JOIN bt ON {inside('k', 'bt')})"


@register("chart_rows", f"WITH {CELLS} SELECT row_id AS row FROM r WHERE cell IN (0, 11, 52, 53) AND category <> 'view'")
def rows_of_cells(spark, folder):
    table = points(spark, folder)
    return chart_rows(table, _chart(table), [0, 11, 52, 53, -1], compile_expression(table, rule("category", "ne", "view")))


@register("highlight_counts", f"WITH {CELLS} SELECT cell, count(*) AS count FROM r WHERE category = 'error' AND value > 5 GROUP BY cell")
def highlighted(spark, folder):
    """A row set brushed elsewhere, counted on the cells of this chart."""
    table = points(spark, folder)
    rows = table.df.where(compile_expression(table, rule("category", "eq", "error"))).select(F.col("row_id").alias("row"))
    return highlight_counts(table, _chart(table), rows, compile_expression(table, rule("value", "gt", 5)))


@register("highlight_scatter", f"WITH d AS (SELECT min(value) AS x0, max(value) AS x1, min(k) AS y0, max(k) AS y1 FROM {POINTS} p) SELECT row_id AS row FROM {POINTS} p, d "
                               "WHERE (((value - x0) / (x1 - x0) * 2 - 1) + 1) / 2 BETWEEN 0.1::DOUBLE AND 0.2::DOUBLE AND (((k - y0) / (y1 - y0) * 2 - 1) + 1) / 2 BETWEEN 0.5::DOUBLE AND 0.9::DOUBLE")
def highlighted_scatter(spark, folder):
    return highlight_scatter(scatter_raw(points(spark, folder), "value", "k"), (0.1, 0.2), (0.5, 0.9))


@register("inspect_matches", f"SELECT 'events' AS source_id, row_id AS row FROM {POINTS} p WHERE value > 50 UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def matches(spark, folder):
    return inspect_matches({"events": (points(spark, folder), rule("value", "gt", 50)),
                            "customers": (customer(spark, folder), rule("c_mktsegment", "eq", "MACHINERY"))})


@register("intersect_rows", f"SELECT row_id FROM {POINTS} p WHERE category = 'purchase' AND active")
def intersected(spark, folder):
    table = points(spark, folder)
    rows = table.df.where("category = 'purchase'").select(F.col("row_id").alias("row"))
    return intersect_rows(table, rows, compile_expression(table, rule("active", "eq", True))).select("row_id")


# --- map ------------------------------------------------------------------

MX = "((lon + 180) / 360)"
MY = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - ln(tan(pi() / 4 + greatest(-85.05112878::DOUBLE, least(85.05112878::DOUBLE, lat)) * pi() / 360)) / pi()) / 2))"
PLACED = f"(SELECT *, {MX} AS x, {MY} AS y FROM {POINTS} p)"


@register("mercator_xy", f"SELECT row_id, round(x, 9) AS x, round(y, 9) AS y FROM {PLACED} m")
def mercator(spark, folder):
    return points(spark, folder).df.select("row_id", F.round(geo.mercator_x(F.col("lon")), 9).alias("x"), F.round(geo.mercator_y(F.col("lat")), 9).alias("y"))


@register("haversine", "WITH h AS (SELECT row_id, 2 * 6371008.8::DOUBLE * asin(sqrt(greatest(0.0::DOUBLE, least(1.0::DOUBLE, pow(sin(radians(53.99::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(53.99::DOUBLE)) "
                       f"* pow(sin(radians(-1.55::DOUBLE - lon) / 2), 2))))) AS m FROM {POINTS} p) SELECT row_id, round(m, 3) AS metres, round(m / 0.3048::DOUBLE, 3) AS feet, round(m / 1852, 3) AS nautical_miles FROM h")
def distances(spark, folder):
    """Distance of every point from one place, in three units."""
    m = geo.haversine(F.col("lon"), F.col("lat"), F.lit(-1.55), F.lit(53.99))
    return points(spark, folder).df.select("row_id", F.round(m, 3).alias("metres"), F.round(geo.to_feet(m), 3).alias("feet"),
                                           F.round(geo.to_nautical_miles(m), 3).alias("nautical_miles"))


@register("format_coordinate", f"SELECT row_id, printf('Lat %.5f°  Lon %.5f°', lat, lon) AS shown FROM {POINTS} p")
def shown_coordinates(spark, folder):
    return points(spark, folder).df.select("row_id", geo.format_coordinate(F.col("lon"), F.col("lat")).alias("shown"))


GRID = ("e AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m), g AS (SELECT m.*, least(31, floor((y - y0) / (y1 - y0) * 32))::BIGINT * 32 + "
        "least(31, floor((x - x0) / (x1 - x0) * 32))::BIGINT AS grid_cell FROM m, e)")


@register("grid_groups", f"WITH m AS {PLACED}, {GRID} SELECT grid_cell, count(*) AS count, round(min(x), 9) AS x0, round(min(y), 9) AS y0, round(max(x), 9) AS x1, round(max(y), 9) AS y1 FROM g GROUP BY grid_cell")
def groups(spark, folder):
    g = grid_groups(points(spark, folder))
    return g.select("grid_cell", "count", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register("grid_groups_by_page", f"WITH m AS {PLACED}, e AS (SELECT category AS c, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY 1), "
                                 "g AS (SELECT m.*, least(31, floor((y - y0) / (y1 - y0) * 32))::BIGINT * 32 + least(31, floor((x - x0) / (x1 - x0) * 32))::BIGINT AS grid_cell FROM m JOIN e ON e.c = m.category) "
                                 "SELECT category, grid_cell, count(*) AS count FROM g GROUP BY 1, 2")
def groups_by_page(spark, folder):
    return grid_groups(points(spark, folder), ["category"]).select("category", "grid_cell", "count")


@register("grid_cells", f"WITH m AS {PLACED}, {GRID} SELECT row_id, grid_cell FROM g")
def cells(spark, folder):
    return with_grid_cell(points(spark, folder)).select("row_id", "grid_cell")


@register("pick_rectangle", f"SELECT row_id AS row FROM {PLACED} m WHERE x BETWEEN 0.4 AND 0.6 AND y BETWEEN 0.2 AND 0.5 AND {NESTED_SQL}")
def rectangle(spark, folder):
    table = points(spark, folder)
    return pick_rectangle(table, 0.4, 0.2, 0.6, 0.5, compile_expression(table, NESTED))


@register("pick_radius", f"SELECT row_id AS row FROM {PLACED} m WHERE sqrt(pow((x - 0.5) * 2048.0::DOUBLE, 2) + pow((y - 0.5) * 2048.0::DOUBLE, 2)) <= 18")
def circle(spark, folder):
    """Everything drawn within reach of the map centre at zoom 2."""
    return pick_radius(points(spark, folder), 0.5, 0.5, 2, point_size=30)


@register("viewport_rows", f"WITH m AS {PLACED}, {GRID}, q AS (SELECT grid_cell, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM g GROUP BY 1) "
                           "SELECT row_id AS row, grid_cell FROM g WHERE grid_cell IN (SELECT grid_cell FROM q WHERE a <= 0.4 AND c >= 0.3 AND b <= 0.5 AND d >= 0.25)")
def viewport(spark, folder):
    return viewport_rows(points(spark, folder), 0.3, 0.25, 0.4, 0.5)


# --- ellipses -------------------------------------------------------------

ELLIPSE = EllipseConfig("reading", "k", "value", major_unit="nm")
ELLIPSES = (f"(SELECT row_id, lon, lat, reading * 1852 AS a, k AS b, value AS t FROM {POINTS} p)")
VALID = "(a > 0 AND b > 0 AND a <= pi() * 6371008.8::DOUBLE AND b <= pi() * 6371008.8::DOUBLE AND t IS NOT NULL)"


@register("ellipse_params", f"SELECT row_id AS row, CASE WHEN {VALID} THEN greatest(a, b) END AS major_m, CASE WHEN {VALID} THEN least(a, b) END AS minor_m, "
                            f"round(CASE WHEN {VALID} THEN (CASE WHEN b > a THEN t + 90 ELSE t END) % 360 END, 9) AS angle, coalesce({VALID}, FALSE) AS valid FROM {ELLIPSES} e")
def ellipses(spark, folder):
    params = ellipse_params(points(spark, folder), ELLIPSE)
    return params.select("row", "major_m", "minor_m", F.round("angle", 9).alias("angle"), "valid")


@register("ellipse_invalid", f"SELECT count(*) FILTER (NOT coalesce({VALID}, FALSE)) AS invalid FROM {ELLIPSES} e")
def invalid(spark, folder):
    return invalid_ellipses(ellipse_params(points(spark, folder), ELLIPSE))


# Vertices are equal steps of a running sum over 4,096 pieces of the circle, for 64 shapes.
_CLAMPED = "greatest(-85.05112878::DOUBLE, least(85.05112878::DOUBLE, {v}))"
OUTLINE_SQL = f"""
    WITH shapes AS (SELECT k, pow(2::DOUBLE, k * 10::DOUBLE / 63) AS r FROM range(64) t(k)),
    pieces AS (SELECT k, i, 1 / sqrt(sqrt(pow(r * sin((i + 0.5::DOUBLE) * 2 * pi() / 4096), 2) + pow(cos((i + 0.5::DOUBLE) * 2 * pi() / 4096), 2))) AS d
               FROM shapes, range(4096) t(i)),
    sums AS (SELECT k, i, d, sum(d) OVER (PARTITION BY k ORDER BY i) AS c, sum(d) OVER (PARTITION BY k) AS total FROM pieces),
    angles AS (SELECT k, v, (i + (total * v / 16 - (c - d)) / d) * 2 * pi() / 4096 AS w
               FROM sums, range(16) t(v) WHERE total * v / 16 >= c - d AND total * v / 16 < c
               QUALIFY row_number() OVER (PARTITION BY k, v ORDER BY i) = 1),
    placed AS (SELECT row_id AS row, lon, radians({_CLAMPED.format(v="lat")}) AS phi, radians((CASE WHEN b > a THEN t + 90 ELSE t END) % 360) AS turn,
                      greatest(a, b) / 6371008.8::DOUBLE AS major, least(a, b) / 6371008.8::DOUBLE AS minor,
                      round(least(10::DOUBLE, log2(greatest(a, b) / least(a, b))) * 63 / 10)::INT AS k FROM {ELLIPSES} e WHERE {VALID}),
    moved AS (SELECT row, v AS vertex, lon, phi, major * cos(w) * sin(turn) + minor * sin(w) * cos(turn) AS east,
                     major * cos(w) * cos(turn) - minor * sin(w) * sin(turn) AS north FROM placed JOIN angles USING (k)),
    reached AS (SELECT *, sqrt(east * east + north * north) AS reach FROM moved),
    shares AS (SELECT *, CASE WHEN reach < 1e-8 THEN 1::DOUBLE ELSE sin(reach) / reach END AS s FROM reached),
    ends AS (SELECT row, vertex, (lon + 180) / 360 + atan2(east * s, cos(phi) * cos(reach) - sin(phi) * north * s) / (2 * pi()) AS x,
                    degrees(asin(greatest(-1::DOUBLE, least(1::DOUBLE, sin(phi) * cos(reach) + cos(phi) * north * s)))) AS lat FROM shares)
    SELECT row, vertex::INT AS vertex, round(x, 9) AS x,
           round(greatest(0::DOUBLE, least(1::DOUBLE, (1 - ln(tan(pi() / 4 + {_CLAMPED.format(v="lat")} * pi() / 360)) / pi()) / 2)), 9) AS y FROM ends"""


@register("ellipse_outlines", OUTLINE_SQL)
def outlines(spark, folder):
    """Outlines of 16 vertices."""
    rings = ellipse_outlines(points(spark, folder), ELLIPSE, 16)
    return rings.select("row", "vertex", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


_H1 = "xor(b, b >> 16)"
_H2 = f"((({_H1})::HUGEINT * 2146121005) % 4294967296)::BIGINT"
STRIDE_SQL = (f"WITH o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS n, count(*) OVER () - 1 AS last FROM {POINTS} p), "
              f"h AS (SELECT *, n // 7 AS b FROM o), j AS (SELECT *, {_H2} AS u FROM h) SELECT row_id FROM j WHERE n = least(b * 7 + xor(u, u >> 15) % 7, last)")


@register("stride_sample", STRIDE_SQL)
def strided(spark, folder):
    return stride_sample(points(spark, folder), 7).select("row_id")


# --- scalar functions -----------------------------------------------------

@register("utc_iso", f"SELECT row_id, {iso('ts')} AS iso FROM {POINTS} p")
def iso_text(spark, folder):
    return points(spark, folder).df.select("row_id", values.utc_iso(F.col("ts")).alias("iso"))


@register("format_utc", "SELECT o_orderkey AS row_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown FROM orders")
def shown_times(spark, folder):
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), values.format_utc(F.col("o_orderdate").cast("timestamp")).alias("shown"))


_FORMS = 8  # ways the same moment is written, some of them wrong


@register("parse_utc", f"SELECT row_id, CASE row_id % {_FORMS} WHEN 0 THEN date_trunc('milliseconds', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts) "
                       "WHEN 3 THEN date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE WHEN 4 THEN date_trunc('day', ts) + INTERVAL 2 HOUR "
                       f"WHEN 5 THEN date_trunc('minute', ts) END AS stamp FROM {POINTS} p")
def parsed(spark, folder):
    """Times written in six accepted forms and two refused ones, read back."""
    df = points(spark, folder).df
    f = lambda pattern: F.date_format("ts", pattern)
    text = F.element_at(F.array(
        f("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), f("'  'yyyy-MM-dd"), f("yyyy-MM-dd HH:mm"), f("yyyy-MM-dd't'HH:mm:ss'+05:30'"), f("yyyy-MM-dd'-0200'"),
        f("yyyy-MM-dd'T'HH:mm'z'"), f("yyyy-MM-dd'T24:'mm:ss"), f("yyyy-'02-30'")), (F.col("row_id") % _FORMS + 1).cast("int"))
    return df.select("row_id", values.parse_utc(text).alias("stamp"))


@register("to_number", f"SELECT row_id, CASE row_id % 6 WHEN 0 THEN value WHEN 1 THEN -value WHEN 2 THEN value * 1000 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE NULL END AS number, "
                       f"CASE row_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, row_id % 4 < 2 AS blank FROM {POINTS} p")
def numbers(spark, folder):
    """Decimals, signs and exponents are numbers; hexadecimal, infinity and suffixes are not."""
    v = F.col("value").cast("string")
    text = F.element_at(F.array(F.concat(F.lit(" +"), v, F.lit("\t")), F.concat(F.lit("-"), v), F.concat(v, F.lit("E+3")), F.lit("0x1F"), F.lit("Infinity"),
                                F.concat(v, F.lit("d"))), (F.col("row_id") % 6 + 1).cast("int"))
    flag = F.element_at(F.array(F.lit(" TRUE"), F.lit("False"), F.lit("1")), (F.col("row_id") % 3 + 1).cast("int"))
    gap = F.element_at(F.array(F.lit("   "), F.lit(""), F.lit(" x "), F.lit("0")), (F.col("row_id") % 4 + 1).cast("int"))
    return points(spark, folder).df.select("row_id", values.to_number(text).alias("number"), values.to_boolean(flag).alias("flag"), values.is_blank(gap).alias("blank"))


@register("log10_scale", "SELECT c_custkey AS row_id, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 9) AS log, round(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 4) AS back FROM customer")
def logs(spark, folder):
    log = scales.log10_scale(F.col("c_acctbal"))
    return read(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), F.round(log, 9).alias("log"), F.round(scales.unlog10(log), 4).alias("back"))


@register("normalize_axis", "WITH d AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey AS row_id, round((c_acctbal - lo) / (hi - lo) * 2 - 1, 9) AS position FROM customer, d")
def normalized(spark, folder):
    table = customer(spark, folder)
    axis = axis_for(table, "c_acctbal")
    return table.df.select("row_id", F.round(scales.normalize_axis(F.col("c_acctbal"), axis.edges[0], axis.edges[-1]), 9).alias("position"))


@register("dense_position", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer")
def positions(spark, folder):
    """Dense numbering of a global order without one task seeing all rows."""
    return with_position(read(spark, folder, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "position")
