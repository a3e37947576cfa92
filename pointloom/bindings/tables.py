"""The given tables as point tables, and the same definitions as SQL text.

The tables carry no coordinates, so positions come from one integer formula that is
written twice, once for Spark and once for SQL. It crosses the antimeridian and the
latitude limit of the map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import configure
from ..table import PointTable, describe, quote

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query and the SQL that must give the same rows."""
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} exists already")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(query(configure(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: 64-bit whole numbers, doubles, and timestamps without a zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def place(key: Column) -> tuple[Column, Column]:
    lon = ((key * 7919) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)
    lat = ((key * 104729) % 17800).cast("double") / F.lit(100.0) - F.lit(89.0)
    return lon, lat


def place_sql(key: str) -> str:
    return (f"CAST((({key}) * 7919) % 36000 AS DOUBLE) / 100.0::DOUBLE - 180 AS lon, "
            f"CAST((({key}) * 104729) % 17800 AS DOUBLE) / 100.0::DOUBLE - 89 AS lat")


def points(spark: SparkSession, folder: str) -> PointTable:
    """Events as observations; ``reading`` has gaps, ``value`` has none."""
    e = read(spark, folder, "events")
    lon, lat = place(F.col("event_id"))
    df = e.select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("events."), F.col("event_id").cast("string")).alias("point_id"),
        lon.alias("lon"), lat.alias("lat"), F.col("event_type").alias("category"), "value",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("reading"), F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("user_id") % 3 == 0).alias("active"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("user"))
    return describe(df, row="row_id", id="point_id", lon="lon", lat="lat", name="events", time_field="ts")


POINTS = (f"(SELECT event_id AS row_id, 'events.' || event_id AS point_id, {place_sql('event_id')}, event_type AS category, value, "
          "CASE WHEN event_id % 17 <> 0 THEN value END AS reading, ts, "
          "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS DOUBLE) AS k, user_id % 3 = 0 AS active, "
          "CASE WHEN user_id % 11 <> 0 THEN 'user-' || user_id END AS \"user\" FROM events)")


def keyed(spark: SparkSession, folder: str, name: str, key: str | Column, *, label: str | None = None,
          time_field: str = "") -> PointTable:
    """Any given table as points: its key becomes row id, point id and position."""
    df = read(spark, folder, name)
    key = F.col(key) if isinstance(key, str) else key
    lon, lat = place(key)
    attributes = df.columns
    shaped = df.select(key.alias("row_id"), key.cast("string").alias("point_id"), lon.alias("lon"), lat.alias("lat"),
                       *[F.col(f.name).cast("timestamp") if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
                         for f in df.schema.fields])
    return describe(shaped, row="row_id", id="point_id", lon="lon", lat="lat", attributes=attributes,
                    name=label or name, time_field=time_field)


def keyed_sql(name: str, key: str) -> str:
    return f"(SELECT {key} AS row_id, CAST({key} AS VARCHAR) AS point_id, {place_sql(key)}, * FROM {name})"


LINE_KEY = "l_orderkey * 8 + l_linenumber"


def lineitem(spark: SparkSession, folder: str) -> PointTable:
    return keyed(spark, folder, "lineitem", F.col("l_orderkey") * 8 + F.col("l_linenumber"), time_field="l_shipdate")


LINEITEM = keyed_sql("lineitem", LINE_KEY)


# --- SQL for bins ---------------------------------------------------------

def edges_sql(source: str, value: str, bins: int, kind: str = "number", scale: str = "linear", where: str = "") -> str:
    """Bins ``i, lo, hi, last`` over the full source; one bin for a constant."""
    positive = f"WHERE {value} > 0" if scale == "log10" else ""
    inner = "lo + ((hi - lo) / n) * i"
    if scale == "log10":
        inner = "pow(10.0::DOUBLE, log10(lo) * (1 - i::DOUBLE / n) + log10(hi) * (i::DOUBLE / n))"
    if kind == "date":
        inner = f"ceil({inner})"
    return (f"(WITH d AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source} {positive}), "
            f"m AS (SELECT lo, hi, CASE WHEN lo = hi THEN 1 ELSE {bins} END AS n FROM d WHERE lo IS NOT NULL), "
            f"e AS (SELECT i, n, CASE WHEN i = 0 THEN lo WHEN i = n THEN hi ELSE {inner} END AS edge "
            f"FROM m, range(0, {bins} + 1) r(i) WHERE i <= n) "
            f"SELECT a.i, a.edge AS lo, b.edge AS hi, b.i = b.n AS last, a.n FROM e a JOIN e b ON b.i = a.i + 1)")


def labels_sql(source: str, value: str, top: int = 23) -> str:
    """Bins ``i, label`` of the most frequent values, ties by first row."""
    return (f"(SELECT row_number() OVER (ORDER BY c DESC, f) - 1 AS i, v AS label FROM (SELECT {value} AS v, count(*) AS c, "
            f"min(row_id) AS f FROM {source} WHERE {value} IS NOT NULL GROUP BY 1) ORDER BY c DESC, f LIMIT {top})")


def inside(value: str, b: str = "b") -> str:
    return f"({value} >= {b}.lo AND ({value} < {b}.hi OR ({b}.last AND {value} <= {b}.hi)))"


def histogram_sql(chart: str, source: str, value: str, bins: int, kind: str = "number", scale: str = "linear",
                  where: str = "TRUE", measure: str | None = None, aggregate: str = "count", digits: int = 4) -> str:
    """All bins of one chart and its missing row, counted with the bin's own range test."""
    have = f"AND {measure} IS NOT NULL" if measure else ""
    agg = {"count": "NULL::DOUBLE", "sum": f"round(sum({measure}), {digits})", "mean": f"round(avg({measure}), {digits})",
           "min": f"min({measure})", "max": f"max({measure})"}[aggregate]
    return (f"WITH bins AS {edges_sql(source, value, bins, kind, scale)}, s AS (SELECT * FROM {source} WHERE {where}), "
            f"c AS (SELECT b.i, count(*) AS n, {agg} AS v FROM s JOIN bins b ON {inside(value)} {have} GROUP BY b.i) "
            f"SELECT '{chart}' AS chart_id, b.i AS cell, b.i AS x_bin, 0::BIGINT AS y_bin, coalesce(c.n, 0) AS count, c.v AS value "
            f"FROM bins b LEFT JOIN c ON c.i = b.i UNION ALL "
            f"SELECT '{chart}', -1, NULL, NULL, (SELECT count(*) FROM s) - coalesce((SELECT sum(n) FROM c), 0)::BIGINT, NULL")


def categories_sql(chart: str, source: str, value: str, where: str = "TRUE") -> str:
    """Top labels, the catch-all bin when there are more values, and the missing row."""
    return (f"WITH bins AS {labels_sql(source, value)}, s AS (SELECT * FROM {source} WHERE {where}), "
            f"k AS (SELECT count(*) AS n, (SELECT count(DISTINCT {value}) FROM {source}) AS d FROM bins), "
            f"g AS (SELECT i FROM bins UNION ALL SELECT n FROM k WHERE d > n), "
            f"c AS (SELECT coalesce(b.i, (SELECT n FROM k)) AS i, count(*) AS n FROM s LEFT JOIN bins b ON b.label = {value} "
            f"WHERE {value} IS NOT NULL GROUP BY 1) "
            f"SELECT '{chart}' AS chart_id, g.i AS cell, g.i AS x_bin, 0::BIGINT AS y_bin, coalesce(c.n, 0) AS count, NULL::DOUBLE AS value "
            f"FROM g LEFT JOIN c ON c.i = g.i UNION ALL "
            f"SELECT '{chart}', -1, NULL, NULL, (SELECT count(*) FROM s WHERE {value} IS NULL), NULL")


def scatter_sql(chart: str, source: str, x: str, y: str, bins: int, where: str = "TRUE", kinds: tuple[str, str] = ("number", "number")) -> str:
    """Two-dimensional cells and the missing row."""
    return (f"WITH bx AS {edges_sql(source, x, bins, kinds[0])}, bt AS {edges_sql(source, y, bins, kinds[1])}, "
            f"s AS (SELECT * FROM {source} WHERE {where}), "
            f"c AS (SELECT bx.i AS xi, bt.i AS yi, count(*) AS n FROM s JOIN bx ON {inside(x, 'bx')} JOIN bt ON {inside(y, 'bt')} GROUP BY 1, 2) "
            f"SELECT '{chart}' AS chart_id, bt.i * bx.n + bx.i AS cell, bx.i AS x_bin, bt.i AS y_bin, coalesce(c.n, 0) AS count, NULL::DOUBLE AS value "
            f"FROM bx CROSS JOIN bt LEFT JOIN c ON c.xi = bx.i AND c.yi = bt.i UNION ALL "
            f"SELECT '{chart}', -1, NULL, NULL, (SELECT count(*) FROM s) - coalesce((SELECT sum(n) FROM c), 0)::BIGINT, NULL")
