"""Filters, windows and bin predicates over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.axes import axis_for, cell_predicate, range_predicate, segments_predicate
from ..operators.expressions import (and_, applied, applied_scope, as_flag, bbox, clear_filters, compile_expression,
                                     load_rules, or_, row, rule)
from ..sources.bounds import LoadBounds, bound_box, bound_time
from .tables import LINEITEM, POINTS, edges_sql, labels_sql, lineitem, points, register

SHOWN = ("row_id", "category", "value")
DAY = "2024-01-10T00:00:00Z"


def _rows(spark: SparkSession, folder: str, expression: dict) -> DataFrame:
    table = points(spark, folder)
    return table.df.where(compile_expression(table, expression)).select(*SHOWN)


def _filter(name: str, expression: dict, where: str) -> None:
    register(name, f"SELECT row_id, category, value FROM {POINTS} p WHERE {where}")(
        lambda spark, folder: _rows(spark, folder, expression))


NESTED = and_(or_(rule("category", "eq", "error"), rule("category", "eq", "signup")), rule("value", "gte", 20),
              rule("ts", "gte", DAY))
NESTED_SQL = "(category = 'error' OR category = 'signup') AND value >= 20 AND ts >= TIMESTAMP '2024-01-10'"

_filter("filter_nested", NESTED, NESTED_SQL)
_filter("filter_deep", or_(and_(rule("k", "lt", 10), or_(rule("active", "eq", True), rule("user", "null"))),
                           and_(rule("k", "gte", 95), rule("category", "ne", "view"))),
        '(k < 10 AND (active OR "user" IS NULL)) OR (k >= 95 AND category <> \'view\')')
_filter("filter_number_eq", rule("k", "eq", 42), "k = 42")
_filter("filter_number_ne", rule("reading", "ne", 6.55), "reading <> 6.55")
_filter("filter_number_gt", rule("value", "gt", 12.31), "value > 12.31")
_filter("filter_number_gte", rule("value", "gte", 12.31), "value >= 12.31")
_filter("filter_number_lt", rule("value", "lt", 12.31), "value < 12.31")
_filter("filter_number_lte", rule("value", "lte", 12.31), "value <= 12.31")
_filter("filter_text_order", and_(rule("category", "gt", "click"), rule("category", "lte", "signup")),
        "category > 'click' AND category <= 'signup'")
_filter("filter_text_lt_gte", or_(rule("user", "lt", "user-2"), rule("user", "gte", "user-9")), "\"user\" < 'user-2' OR \"user\" >= 'user-9'")
_filter("filter_boolean", and_(rule("active", "eq", "1"), rule("active", "ne", "false")), "active")
_filter("filter_date_lt", rule("ts", "lt", "2024-01-05T12:30:00.250+02:00"), "ts < TIMESTAMP '2024-01-05 10:30:00.250'")
_filter("filter_date_lte", rule("ts", "lte", "2024-01-20"), "date_trunc('milliseconds', ts) <= TIMESTAMP '2024-01-20'")
_filter("filter_date_gt", rule("ts", "gt", "2024-01-20 06:00"), "date_trunc('milliseconds', ts) > TIMESTAMP '2024-01-20 06:00:00'")
_filter("filter_date_ne", and_(rule("ts", "ne", "2024-01-01T00:00:07.179Z"), rule("category", "eq", "error")),
        "date_trunc('milliseconds', ts) <> TIMESTAMP '2024-01-01 00:00:07.179' AND category = 'error'")
_filter("filter_date_eq", rule("ts", "eq", "2024-01-01T00:00:07.179Z"), "date_trunc('milliseconds', ts) = TIMESTAMP '2024-01-01 00:00:07.179'")
_filter("filter_contains", rule("user", "contains", "-1"), "contains(\"user\", '-1')")
_filter("filter_null", rule("reading", "null"), "reading IS NULL")
_filter("filter_notnull", rule("user", "notnull"), '"user" IS NOT NULL')
_filter("filter_in", rule("category", "in", values=["error", "purchase"]), "category IN ('error', 'purchase')")
_filter("filter_notin", rule("user", "notin", values=["user-1", "user-2", "user-3"]), "\"user\" NOT IN ('user-1', 'user-2', 'user-3')")
_filter("filter_bbox", bbox(-20.5, -10, 35.25, 45), "lon BETWEEN -20.5 AND 35.25 AND lat BETWEEN -10 AND 45")
_filter("filter_bbox_antimeridian", bbox(170, -60, -165, 60), "(lon >= 170 OR lon <= -165) AND lat BETWEEN -60 AND 60")
_filter("filter_row", row(137), "row_id = 137")
_filter("filter_empty_or", or_(), "FALSE")
_filter("clear_filters", clear_filters(), "TRUE")


@register("filter_flag", f"SELECT row_id, coalesce(reading > 30, FALSE) AS flag FROM {POINTS} p")
def filter_flag(spark, folder):
    table = points(spark, folder)
    return table.df.select("row_id", as_flag(compile_expression(table, rule("reading", "gt", 30))).alias("flag"))


@register("timeline_window", f"SELECT row_id FROM {POINTS} p WHERE ts >= TIMESTAMP '2024-01-05' "
                             "AND date_trunc('milliseconds', ts) <= TIMESTAMP '2024-01-07 23:59:59.999'")
def timeline_window(spark, folder):
    table = points(spark, folder)
    return table.df.where(applied(table, window=(1704412800000, 1704671999999))).select("row_id")


@register("timeline_window_text", f"SELECT row_id FROM {POINTS} p WHERE row_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-05' "
                                  "AND date_trunc('milliseconds', ts) <= TIMESTAMP '2024-01-06'")
def timeline_window_text(spark, folder):
    """A text attribute read as time; rows whose text is no time drop out."""
    table = points(spark, folder)
    text = F.when(F.col("row_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.lit("not a time"))
    table = table.with_df(table.df.withColumn("user", text))
    return table.df.where(applied(table, window=(1704412800000, 1704499200000), time_field="user")).select("row_id")


@register("shared_box", f"SELECT row_id, category, value FROM {POINTS} p WHERE (category = 'view' OR value < 3) AND lon BETWEEN 0 AND 90 "
                        "AND lat BETWEEN 0 AND 45")
def shared_box(spark, folder):
    table = points(spark, folder)
    expression = or_(rule("category", "eq", "view"), rule("value", "lt", 3))
    return table.df.where(applied(table, expression, box=bbox(0, 0, 90, 45))).select(*SHOWN)


LOAD_RULES = [{"field": "value", "kind": "number", "op": "gte", "value": "10"}, {"field": "category", "kind": "string", "op": "contains", "value": "i"},
              {"field": "ts", "kind": "date", "op": "lt", "value": "2024-01-25T00:00:00Z"}, {"field": "user", "kind": "string", "op": "notnull"}]


@register("load_rules", f"SELECT row_id, category, value FROM {POINTS} p WHERE value >= 10 AND contains(category, 'i') "
                        "AND ts < TIMESTAMP '2024-01-25' AND \"user\" IS NOT NULL")
def load_rules_query(spark, folder):
    table = points(spark, folder)
    return table.df.where(load_rules(LOAD_RULES, table.fields)).select(*SHOWN)


@register("applied_scope", f"SELECT 'loaded' AS scope, count(*) AS n FROM {POINTS} p UNION ALL SELECT 'applied', count(*) FROM {POINTS} p WHERE {NESTED_SQL}")
def applied_scope_query(spark, folder):
    table = points(spark, folder)
    predicate = compile_expression(table, NESTED)
    parts = [applied_scope(table, s, predicate).df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("scope"), "n")
             for s in ("loaded", "applied")]
    return reduce(DataFrame.unionByName, parts)


@register("bound_time", f"SELECT row_id FROM {POINTS} p WHERE ts >= TIMESTAMP '2024-01-03' AND date_trunc('milliseconds', ts) <= TIMESTAMP '2024-01-04 12:00:00'")
def bound_time_query(spark, folder):
    table = points(spark, folder)
    return table.df.where(bound_time(F.col("ts"), LoadBounds(time=("2024-01-03", "2024-01-04T12:00Z")))).select("row_id")


@register("bound_box", f"SELECT row_id FROM {POINTS} p WHERE lon >= -30 AND lon <= 10.5 AND lat >= -5 AND lat <= 60")
def bound_box_query(spark, folder):
    table = points(spark, folder)
    return table.df.where(bound_box(F.col("lon"), F.col("lat"), LoadBounds(box=(-30, -5, 10.5, 60)))).select("row_id")


# --- bins as filters ------------------------------------------------------

def _counted(table, named: list[tuple[int, dict]]) -> DataFrame:
    """Rows that each of several filters selects, in one scan."""
    tests = [F.count_if(compile_expression(table, e)).alias(str(i)) for i, e in named]
    pairs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("bin"), F.col(f"`{i}`").alias("count")) for i, _ in named])
    return table.df.agg(*tests).select(F.inline(pairs))


def _bins_of(source: str, value: str, bins: int, kind: str = "number", scale: str = "linear") -> str:
    return (f"SELECT b.i AS bin, (SELECT count(*) FROM {source} p WHERE {value} >= b.lo AND ({value} < b.hi OR (b.last AND {value} <= b.hi))) AS count "
            f"FROM {edges_sql(source, value, bins, kind, scale)} b")


@register("bin_predicate_number", _bins_of(POINTS, "reading", 24))
def bin_predicate_number(spark, folder):
    table = points(spark, folder)
    axis = axis_for(table, "reading", 24)
    return _counted(table, [(i, axis.predicate(i)) for i in range(axis.size)])


@register("bin_predicate_date", _bins_of(POINTS, "(epoch_us(ts) // 1000)", 30, "date"))
def bin_predicate_date(spark, folder):
    table = points(spark, folder)
    axis = axis_for(table, "ts", 30)
    return _counted(table, [(i, axis.predicate(i)) for i in range(axis.size)])


@register("bin_predicate_log10", _bins_of(POINTS, "reading", 12, scale="log10"))
def bin_predicate_log10(spark, folder):
    table = points(spark, folder)
    axis = axis_for(table, "reading", 12, "log10")
    return _counted(table, [(i, axis.predicate(i)) for i in range(axis.size)])


@register("bin_predicate_category", f"WITH b AS {labels_sql(POINTS, chr(34) + 'user' + chr(34))}, k AS (SELECT count(*) AS n FROM b) "
                                    f"SELECT b.i AS bin, count(*) AS count FROM {POINTS} p JOIN b ON b.label = p.\"user\" GROUP BY 1 UNION ALL "
                                    f"SELECT (SELECT n FROM k), count(*) FROM {POINTS} p WHERE \"user\" NOT IN (SELECT label FROM b) HAVING count(*) > 0")
def bin_predicate_category(spark, folder):
    """Labels are equality tests; the catch-all bin is everything else that is filled."""
    table = points(spark, folder)
    axis = axis_for(table, "user")
    return _counted(table, [(i, axis.predicate(i)) for i in range(axis.size)])


@register("interval_predicate", f"WITH b AS {edges_sql(POINTS, 'value', 20)} SELECT row_id FROM {POINTS} p "
                                "WHERE value >= (SELECT lo FROM b WHERE i = 3) AND value < (SELECT hi FROM b WHERE i = 7)")
def interval_predicate(spark, folder):
    table = points(spark, folder)
    axis = axis_for(table, "value", 20)
    return table.df.where(compile_expression(table, axis.interval(3, 7))).select("row_id")


@register("cell_predicate", f"WITH x AS {edges_sql(LINEITEM, 'l_quantity', 10)}, y AS {edges_sql(LINEITEM, 'l_extendedprice', 10)} "
                            f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM {LINEITEM} p "
                            "WHERE l_quantity >= (SELECT lo FROM x WHERE i = 2) AND l_quantity < (SELECT hi FROM x WHERE i = 5) "
                            "AND l_extendedprice >= (SELECT lo FROM y WHERE i = 1) AND l_extendedprice < (SELECT hi FROM y WHERE i = 3)")
def cell_predicate_query(spark, folder):
    table = lineitem(spark, folder)
    x, y = axis_for(table, "l_quantity", 10), axis_for(table, "l_extendedprice", 10)
    test = compile_expression(table, cell_predicate(x, y, (5, 1), (2, 3)))
    return table.df.where(test).select("l_orderkey", "l_linenumber", "l_partkey")


@register("segments_predicate", f"WITH b AS {edges_sql(POINTS, 'k', 10)} SELECT row_id FROM {POINTS} p JOIN b ON k >= b.lo AND (k < b.hi OR (b.last AND k <= b.hi)) "
                                "WHERE b.i IN (0, 1, 4, 8, 9)")
def segments_predicate_query(spark, folder):
    table = points(spark, folder)
    axis = axis_for(table, "k", 10)
    return table.df.where(compile_expression(table, segments_predicate(axis, [9, 0, 1, 4, 8]))).select("row_id")


@register("range_predicate", f"WITH d AS (SELECT min(value) AS lo, max(value) AS hi FROM {POINTS} p), t AS (SELECT min((epoch_us(ts) // 1000)) AS lo, max((epoch_us(ts) // 1000)) AS hi FROM {POINTS} p) "
                             f"SELECT row_id FROM {POINTS} p, d, t WHERE value >= d.lo * (1 - 0.25::DOUBLE) + d.hi * 0.25::DOUBLE AND value <= d.lo * (1 - 0.5::DOUBLE) + d.hi * 0.5::DOUBLE "
                             "AND (epoch_us(ts) // 1000) >= ceil(t.lo * (1 - 0.125::DOUBLE) + t.hi * 0.125::DOUBLE) AND (epoch_us(ts) // 1000) <= floor(t.lo * (1 - 0.75::DOUBLE) + t.hi * 0.75::DOUBLE)")
def range_predicate_query(spark, folder):
    """A rectangle brushed on an unbinned scatter of value over time."""
    table = points(spark, folder)
    x, y = axis_for(table, "value"), axis_for(table, "ts")
    ends = lambda a: (a.edges[0], a.edges[-1])
    test = and_(range_predicate(x, ends(x), 0.25, 0.5), range_predicate(y, ends(y), 0.125, 0.75))
    return table.df.where(compile_expression(table, test)).select("row_id")


