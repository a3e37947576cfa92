"""Domains, charts and comparisons over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.axes import axis_for, axis_table, chart_domain, profile_categories, profile_numeric, shared_domain
from ..operators.charts import (ChartSpec, fit_extent, hist_bar, log_y_omit, missing_count, pie_shares, run_charts, scatter_binned,
                                scatter_raw, selected_count, time_series)
from ..operators.expressions import compile_expression, rule
from ..operators.highlights import union_labels
from ..operators.series import Series, combine_raw, combine_series, union_series
from ..operators.timeline import timeline_extent, union_extents
from .filters import NESTED, NESTED_SQL
from .tables import (LINEITEM, POINTS, categories_sql, edges_sql, histogram_sql, inside, keyed, keyed_sql, labels_sql, lineitem, points,
                     register, scatter_sql)

PART, ORDERS = keyed_sql("part", "p_partkey"), keyed_sql("orders", "o_orderkey")
CUSTOMER, SUPPLIER = keyed_sql("customer", "c_custkey"), keyed_sql("supplier", "s_suppkey")


def orders(spark, folder):
    return keyed(spark, folder, "orders", "o_orderkey", time_field="o_orderdate")


def customer(spark, folder):
    return keyed(spark, folder, "customer", "c_custkey")


def supplier(spark, folder):
    return keyed(spark, folder, "supplier", "s_suppkey")


def part(spark, folder):
    return keyed(spark, folder, "part", "p_partkey")


# --- domains --------------------------------------------------------------

def _profile(value: str, field: str, kind: str) -> str:
    return (f"SELECT '{field}' AS field, '{kind}' AS kind, min({value})::DOUBLE AS min, max({value})::DOUBLE AS max, "
            f"min({value}) FILTER ({value} > 0)::DOUBLE AS min_positive, max({value}) FILTER ({value} > 0)::DOUBLE AS max_positive FROM {POINTS} p")


@register("profile_numeric", " UNION ALL ".join([_profile("reading", "reading", "number"), _profile("k", "k", "number"),
                                                 _profile("(epoch_us(ts) // 1000)", "ts", "date"), _profile("active::INT", "active", "boolean")]))
def profile_numeric_query(spark, folder):
    return profile_numeric(points(spark, folder), ["reading", "k", "ts", "active"])


@register("profile_categories", f"SELECT 'p_brand' AS field, i + 1 AS rank, label AS value, (SELECT count(*) FROM part WHERE p_brand = b.label) AS count FROM {labels_sql(PART, 'p_brand')} b "
                                f"UNION ALL SELECT 'p_type', i + 1, label, (SELECT count(*) FROM part WHERE p_type = b.label) FROM {labels_sql(PART, 'p_type')} b")
def profile_categories_query(spark, folder):
    """The 23 most frequent values of two attributes, counted in one scan."""
    return profile_categories(part(spark, folder), ["p_brand", "p_type"])


@register("chart_domain", f"SELECT 'c_acctbal' AS field, min(c_acctbal) AS min, max(c_acctbal) AS max, min(c_acctbal) FILTER (c_acctbal > 0) AS min_positive, max(c_acctbal) FILTER (c_acctbal > 0) AS max_positive FROM customer")
def chart_domain_query(spark, folder):
    table = customer(spark, folder)
    d = chart_domain(table, "c_acctbal")
    # The domain is literals by now; the scan below keeps the plan on the table.
    one = table.df.select(F.lit("c_acctbal").alias("field")).distinct()
    return one.select("field", *[F.lit(v).cast("double").alias(n) for n, v in (
        ("min", d.min), ("max", d.max), ("min_positive", d.min_positive), ("max_positive", d.max_positive))])


@register("topk_categories", f"SELECT i + 1 AS rank, label AS value FROM {labels_sql(POINTS, chr(34) + 'user' + chr(34))} b")
def topk_categories(spark, folder):
    return profile_categories(points(spark, folder), ["user"]).select("rank", "value")


def _axis_query(name: str, sql: str, build) -> None:
    @register(name, sql)
    def query(spark, folder):
        table, axis = build(spark, folder)
        bins = axis_table(table, axis)
        # Rows of each bin come from the bin expression, edges from the axis.
        counts = table.df.groupBy(axis.bin(table).alias("bin")).agg(F.count(F.lit(1)).alias("count")).where("bin is not null")
        return bins.join(F.broadcast(counts), "bin", "left").select(
            "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def _axis_sql(source: str, value: str, bins: int, kind: str = "number", scale: str = "linear") -> str:
    return (f"WITH b AS {edges_sql(source, value, bins, kind, scale)} SELECT b.i AS bin, round(b.lo, 6)::DOUBLE AS lower, round(b.hi, 6)::DOUBLE AS upper, "
            f"(SELECT count(*) FROM {source} p WHERE {inside(value)}) AS count FROM b")


_axis_query("axis_numeric", _axis_sql(LINEITEM, "l_extendedprice", 64),
            lambda s, f: (t := lineitem(s, f), axis_for(t, "l_extendedprice", 64)))
_axis_query("axis_date", _axis_sql(ORDERS, "(epoch_us(o_orderdate) // 1000)", 36, "date"),
            lambda s, f: (t := orders(s, f), axis_for(t, "o_orderdate", 36)))
_axis_query("axis_log10", _axis_sql(CUSTOMER, "c_acctbal", 16, scale="log10"),
            lambda s, f: (t := customer(s, f), axis_for(t, "c_acctbal", 16, "log10")))


# --- single charts --------------------------------------------------------

@register("hist_category", categories_sql("bar", POINTS, "category"))
def hist_category(spark, folder):
    return hist_bar(points(spark, folder), "category")


@register("hist_category_other", categories_sql("bar", PART, "p_brand"))
def hist_category_other(spark, folder):
    """More values than labels: the rest is counted exactly in the last bin."""
    return hist_bar(part(spark, folder), "p_brand")


@register("hist_category_missing", categories_sql("bar", POINTS, '"user"', "value >= 20"))
def hist_category_missing(spark, folder):
    """Bins come from the full table, counts from the filtered one."""
    return hist_bar(points(spark, folder), "user", expression=rule("value", "gte", 20))


@register("hist_numeric", histogram_sql("bar", LINEITEM, "l_extendedprice", 24))
def hist_numeric(spark, folder):
    return hist_bar(lineitem(spark, folder), "l_extendedprice")


@register("hist_numeric_filtered", histogram_sql("bar", POINTS, "reading", 40, where=NESTED_SQL))
def hist_numeric_filtered(spark, folder):
    return hist_bar(points(spark, folder), "reading", 40, expression=NESTED)


@register("hist_log10", histogram_sql("bar", CUSTOMER, "c_acctbal", 20, scale="log10"))
def hist_log10(spark, folder):
    """Non-positive balances are missing on a logarithmic axis."""
    return hist_bar(customer(spark, folder), "c_acctbal", 20, "log10")


@register("hist_constant", f"SELECT 'bar' AS chart_id, 0::BIGINT AS cell, 0::BIGINT AS x_bin, 0::BIGINT AS y_bin, count(*) AS count, NULL::DOUBLE AS value FROM lineitem "
                           "UNION ALL SELECT 'bar', -1, NULL, NULL, 0, NULL")
def hist_constant(spark, folder):
    """A constant attribute has one bin."""
    table = lineitem(spark, folder)
    table = table.with_df(table.df.withColumn("l_tax", F.col("l_linenumber") * 0.0 + 7.5))
    return hist_bar(table, "l_tax")


@register("hist_boolean", "SELECT 'bar' AS chart_id, active::BIGINT AS cell, active::BIGINT AS x_bin, 0::BIGINT AS y_bin, count(*) AS count, NULL::DOUBLE AS value "
                          f"FROM {POINTS} p GROUP BY active UNION ALL SELECT 'bar', -1, NULL, NULL, 0, NULL")
def hist_boolean(spark, folder):
    return hist_bar(points(spark, folder), "active")


@register("pie_shares", f"WITH b AS {labels_sql(ORDERS, 'o_orderpriority')} SELECT 'pie' AS chart_id, b.i AS cell, count(*) AS count, "
                        "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM orders o JOIN b ON b.label = o.o_orderpriority GROUP BY b.i")
def pie(spark, folder):
    return pie_shares(orders(spark, folder), "o_orderpriority").withColumn("percent", F.round("percent", 6))


def _series(aggregate: str) -> None:
    y = None if aggregate == "count" else "reading"

    @register(f"time_series_{aggregate}", histogram_sql("time", POINTS, "(epoch_us(ts) // 1000)", 30, "date", measure=y, aggregate=aggregate))
    def query(spark, folder):
        table = points(spark, folder)
        return time_series(table, "ts", y, aggregate, 30).withColumn("value", F.round("value", 4))


for _aggregate in ("count", "sum", "mean", "min", "max"):
    _series(_aggregate)


@register("time_series_orders", histogram_sql("time", ORDERS, "(epoch_us(o_orderdate) // 1000)", 48, "date", measure="o_totalprice", aggregate="mean", digits=2,
                                              where="o_orderstatus = 'F'"))
def time_series_orders(spark, folder):
    table = orders(spark, folder)
    result = time_series(table, "o_orderdate", "o_totalprice", "mean", 48, expression=rule("o_orderstatus", "eq", "F"))
    return result.withColumn("value", F.round("value", 2))


@register("scatter_binned", scatter_sql("scatter", LINEITEM, "l_quantity", "l_extendedprice", 24))
def scatter_cells(spark, folder):
    return scatter_binned(lineitem(spark, folder), "l_quantity", "l_extendedprice")


@register("scatter_raw", f"WITH d AS (SELECT min(reading) AS x0, max(reading) AS x1, min((epoch_us(ts) // 1000)) AS y0, max((epoch_us(ts) // 1000)) AS y1 FROM {POINTS} p) "
                         f"SELECT row_id AS row, round((reading - x0) / (x1 - x0) * 2 - 1, 6) AS x, round(((epoch_us(ts) // 1000) - y0) / (y1 - y0) * 2 - 1, 6) AS y "
                         f"FROM {POINTS} p, d WHERE reading IS NOT NULL AND {NESTED_SQL}")
def scatter_positions(spark, folder):
    raw = scatter_raw(points(spark, folder), "reading", "ts", expression=NESTED)
    return raw.rows.select("row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("scatter_raw_extent", f"WITH d AS (SELECT min(value) AS x0, max(value) AS x1, min(k) AS y0, max(k) AS y1 FROM {POINTS} p), "
                                f"s AS (SELECT (value - d.x0) / (d.x1 - d.x0) AS x, (k - d.y0) / (d.y1 - d.y0) AS y FROM {POINTS} p, d WHERE category = 'error' AND k < 50) "
                                "SELECT round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM s")
def scatter_extent(spark, folder):
    table = points(spark, folder)
    test = compile_expression(table, rule("category", "eq", "error")) & compile_expression(table, rule("k", "lt", 50))
    extent = scatter_raw(table, "value", "k", predicate=test).extent()
    return extent.select(*[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register("log_y_omit", f"SELECT * FROM ({histogram_sql('bar', POINTS, 'value', 64, where='value > 40')}) h WHERE cell >= 0 AND count > 0")
def log_y(spark, folder):
    return log_y_omit(hist_bar(points(spark, folder), "value", 64, expression=rule("value", "gt", 40)))


@register("missing_count", f"SELECT 'a' AS chart_id, count(*) FILTER (reading IS NULL) AS missing FROM {POINTS} p UNION ALL "
                           f"SELECT 'b', count(*) FILTER (\"user\" IS NULL) FROM {POINTS} p")
def missing(spark, folder):
    return missing_count(run_charts(points(spark, folder), [ChartSpec("a", "bar", "reading"), ChartSpec("b", "bar", "user")]))


@register("selected_count", f"SELECT count(*) AS selected FROM {POINTS} p WHERE {NESTED_SQL}")
def selected(spark, folder):
    return selected_count(points(spark, folder), NESTED)


@register("fit_extent", f"WITH h AS ({scatter_sql('scatter', POINTS, 'value', 'k', 16, 'value BETWEEN 10 AND 25 AND k > 60')}) "
                        "SELECT 'scatter' AS chart_id, round(min(x_bin) / 16.0 - 0.04 * (max(x_bin) + 1 - min(x_bin)) / 16.0, 6)::DOUBLE AS x0, "
                        "round(min(y_bin) / 16.0 - 0.04 * (max(y_bin) + 1 - min(y_bin)) / 16.0, 6)::DOUBLE AS y0, "
                        "round((max(x_bin) + 1) / 16.0 + 0.04 * (max(x_bin) + 1 - min(x_bin)) / 16.0, 6)::DOUBLE AS x1, "
                        "round((max(y_bin) + 1) / 16.0 + 0.04 * (max(y_bin) + 1 - min(y_bin)) / 16.0, 6)::DOUBLE AS y1 FROM h WHERE cell >= 0 AND count > 0")
def fit(spark, folder):
    table = points(spark, folder)
    test = F.col("value").between(10, 25) & (F.col("k") > 60)
    extent = fit_extent(scatter_binned(table, "value", "k", 16, predicate=test), 16, 16)
    return extent.select("chart_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- many charts in one scan ----------------------------------------------

FOUR = [ChartSpec("flag", "bar", "l_returnflag"), ChartSpec("price", "bar", "l_extendedprice", bins=32),
        ChartSpec("ship", "time", "l_shipdate", "l_extendedprice", bins=40, aggregate="mean"),
        ChartSpec("cells", "scatter", "l_quantity", "l_extendedprice", bins=16)]
LINE_FILTER = "l_discount >= 0.05"
RUN_SQL = " UNION ALL ".join(f"SELECT * FROM ({q}) q{i}" for i, q in enumerate((
    categories_sql("flag", LINEITEM, "l_returnflag", LINE_FILTER), histogram_sql("price", LINEITEM, "l_extendedprice", 32, where=LINE_FILTER),
    histogram_sql("ship", LINEITEM, "(epoch_us(l_shipdate) // 1000)", 40, "date", where=LINE_FILTER, measure="l_extendedprice", aggregate="mean", digits=2),
    scatter_sql("cells", LINEITEM, "l_quantity", "l_extendedprice", 16, LINE_FILTER))))


@register("run_charts", RUN_SQL)
def four_charts(spark, folder):
    """Four charts under one filter: one scan and one shuffle of cells."""
    result = run_charts(lineitem(spark, folder), FOUR, rule("l_discount", "gte", 0.05))
    return result.withColumn("value", F.round("value", 2))


TWELVE = ([ChartSpec(f"b{i}", "bar", n, bins=b) for i, (n, b) in enumerate((("value", 8), ("reading", 16), ("k", 32), ("category", 24), ("user", 24), ("active", 2)))]
          + [ChartSpec(f"t{a}", "time", "ts", "reading", bins=20, aggregate=a) for a in ("sum", "mean", "min", "max")]
          + [ChartSpec("tc", "time", "ts", bins=20), ChartSpec("s", "scatter", "value", "k", bins=12)])
TWELVE_SQL = " UNION ALL ".join(f"SELECT * FROM ({q}) q{i}" for i, q in enumerate([
    histogram_sql("b0", POINTS, "value", 8, where=NESTED_SQL), histogram_sql("b1", POINTS, "reading", 16, where=NESTED_SQL),
    histogram_sql("b2", POINTS, "k", 32, where=NESTED_SQL), categories_sql("b3", POINTS, "category", NESTED_SQL),
    categories_sql("b4", POINTS, '"user"', NESTED_SQL),
    f"SELECT 'b5' AS chart_id, v::BIGINT AS cell, v::BIGINT AS x_bin, 0::BIGINT AS y_bin, (SELECT count(*) FROM {POINTS} p WHERE active = v AND {NESTED_SQL}) AS count, "
    "NULL::DOUBLE AS value FROM (VALUES (FALSE), (TRUE)) b(v) UNION ALL SELECT 'b5', -1, NULL, NULL, 0, NULL",
    *[histogram_sql(f"t{a}", POINTS, "(epoch_us(ts) // 1000)", 20, "date", where=NESTED_SQL, measure="reading", aggregate=a) for a in ("sum", "mean", "min", "max")],
    histogram_sql("tc", POINTS, "(epoch_us(ts) // 1000)", 20, "date", where=NESTED_SQL), scatter_sql("s", POINTS, "value", "k", 12, NESTED_SQL)]))


@register("run_charts_twelve", TWELVE_SQL)
def twelve_charts(spark, folder):
    result = run_charts(points(spark, folder), TWELVE, NESTED)
    return result.withColumn("value", F.round("value", 4))


# --- several tables -------------------------------------------------------

BOTH = f"(SELECT row_id, c_acctbal AS v, 'customer' AS source_id FROM {CUSTOMER} c UNION ALL SELECT row_id, s_acctbal, 'supplier' FROM {SUPPLIER} s)"


def balances(spark, folder):
    return [Series("customer", customer(spark, folder), "c_acctbal"), Series("supplier", supplier(spark, folder), "s_acctbal")]


def _combined_sql(sources: tuple[str, ...]) -> str:
    names = " UNION ALL ".join(f"SELECT '{s}' AS source_id" for s in sources)
    wanted = ", ".join(f"'{s}'" for s in sources)
    return (f"WITH b AS {edges_sql(BOTH, 'v', 24)}, n AS ({names} UNION ALL SELECT NULL), "
            f"s AS (SELECT * FROM {BOTH} p WHERE source_id IN ({wanted})), "
            f"c AS (SELECT s.source_id, b.i FROM s JOIN b ON {inside('v')}) "
            "SELECT n.source_id, 'balance' AS chart_id, b.i AS cell, b.i AS x_bin, 0::BIGINT AS y_bin, "
            "(SELECT count(*) FROM c WHERE c.i = b.i AND (n.source_id IS NULL OR c.source_id = n.source_id)) AS count, NULL::DOUBLE AS value FROM n CROSS JOIN b "
            "UNION ALL SELECT n.source_id, 'balance', -1, NULL, NULL, (SELECT count(*) FROM s WHERE v IS NULL AND (n.source_id IS NULL OR s.source_id = n.source_id)), NULL FROM n")


@register("combine_series", _combined_sql(("customer", "supplier")))
def combined(spark, folder):
    return combine_series(ChartSpec("balance", "bar", "", bins=24), balances(spark, folder))


@register("visible_series", _combined_sql(("supplier",)))
def visible(spark, folder):
    """A hidden table leaves the counts; the shared bins stay."""
    return combine_series(ChartSpec("balance", "bar", "", bins=24), balances(spark, folder), hidden=["customer"])


@register("combine_raw", f"WITH d AS (SELECT min(v) AS x0, max(v) AS x1 FROM {BOTH} p), n AS (SELECT min(v) AS y0, max(v) AS y1 FROM "
                         "(SELECT c_nationkey AS v FROM customer UNION ALL SELECT s_nationkey FROM supplier)) "
                         "SELECT source_id, row, round((v - x0) / (x1 - x0) * 2 - 1, 6) AS x, round((w - y0)::DOUBLE / (y1 - y0) * 2 - 1, 6) AS y FROM "
                         "(SELECT 'customer' AS source_id, c_custkey AS row, c_acctbal AS v, c_nationkey AS w FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_nationkey FROM supplier), d, n")
def combined_raw(spark, folder):
    series = [Series("customer", customer(spark, folder), "c_acctbal", "c_nationkey"), Series("supplier", supplier(spark, folder), "s_acctbal", "s_nationkey")]
    return combine_raw(series).select("source_id", "row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _label_series(spark, folder):
    docs = keyed(spark, folder, "documents", "doc_id")
    return [Series("documents", docs, "lang"), Series("sources", docs, "source")]


@register("combine_series_labels", "WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT label FROM ("
                                   f"SELECT label FROM {labels_sql(keyed_sql('documents', 'doc_id'), 'lang')} UNION SELECT label FROM {labels_sql(keyed_sql('documents', 'doc_id'), 'source')}) "
                                   "ORDER BY label LIMIT 63)), b AS (SELECT i, label FROM l UNION ALL SELECT (SELECT count(*) FROM l), NULL), "
                                   "s AS (SELECT 'documents' AS source_id, lang AS v FROM documents UNION ALL SELECT 'sources', source FROM documents), n AS (SELECT 'documents' AS source_id UNION ALL SELECT 'sources' UNION ALL SELECT NULL), "
                                   "c AS (SELECT s.source_id, coalesce(l.i, (SELECT count(*) FROM l)) AS i FROM s LEFT JOIN l ON l.label = s.v WHERE s.v IS NOT NULL) "
                                   "SELECT n.source_id, 'labels' AS chart_id, b.i AS cell, b.i AS x_bin, 0::BIGINT AS y_bin, (SELECT count(*) FROM c WHERE c.i = b.i AND (n.source_id IS NULL OR c.source_id = n.source_id)) AS count, NULL::DOUBLE AS value FROM n CROSS JOIN b "
                                   "UNION ALL SELECT n.source_id, 'labels', -1, NULL, NULL, (SELECT count(*) FROM s WHERE v IS NULL AND (n.source_id IS NULL OR s.source_id = n.source_id)), NULL FROM n")
def combined_labels(spark, folder):
    """Shared text axis: union of labels in order, and a catch-all bin that is always there."""
    return combine_series(ChartSpec("labels", "bar", ""), _label_series(spark, folder))


@register("shared_domain", f"SELECT 'v' AS field, min(v) AS min, max(v) AS max, min(v) FILTER (v > 0) AS min_positive, max(v) FILTER (v > 0) AS max_positive FROM {BOTH} p")
def shared(spark, folder):
    """The union domain equals the profile of the concatenated tables."""
    series = balances(spark, folder)
    d = shared_domain([chart_domain(s.table, s.x) for s in series])
    rows = union_series((s.source_id, s.table.df.select(F.col(s.x).alias("v"))) for s in series)
    inside_domain = rows.where(F.col("v").between(d.min, d.max)).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return inside_domain.select(F.lit("v").alias("field"), F.col("lo").alias("min"), F.col("hi").alias("max"),
                                F.lit(d.min_positive).alias("min_positive"), F.lit(d.max_positive).alias("max_positive"))


@register("union_series", "SELECT 'customer' AS source_id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier")
def union_of_series(spark, folder):
    return union_series((s.source_id, s.table.df.select(F.col(s.x).alias("balance"))) for s in balances(spark, folder))


@register("union_labels", "SELECT DISTINCT v AS label FROM (SELECT lang AS v FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT event_type FROM events) WHERE v IS NOT NULL")
def labels(spark, folder):
    docs = keyed(spark, folder, "documents", "doc_id")
    return union_labels([(docs, "lang"), (docs, "source"), (points(spark, folder), "category")])


@register("timeline_extent", f"SELECT min((epoch_us(ts) // 1000)) AS start, max((epoch_us(ts) // 1000)) AS \"end\", count(ts) AS valid, count(*) - count(ts) AS missing FROM {POINTS} p")
def extent(spark, folder):
    return timeline_extent(points(spark, folder), "ts")


@register("timeline_extent_union", "SELECT least((SELECT min((epoch_us(ts) // 1000)) FROM events), (SELECT min((epoch_us(o_orderdate) // 1000)) FROM orders)) AS start, "
                                   "greatest((SELECT max((epoch_us(ts) // 1000)) FROM events), (SELECT max((epoch_us(o_orderdate) // 1000)) FROM orders)) AS \"end\", "
                                   "(SELECT count(ts) FROM events) + (SELECT count(o_orderdate) FROM orders) AS valid, "
                                   "(SELECT count(*) - count(ts) FROM events) + (SELECT count(*) - count(o_orderdate) FROM orders) AS missing")
def extents(spark, folder):
    return union_extents([timeline_extent(points(spark, folder), "ts"), timeline_extent(orders(spark, folder), "o_orderdate")])


def flagship(spark, folder):
    """Filter nested events, then one bar chart and one mean time series in one scan."""
    specs = [ChartSpec("types", "bar", "category"), ChartSpec("mean value", "time", "ts", "value", bins=24, aggregate="mean")]
    return run_charts(points(spark, folder), specs, NESTED)


register("flagship", " UNION ALL ".join(f"SELECT * FROM ({q}) q{i}" for i, q in enumerate((
    categories_sql("types", POINTS, "category", NESTED_SQL),
    histogram_sql("mean value", POINTS, "(epoch_us(ts) // 1000)", 24, "date", where=NESTED_SQL, measure="value", aggregate="mean")))))(
    lambda spark, folder: flagship(spark, folder).withColumn("value", F.round("value", 4)))
