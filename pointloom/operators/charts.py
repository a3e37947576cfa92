"""Charts: exact counts and measures on fixed axes, many charts in one scan.

Every chart answers with one row per bin, empty bins included, and one ``missing``
row (``cell = -1``), so that plotted plus missing equals the selected rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scales import LINEAR, LOG10, axis_bounds, check_scale, normalize_axis, on_scale, scale_value
from ..table import BOOLEAN, DATE, NUMBER, STRING, Field, PointTable, quote, sql_text
from .axes import Axis, Domain, build_axis, chart_domains, measure
from .expressions import compile_expression

# Fixed values.
MAX_CHARTS = 12
TYPES = ("bar", "pie", "time", "scatter")
AGGREGATES = ("count", "sum", "mean", "min", "max")
FIT_PADDING = 0.04
MISSING = -1


@dataclass(frozen=True)
class ChartSpec:
    """What to draw. ``y`` is the second axis of a scatter or the measure of a time series."""

    id: str
    type: str
    x: str
    y: str | None = None
    bins: int = 24
    binned: bool = True
    aggregate: str = "count"
    x_scale: str = LINEAR
    y_scale: str = LINEAR


@dataclass(frozen=True)
class Chart:
    """A spec with its axes resolved over the full table."""

    spec: ChartSpec
    x: Axis
    y: Axis | None = None

    @property
    def measure(self) -> str | None:
        return self.spec.y if self.spec.type == "time" and self.spec.aggregate != "count" else None

    @property
    def size(self) -> int:
        return self.x.size * (self.y.size if self.y else 1)

    def cell(self, table: PointTable) -> Column:
        """``y_bin * nx + x_bin``, or -1 when the row cannot be plotted."""
        return F.expr(self.cell_sql(table))

    def cell_sql(self, table: PointTable) -> str:
        place = f"({self.x.bin_sql(table)})"
        if self.y is not None:
            place = f"({self.y.bin_sql(table)}) * {self.x.size} + {place}"
        if self.measure:
            place = f"CASE WHEN {quote(self.measure)} IS NOT NULL THEN {place} END"
        return f"COALESCE(CAST({place} AS INT), {MISSING})"


def check_spec(spec: ChartSpec, table: PointTable) -> None:
    """Refuse a chart that the table cannot answer, before any job."""
    if spec.type not in TYPES or isinstance(spec.bins, bool) or not isinstance(spec.bins, int) or not 2 <= spec.bins <= 64:
        raise ValueError("Invalid chart configuration")
    kind = table.field(spec.x).kind
    check_scale(spec.x_scale), check_scale(spec.y_scale)
    if spec.type == "time" and kind != DATE:
        raise ValueError(f"{spec.x} is not a time, so it has no series")
    if spec.type == "scatter" and not (spec.y and table.has(spec.y)):
        raise ValueError("A scatter chart needs two attributes of the table")
    if spec.type == "time" and (spec.aggregate not in AGGREGATES
                                or (spec.aggregate != "count" and not (spec.y and table.has(spec.y, NUMBER)))):
        raise ValueError("The values of a series are numbers, summed up by a known aggregate")


def prepare(table: PointTable, specs: Sequence[ChartSpec],
            domains: dict[str, tuple[Domain, Domain | None]] | None = None) -> list[Chart]:
    """Axes for all charts. Domains that are not given are profiled together."""
    if len(specs) > MAX_CHARTS:
        raise ValueError(f"More than {MAX_CHARTS} charts")
    for s in specs:
        check_spec(s, table)
    given = domains or {}
    needed = [n for s in specs if s.id not in given for n in (s.x, s.y if s.type == "scatter" else None) if n]
    known = chart_domains(table, needed)
    charts = []
    for s in specs:
        shared = s.id in given
        xd, yd = given[s.id] if shared else (known[s.x], known.get(s.y) if s.type == "scatter" else None)
        x = build_axis(s.x, xd, s.bins, LINEAR if s.type == "pie" else s.x_scale, shared)
        y = build_axis(s.y, yd, s.bins, s.y_scale, shared) if s.type == "scatter" else None
        charts.append(Chart(s, x, y))
    return charts


# --- one scan for all charts ----------------------------------------------

def chart_entries(table: PointTable, charts: Sequence[Chart], predicate: Column | None = None) -> DataFrame:
    """One row ``c, cell, n, v`` per selected row and chart."""
    value = lambda chart: quote(chart.measure) if chart.measure else "NULL"
    entries = [f"struct({i} AS c, {chart.cell_sql(table)} AS cell, 1L AS n, CAST({value(chart)} AS DOUBLE) AS v)"
               for i, chart in enumerate(charts)]
    rows = table.df if predicate is None else table.df.where(predicate)
    if len(entries) == 1:
        return rows.selectExpr(f"{entries[0]} AS e").selectExpr("e.*")
    return rows.selectExpr(f"inline(array({', '.join(entries)}))")


def _by_chart(values: Sequence[object]) -> str:
    """SQL that picks the value of the row's chart from a short list."""
    return f"element_at(array({', '.join(map(str, values))}), c + 1)"


def chart_grid(spark: SparkSession, charts: Sequence[Chart]) -> DataFrame:
    """Every cell of every chart and its missing row, counting nothing: at most 12 × 4,097 rows."""
    last = _by_chart([c.size - 1 for c in charts])
    return (spark.range(0, len(charts), 1, 1).selectExpr("CAST(id AS INT) AS c")
            .selectExpr("c", f"explode(sequence({MISSING}, {last})) AS cell", "0L AS n", "CAST(NULL AS DOUBLE) AS v"))


def count_cells(entries: DataFrame, keys: Sequence[str], measured: bool) -> DataFrame:
    """Counts and, where a chart has a measure, sums and extremes per cell."""
    sums = ["sum(n) AS count"] + (["sum(v) AS s", "min(v) AS lo", "max(v) AS hi"] if measured else [])
    out = entries.groupBy(*keys, "cell").agg(*map(F.expr, sums))
    return out if measured else out.selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS {n}" for n in ("s", "lo", "hi")])


def shown_cells(cells: DataFrame, charts: Sequence[Chart], extra: Sequence[str] = ()) -> DataFrame:
    """Counted cells under their chart id, with bin numbers and the chosen measure."""
    id, nx = _by_chart([sql_text(c.spec.id) for c in charts]), _by_chart([max(1, c.x.size) for c in charts])
    aggregate = _by_chart([sql_text(c.spec.aggregate if c.measure else "count") for c in charts])
    value = (f"CASE {aggregate} WHEN 'sum' THEN s WHEN 'mean' THEN s / NULLIF(count, 0) WHEN 'min' THEN lo WHEN 'max' THEN hi END")
    placed = f"cell <> {MISSING}"
    return cells.selectExpr(*extra, f"{id} AS chart_id", "cell", f"CASE WHEN {placed} THEN pmod(cell, {nx}) END AS x_bin",
                            f"CASE WHEN {placed} THEN CAST(cell DIV {nx} AS INT) END AS y_bin", "count",
                            f"CASE WHEN {placed} AND count > 0 THEN {value} END AS value")


def run_charts(table: PointTable, specs: Sequence[ChartSpec], expression: dict | None = None, *,
               predicate: Column | None = None,
               domains: dict[str, tuple[Domain, Domain | None]] | None = None) -> DataFrame:
    """Up to 12 charts under one filter.

    Result: ``chart_id, cell, x_bin, y_bin, count, value``; the missing row of each
    chart has ``cell = -1``.
    """
    charts = prepare(table, specs, domains)
    if expression is not None:
        compiled = compile_expression(table, expression)
        predicate = compiled if predicate is None else predicate & compiled
    # Zero rows of the grid join the same aggregation, so empty bins cost no join. Entries
    # are combined before the shuffle: what moves is bounded by cells, not by rows or a hot value.
    entries = chart_entries(table, charts, predicate).unionByName(chart_grid(table.df.sparkSession, charts))
    return shown_cells(count_cells(entries, ["c"], any(c.measure for c in charts)), charts)


def plotted(result: DataFrame) -> DataFrame:
    return result.where(F.col("cell") >= 0)


def missing_count(result: DataFrame) -> DataFrame:
    """Selected rows that each chart could not place."""
    return result.where(F.col("cell") == MISSING).select("chart_id", F.col("count").alias("missing"))


# --- single charts --------------------------------------------------------

def hist_bar(table: PointTable, x: str, bins: int = 24, scale: str = LINEAR, **how) -> DataFrame:
    """Rows per bin."""
    return run_charts(table, [ChartSpec("bar", "bar", x, bins=bins, x_scale=scale)], **how)


def pie_shares(table: PointTable, x: str, bins: int = 24, **how) -> DataFrame:
    """Rows per bin and their percentage of the plotted rows."""
    cells = plotted(run_charts(table, [ChartSpec("pie", "pie", x, bins=bins)], **how))
    total = F.sum("count").over(Window.partitionBy("chart_id"))
    return cells.select("chart_id", "cell", "count",
                        F.when(total > 0, F.col("count") * 100.0 / total).otherwise(0.0).alias("percent"))


def time_series(table: PointTable, x: str, y: str | None = None, aggregate: str = "count", bins: int = 24,
                **how) -> DataFrame:
    """Count, sum, mean, minimum or maximum per time bin; bins without rows have no value."""
    return run_charts(table, [ChartSpec("time", "time", x, y, bins=bins, aggregate=aggregate)], **how)


def scatter_binned(table: PointTable, x: str, y: str, bins: int = 24, x_scale: str = LINEAR, y_scale: str = LINEAR,
                   **how) -> DataFrame:
    """Rows per two-dimensional cell."""
    return run_charts(table, [ChartSpec("scatter", "scatter", x, y, bins=bins, x_scale=x_scale, y_scale=y_scale)], **how)


def selected_count(table: PointTable, expression: dict | None = None, predicate: Column | None = None) -> DataFrame:
    """How many rows pass the filter."""
    if predicate is None:
        predicate = compile_expression(table, expression or {"op": "and", "children": []})
    return table.df.where(predicate).agg(F.count(F.lit(1)).alias("selected"))


def log_y_omit(result: DataFrame, measured: bool = False) -> DataFrame:
    """What a logarithmic Y axis can show: only positive counts or values."""
    return plotted(result).where(F.col("value" if measured else "count") > 0)


def fit_extent(result: DataFrame, nx: int, ny: int = 1) -> DataFrame:
    """Occupied part of a binned chart as shares of its axes, padded by 4 %."""
    full = plotted(result).where(F.col("count") > 0)

    def ends(bin_name: str, n: int) -> tuple[Column, Column]:
        low, high = F.min(bin_name), F.max(bin_name) + 1
        pad = (high - low) * FIT_PADDING / n
        return low / n - pad, high / n + pad

    x0, x1 = ends("x_bin", nx)
    y0, y1 = ends("y_bin", ny)
    if ny == 1:
        y0, y1 = F.lit(0.0), F.lit(1.0)
    return full.groupBy("chart_id").agg(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


# --- unbinned scatter -----------------------------------------------------

@dataclass(frozen=True)
class RawScatter:
    """Every plottable pair with its row id and its position in [-1, 1]."""

    rows: DataFrame
    x: Axis
    y: Axis
    bounds: tuple[float, float, float, float]
    table: PointTable
    predicate: Column | None

    def missing(self) -> DataFrame:
        """Selected rows without a place on both axes."""
        base = self.table.df if self.predicate is None else self.table.df.where(self.predicate)
        gap = self.x.bin(self.table).isNull() | self.y.bin(self.table).isNull()
        return base.agg(F.count_if(gap).alias("missing"))

    def extent(self) -> DataFrame:
        """Occupied part of the plot, as shares of the full bounds."""
        share = [((F.min if side == 0 else F.max)((F.col(c) + 1) / 2)).alias(f"{c}{side}")
                 for side in (0, 1) for c in ("x", "y")]
        return self.rows.agg(*share)

    def summary(self) -> DataFrame:
        """Selected rows, how many have a place and how many have none, and the extent, in one scan."""
        base = self.table.df if self.predicate is None else self.table.df.where(self.predicate)
        placed = F.coalesce(_placed(self.table, self.x) & _placed(self.table, self.y), F.lit(False))
        x0, y0, x1, y1 = self.bounds
        at = {"x": _position(self.table, self.x, (x0, x1)), "y": _position(self.table, self.y, (y0, y1))}
        share = [(F.min if side == 0 else F.max)(F.when(placed, (at[c] + 1) / 2)).alias(f"{c}{side}") for side in (0, 1) for c in ("x", "y")]
        return base.agg(F.count(F.lit(1)).alias("selected"), F.count_if(placed).alias("plotted"), F.count_if(~placed).alias("missing"), *share)

    def fit(self) -> DataFrame:
        """The extent padded by 4 % of its size, at least a thousandth."""
        e = self.extent()
        out = []
        for side, sign in ((0, -1), (1, 1)):
            for c in ("x", "y"):
                width = F.col(f"{c}1") - F.col(f"{c}0")
                pad = F.greatest(F.lit(0.001), F.when(width == 0, F.lit(1.0)).otherwise(width) * FIT_PADDING)
                out.append((F.col(f"{c}{side}") + sign * pad).alias(f"{c}{side}"))
        return e.select(*out)


def _bounds(axis: Axis, domain: Domain) -> tuple[float, float]:
    if axis.kind in (STRING, BOOLEAN):
        return 0.0, float(axis.size)
    low, high = (domain.min_positive, domain.max_positive) if axis.scale == LOG10 else (domain.min, domain.max)
    return axis_bounds(low, high, axis.scale, axis.kind == DATE)


def _position(table: PointTable, axis: Axis, bounds: tuple[float, float]) -> Column:
    if axis.ranged:
        low, high = (scale_value(v, axis.scale) for v in bounds)
        return normalize_axis(on_scale(measure(table, axis.field), axis.scale), low, high)
    return normalize_axis(axis.bin(table) + F.lit(0.5), *bounds)


def scatter_raw(table: PointTable, x: str, y: str, x_scale: str = LINEAR, y_scale: str = LINEAR,
                expression: dict | None = None, predicate: Column | None = None,
                domains: tuple[Domain, Domain] | None = None) -> RawScatter:
    """Unbinned scatter: a projection of the selected rows over full-table bounds."""
    spec = ChartSpec("raw", "scatter", x, y, binned=False, x_scale=x_scale, y_scale=y_scale)
    chart, = prepare(table, [spec], {"raw": domains} if domains else None)
    known = domains or tuple(chart_domains(table, [x, y])[n] for n in (x, y))
    bx, by = _bounds(chart.x, known[0]), _bounds(chart.y, known[1])
    if expression is not None:
        compiled = compile_expression(table, expression)
        predicate = compiled if predicate is None else predicate & compiled
    rows = table.df if predicate is None else table.df.where(predicate)
    rows = (rows.where(_placed(table, chart.x) & _placed(table, chart.y))
            .select(table.col(table.row).alias("row"), _position(table, chart.x, bx).alias("x"),
                    _position(table, chart.y, by).alias("y")))
    return RawScatter(rows, chart.x, chart.y, (bx[0], by[0], bx[1], by[1]), table, predicate)


def _placed(table: PointTable, axis: Axis) -> Column:
    if axis.size == 0:
        return F.lit(False)
    c = table.col(axis.field)
    return c > 0 if axis.scale == LOG10 else c.isNotNull()


# --- defaults -------------------------------------------------------------

def default_charts(fields: Sequence[Field], bins: int = 24) -> list[ChartSpec]:
    """A bar of the first label, a series of the first date, a scatter of two numbers."""
    label = next((f.name for f in fields if f.kind in (STRING, BOOLEAN)), None)
    date = next((f.name for f in fields if f.kind == DATE), None)
    numbers = [f.name for f in fields if f.kind == NUMBER]
    specs = []
    if label:
        specs.append(ChartSpec("bar", "bar", label, bins=bins))
    if date:
        specs.append(ChartSpec("time", "time", date, bins=bins))
    if numbers:
        plain = [n for n in numbers if n != "id"]
        x = plain[0] if plain else numbers[0]
        y = plain[1] if len(plain) > 1 else numbers[0]
        specs.append(ChartSpec("scatter", "scatter", x, y, bins=bins))
    if not specs and fields:
        specs.append(ChartSpec("bar", "bar", fields[0].name, bins=bins))
    return specs
