"""Several tables on shared axes: parts, totals and hidden series."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..table import PointTable, sql_text
from .axes import Domain, chart_domains, shared_domain
from .charts import Chart, ChartSpec, RawScatter, chart_entries, chart_grid, count_cells, prepare, scatter_raw, shown_cells

# Series colours in order.
SERIES_COLORS = ("#2463d4", "#d45b24", "#8b49ba", "#17836f", "#b34378", "#957119", "#466673", "#657c25")


@dataclass(frozen=True)
class Series:
    """One table of a comparison, with the attributes it puts on the shared axes."""

    source_id: str
    table: PointTable
    x: str
    y: str | None = None
    predicate: Column | None = None


def shared_domains(series: Sequence[Series], scatter: bool) -> tuple[Domain, Domain | None]:
    """Domains over the union of the tables; both axes of a table are profiled together."""
    parts = [chart_domains(s.table, [n for n in (s.x, s.y if scatter else None) if n]) for s in series]
    x = shared_domain([p[s.x] for p, s in zip(parts, series)])
    y = shared_domain([p[s.y] for p, s in zip(parts, series)]) if scatter else None
    return x, y


def series_charts(spec: ChartSpec, series: Sequence[Series]) -> list[Chart]:
    """The same bins for every table, each over its own attribute names."""
    domains = shared_domains(series, spec.type == "scatter")
    return [prepare(s.table, [replace(spec, x=s.x, y=s.y)], {spec.id: domains})[0] for s in series]


def union_series(parts: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Concatenate per-table results and keep where each row came from."""
    return reduce(DataFrame.unionByName, [df.withColumn("source_id", F.lit(source)) for source, df in parts])


def visible_series(series: Sequence[Series], hidden: Iterable[str] = ()) -> list[Series]:
    """Series that take part in counts and shares. Hiding is a view, never a filter."""
    hidden = set(hidden)
    return [s for s in series if s.source_id not in hidden]


def combine_series(spec: ChartSpec, series: Sequence[Series], hidden: Iterable[str] = ()) -> DataFrame:
    """Per-table cells and their totals (``source_id`` null) on shared bins.

    Axes come from all tables, so hiding one does not move the bins of the others.
    """
    charts = {s.source_id: c for s, c in zip(series, series_charts(spec, series))}
    shown = visible_series(series, hidden)
    head = charts[series[0].source_id]
    grid = chart_grid(series[0].table.df.sparkSession, [head])
    total = len(shown)
    # The total's own zero rows keep it complete when every table is hidden.
    parts = [grid.withColumn("part", F.lit(total))]
    for i, s in enumerate(shown):
        entries = chart_entries(s.table, [charts[s.source_id]], s.predicate).unionByName(grid)
        parts.append(entries.withColumn("part", F.lit(i)))
    cells = count_cells(reduce(DataFrame.unionByName, parts), ["part", "c"], head.measure is not None)
    # Cells are few by now: each counts once for its table and once for the total.
    both = (cells.withColumn("part", F.explode(F.array_distinct(F.array("part", F.lit(total)))))
            .groupBy("part", "c", "cell").agg(F.sum("count").alias("count"), F.sum("s").alias("s"), F.min("lo").alias("lo"),
                                              F.max("hi").alias("hi")))
    names = ", ".join([*(sql_text(s.source_id) for s in shown), "CAST(NULL AS STRING)"])
    return shown_cells(both, [head], [f"element_at(array({names}), part + 1) AS source_id"])


def raw_series(series: Sequence[Series], x_scale: str = "linear", y_scale: str = "linear",
               hidden: Iterable[str] = ()) -> list[tuple[str, RawScatter]]:
    """The unbinned scatter of every visible table, over bounds that all tables share."""
    domains = shared_domains(series, True)
    return [(s.source_id, scatter_raw(s.table, s.x, s.y, x_scale, y_scale, predicate=s.predicate, domains=domains))
            for s in visible_series(series, hidden)]


def combine_raw(series: Sequence[Series], x_scale: str = "linear", y_scale: str = "linear",
                hidden: Iterable[str] = ()) -> DataFrame:
    """Unbinned scatter of several tables over shared bounds, one row per observation."""
    return union_series((source, raw.rows) for source, raw in raw_series(series, x_scale, y_scale, hidden))
