"""Run a saved analysis: load, filter, chart and report every enabled source."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.colors import DEFAULT_SCHEME, MISSING_COLOR
from ..operators.charts import ChartSpec, default_charts, run_charts, scatter_raw
from ..operators.coloring import category_color, gradient_color
from ..operators.expressions import applied
from ..operators.integrity import load_report
from ..operators.series import Series, combine_series, raw_series, union_series
from ..operators.timeline import pick_time_field, relative_window, timeline_extent
from ..sources.bounds import LoadBounds
from ..sources.config import SourceConfig
from ..sources.csv import CsvLoad, load_csv
from ..sources.service import Fetch, check_service_load, http_fetch, read_feature_service
from ..sinks.export import write_points
from ..table import STRING, PointTable
from .spec import AnalysisSpec, SavedChart, SourceAnalysis, schema_compatible


@dataclass
class AnalysisRun:
    """Tables, selections and results of one run, by source id.

    ``results`` holds all single-table charts of a source, which share one scan;
    ``charts`` picks one chart out of them, or a comparison of several sources, or the
    rows of an unbinned scatter. ``plots`` holds, for the latter, how many selected rows of
    each visible source have a place and how many have none, and the part of the plot that
    they occupy. ``reports`` counts rows without a valid ellipse where a source has ellipses. ``colors`` holds the colour of every row of a source,
    ``imports`` what a CSV load accepted and rejected.
    """

    tables: dict[str, PointTable]
    selections: dict[str, Column]
    reports: dict[str, DataFrame]
    results: dict[str, DataFrame] = field(default_factory=dict)
    charts: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    plots: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    skipped_filters: list[str] = field(default_factory=list)
    colors: dict[str, DataFrame] = field(default_factory=dict)
    imports: dict[str, CsvLoad] = field(default_factory=dict)


def resolve_bounds(spec: AnalysisSpec, now: datetime | None = None) -> LoadBounds:
    """A choice of hours becomes a range up to now; other choices keep what is saved."""
    if spec.choice in ("all", "custom"):
        return LoadBounds(None if spec.choice == "all" else spec.bounds.time, spec.bounds.box)
    return replace(spec.bounds, time=relative_window(float(spec.choice), now))


def load_source(spark: SparkSession, config: SourceConfig, bounds: LoadBounds, path: str,
                fetch: Callable[[SourceConfig], Fetch] | None = None,
                described: Mapping[str, str] | None = None, imports: dict[str, CsvLoad] | None = None) -> PointTable:
    """Load one source under its bounds and rules and write it, so that queries read Parquet.

    What a CSV load reports is put into ``imports``.
    """
    if config.type == "csv":
        loaded = load_csv(spark, config, bounds)
        if imports is not None:
            imports[config.id] = loaded
        return write_points(loaded.table, path)
    answer = fetch(config) if fetch else http_fetch(config.url)
    load = read_feature_service(spark, config, answer, bounds, (described or {}).get(config.id), folder=f"{path}-pages")
    saved = write_points(load.table, path)
    check_service_load(replace(load, table=saved))
    return saved


def run_tables(spec: AnalysisSpec, tables: Mapping[str, PointTable]) -> AnalysisRun:
    """Filter and chart tables that are already loaded."""
    run = AnalysisRun(dict(tables), {}, {})
    configs = {s.id: s for s in spec.sources}
    analyses = {a.source: a for a in spec.analyses}
    for source, table in tables.items():
        a = analyses.get(source, SourceAnalysis(source))
        expression = a.expression
        if not schema_compatible(a.fields, table):
            expression = None
            run.skipped_filters.append(source)
        time = pick_time_field(table.fields, table.time_field)
        run.selections[source] = applied(table, expression, window=spec.window, time_field=time or None, box=spec.box)
        config = configs.get(source)
        run.reports[source] = load_report(table, config.limit if config and config.type == "service" else None, config.ellipses() if config else None)
    for source, table in tables.items():
        a = analyses.get(source, SourceAnalysis(source))
        saved = a.charts or tuple(SavedChart(c) for c in default_charts(table.fields))
        alone = [c.spec for c in saved if not c.series and c.spec.binned]
        if alone:
            # All single-source charts of a table share one scan.
            run.results[source] = run_charts(table, alone, predicate=run.selections[source])
            for c in alone:
                run.charts[source, c.id] = run.results[source].where(F.col("chart_id") == c.id)
        for c in saved:
            if c.series:
                run.charts[source, c.spec.id] = _compare(run, source, c)
            elif not c.spec.binned:
                s = c.spec
                raw = scatter_raw(table, s.x, s.y, s.x_scale, s.y_scale, predicate=run.selections[source])
                run.charts[source, s.id] = raw.rows
                run.plots[source, s.id] = union_series([(source, raw.summary())])
        if source in spec.coloring:
            run.colors[source] = _colored(table, spec.coloring[source])
    return run


def _colored(table: PointTable, saved: Mapping) -> DataFrame:
    """``row`` and ``color`` as the saved colouring gives them."""
    name = saved.get("field", "")
    if not name:
        return table.df.select(table.col(table.row).alias("row"), F.lit(saved.get("color", MISSING_COLOR)).alias("color"))
    if table.field(name).kind == STRING:
        return category_color(table, name, saved.get("overrides")).select("row", "color")
    return gradient_color(table, name, saved.get("bins", 24), saved.get("scale", "linear"), saved.get("scheme", DEFAULT_SCHEME)).select("row", "color")


def _compare(run: AnalysisRun, source: str, chart: SavedChart) -> DataFrame:
    spec: ChartSpec = chart.spec
    members = [(source, spec.x, spec.y)] + [(s.source, s.x, s.y) for s in chart.series if s.source in run.tables]
    series = [Series(i, run.tables[i], x, y, run.selections[i]) for i, x, y in members]
    if not spec.binned:
        parts = raw_series(series, spec.x_scale, spec.y_scale, chart.hidden)
        run.plots[source, spec.id] = union_series((s, raw.summary()) for s, raw in parts)
        return union_series((s, raw.rows) for s, raw in parts)
    return combine_series(spec, series, chart.hidden)


def run_analysis(spark: SparkSession, spec: AnalysisSpec, folder: str, *, now: datetime | None = None,
                 fetch: Callable[[SourceConfig], Fetch] | None = None,
                 described: Mapping[str, str] | None = None) -> AnalysisRun:
    """Load every enabled source into ``folder`` and run the analysis on it."""
    bounds = resolve_bounds(spec, now)
    imports: dict[str, CsvLoad] = {}
    tables = {s.id: load_source(spark, s, bounds, f"{folder}/{i}", fetch, described, imports)
              for i, s in enumerate(spec.sources, 1) if s.enabled}
    run = run_tables(spec, tables)
    run.imports.update(imports)
    return run


def timeline_extents(run: AnalysisRun) -> dict[str, DataFrame]:
    """Time extent of every table that has a time attribute."""
    found = {s: pick_time_field(t.fields, t.time_field) for s, t in run.tables.items()}
    return {s: timeline_extent(run.tables[s], f) for s, f in found.items() if f}
