"""Row sets: what a brush selects, and how a row set shows on other charts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..table import PointTable
from .charts import Chart, RawScatter
from .expressions import compile_expression
from .joins import semi_applied
from .series import union_series


def chart_rows(table: PointTable, chart: Chart, cells: Iterable[int], predicate: Column | None = None) -> DataFrame:
    """Ids of the selected rows that fall into any of the cells."""
    rows = table.df if predicate is None else table.df.where(predicate)
    wanted = sorted(set(cells))
    inside = chart.cell(table).isin(*wanted) if wanted else F.lit(False)
    return rows.where(inside & (chart.cell(table) >= 0)).select(table.col(table.row).alias("row"))


def highlight_counts(table: PointTable, chart: Chart, rows: DataFrame, predicate: Column | None = None) -> DataFrame:
    """How many rows of a row set each cell of an existing chart holds."""
    kept = semi_applied(table, rows, predicate)
    return (kept.select(chart.cell(table).alias("cell")).where(F.col("cell") >= 0)
            .groupBy("cell").agg(F.count(F.lit(1)).alias("count")))


def highlight_scatter(raw: RawScatter, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Rows of an unbinned scatter inside a rectangle of shares 0…1."""
    sx, sy = (F.col("x") + 1) / 2, (F.col("y") + 1) / 2
    return raw.rows.where(sx.between(*x) & sy.between(*y)).select("row")


def inspect_matches(tables: Mapping[str, tuple[PointTable, dict]], within: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of several tables that match an expression each, with their table."""
    parts = []
    for source, (table, expression) in tables.items():
        test = compile_expression(table, expression)
        if within and source in within:
            test = test & within[source]
        parts.append((source, table.df.where(test).select(table.col(table.row).alias("row"))))
    return union_series(parts)


union_matches = inspect_matches


def union_labels(tables: Iterable[tuple[PointTable, str]]) -> DataFrame:
    """Distinct labels over several tables."""
    parts = [t.df.where(t.col(n).isNotNull()).select(t.col(n).alias("label")).distinct() for t, n in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()
