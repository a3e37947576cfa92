"""CSV exports and written tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import value_text
from ..operators.joins import JoinOptions, join_guard, join_report, join_schema, placed_join_rows
from ..operators.picking import world_cell
from ..operators.records import matching, ranked_order, record_column
from ..operators.timeline import pick_time_field
from ..table import BOOLEAN, DATE, Field, PointTable, quote, unique_name

# Fixed values.
IDENTITY_HEADERS = ("featureId", "longitude", "latitude")
MAX_NAME = 100
# Any other line separator would also replace the line ends inside values.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "lineSep": "\n", "emptyValue": "", "nullValue": ""}

#: Joined pairs are many and alike: numbers in a row are kept as differences, and pages are long enough to show what repeats.
JOINED_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.page.row.count.limit": str(1 << 20),
                  "parquet.enable.dictionary#row_id": "false", "parquet.enable.dictionary#point_id": "false"}


def cell_text(c: Column, kind: str) -> Column:
    """A stored value as it is exported; a missing value is an empty cell."""
    return c.cast("string") if kind == BOOLEAN else value_text(c, kind)


def export_headers(table: PointTable) -> list[str]:
    """Identity headers, suffixed where an attribute already has the name, then attributes."""
    taken, out = list(table.names), []
    for name in IDENTITY_HEADERS:
        out.append(unique_name(name, taken + out))
    return out + table.names


def selection_rows(table: PointTable, predicate: Column | None = None) -> DataFrame:
    """Selected rows as export text, in the columns of :func:`export_headers`."""
    rows = table.df if predicate is None else table.df.where(predicate)
    columns = [(table.col(table.id), "string"), (table.col(table.lon), "number"), (table.col(table.lat), "number")]
    columns += [(table.col(f.name), f.kind) for f in table.fields]
    return rows.select(*[cell_text(c, kind).alias(h) for (c, kind), h in zip(columns, export_headers(table))])


def _write_csv(df: DataFrame, path: str, single: bool) -> None:
    (df.coalesce(1) if single else df).write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def export_selection_csv(table: PointTable, path: str, predicate: Column | None = None, single: bool = False) -> None:
    """Write the selection as CSV parts; an empty one still writes its header.

    One file is an explicit choice, since it passes everything through one task.
    """
    _write_csv(selection_rows(table, predicate), path, single)


def records_rows(table: PointTable, columns: Sequence[str], sort: str = "", descending: bool = False, search: str = "",
                 predicate: Column | None = None) -> DataFrame:
    """Chosen columns of matching records, in query order."""
    rows, order = ranked_order(table, matching(table, search, predicate), sort, descending)
    ordered = rows.orderBy(*order)
    shown, taken = [], []
    for key in columns:
        c, kind = record_column(table, key)
        taken.append(unique_name(key.removeprefix("@"), taken))
        shown.append(cell_text(c, kind).alias(taken[-1]))
    return ordered.select(*shown)


def export_records_csv(table: PointTable, path: str, columns: Sequence[str], sort: str = "", descending: bool = False,
                       search: str = "", predicate: Column | None = None, single: bool = False) -> None:
    """Write records in query order; parts sort by name in that order."""
    _write_csv(records_rows(table, columns, sort, descending, search, predicate), path, single)


def safe_export_name(name: str) -> str:
    """File name for an export: letters, digits, dots, dashes and underscores."""
    kept = "".join(ch if unicodedata.category(ch)[0] in "LN" or ch in "._-" else "\0" for ch in name.strip())
    cleaned = re.sub("\0+", "-", kept)
    cleaned = re.sub(r"^[.-]+|[.-]+$", "", cleaned)[:MAX_NAME]
    return f"{cleaned or 'data-source'}-filtered.csv"


# --- written tables -------------------------------------------------------

def write_points(table: PointTable, path: str, files: int | None = None) -> PointTable:
    """Write a load as Parquet, laid out by map cell, and read it back.

    Neighbours share files, so rectangles and boxes skip most of them. Hot cells are
    split by row id, and the cell itself is kept as ``grid_cell``.
    """
    cell = unique_name("grid_cell", table.df.columns)
    placed = table.df.withColumn(cell, world_cell(table))
    keys = [F.col(quote(cell)), table.col(table.row)]
    laid = placed.repartitionByRange(files, *keys) if files else placed.repartitionByRange(*keys)
    laid.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)
    return table.with_df(table.df.sparkSession.read.parquet(path))


def save_joined(left: PointTable, right: PointTable, options: JoinOptions, path: str, time_field: str = "") -> PointTable:
    """Write a join as a table of its own; later changes of its inputs do not reach it."""
    join_guard(join_report(left, right, options), options)
    schema = join_schema(left, right, options)
    lon, lat = (next(n for s, c, n, _ in schema if s == "left" and c == source and n.endswith(suffix))
                for source, suffix in ((left.lon, "@longitude"), (left.lat, "@latitude")))
    time = pick_time_field(left.fields, time_field or left.time_field)
    carried = next((n for s, c, n, k in schema if s == "left" and c == time and k == DATE), "")
    fields = tuple(Field(n, k) for _, _, n, k in schema)
    # Left order, then right order; unmatched left rows come where they stand.
    placed = placed_join_rows(left, right, options, "row_id")
    placed.select("row_id", F.concat(F.lit("joined."), F.col("row_id").cast("string")).alias("point_id"),
                  *[F.col(quote(f.name)) for f in fields]).write.mode("errorifexists").options(**JOINED_OPTIONS).parquet(path)
    saved = left.df.sparkSession.read.parquet(path)
    return PointTable(saved, fields, "row_id", "point_id", lon, lat, "Joined", carried)
