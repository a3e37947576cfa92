"""Picking points on the map: grid groups, rectangles, circles and viewports.

Positions are Web-Mercator shares of the unit square. Tables written with a grid cell
column let Spark skip the files a rectangle cannot touch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import mercator_x, mercator_y
from ..session import checkpoint, hint_if_small
from ..table import PointTable, quote

# Fixed values.
GRID = 32
TILE = 512
MIN_PICK_SIZE, PICK_SLACK = 6, 3
FULL_SCAN_SHARE = 0.5

#: Degrees, and map shares at the edges, that rounding never exceeds.
DEGREE_SLACK = 1e-6


def positions(table: PointTable) -> tuple[Column, Column]:
    return mercator_x(table.col(table.lon)), mercator_y(table.col(table.lat))


def world_size(zoom: float) -> float:
    """Pixels of the whole world at a zoom level."""
    return TILE * 2.0 ** zoom


def with_grid_cell(table: PointTable, page: Sequence[str] = ()) -> DataFrame:
    """Add ``x``, ``y`` and the grid cell of each row within the bounds of its page.

    The bounds of the whole table are four numbers and become literals. Bounds per page
    come back by a join on the page and not by a window, so that one big page never
    becomes one task; they are broadcast only after they have been counted.
    """
    x, y = positions(table)
    placed = table.df.select("*", x.alias("x"), y.alias("y"))
    ends = [F.min("x").alias("__x0"), F.min("y").alias("__y0"), F.max("x").alias("__x1"), F.max("y").alias("__y1")]
    if page:
        bounds = checkpoint(placed.groupBy(*[F.col(quote(p)) for p in page]).agg(*ends))
        placed = placed.join(hint_if_small(bounds, bounds.count()), list(page))
        low_high = {c: (F.col(f"__{c}0"), F.col(f"__{c}1")) for c in "xy"}
    else:
        found = placed.agg(*ends).first()
        low_high = {c: (F.lit(found[f"__{c}0"]).cast("double"), F.lit(found[f"__{c}1"]).cast("double")) for c in "xy"}

    def step(c: str) -> Column:
        low, high = low_high[c]
        span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        return F.least(F.lit(GRID - 1), F.floor((F.col(c) - low) / span * GRID).cast("int"))

    return placed.withColumn("grid_cell", step("y") * GRID + step("x")).drop("__x0", "__y0", "__x1", "__y1")


def grid_groups(table: PointTable, page: Sequence[str] = ()) -> DataFrame:
    """Rows and true bounds of every occupied grid cell, per page."""
    return _groups(with_grid_cell(table, page), page)


def _groups(cells: DataFrame, page: Sequence[str]) -> DataFrame:
    return (cells.groupBy(*[F.col(quote(p)) for p in page], "grid_cell")
            .agg(F.count(F.lit(1)).alias("count"), F.min("x").alias("x0"), F.min("y").alias("y0"),
                 F.max("x").alias("x1"), F.max("y").alias("y1")))


def world_cell(table: PointTable) -> Column:
    """A fixed 32 × 32 cell of the whole world, for laying out files."""
    x, y = positions(table)
    step = lambda v: F.least(F.lit(GRID - 1), F.floor(v * GRID).cast("int"))
    return step(y) * GRID + step(x)


def world_cells(left: float, top: float, right: float, bottom: float) -> list[int]:
    """Fixed cells that a rectangle touches; never more than 1,024."""
    clip = lambda v: max(0, min(GRID - 1, int(v * GRID // 1)))
    return [r * GRID + c for r in range(clip(top), clip(bottom) + 1) for c in range(clip(left), clip(right) + 1)]


def _latitude(y: float) -> float:
    """The latitude at a map position; the map's edges stand for all that is clamped to them."""
    if y <= DEGREE_SLACK or y >= 1 - DEGREE_SLACK:
        return 90.0 if y < 0.5 else -90.0
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y))))


def rectangle_predicate(table: PointTable, left: float, top: float, right: float, bottom: float,
                        cell_column: str | None = None) -> Column:
    """Inclusive rectangle on map positions; a stored cell column prunes files first."""
    x, y = positions(table)
    # Degrees with a little slack come first: bare columns against literals reach the files.
    west, east = ((v - 0.5) * 360 for v in (left, right))
    north, south = (_latitude(v) for v in (top, bottom))
    near = (table.col(table.lon).between(west - DEGREE_SLACK, east + DEGREE_SLACK)
            & table.col(table.lat).between(south - DEGREE_SLACK, north + DEGREE_SLACK))
    inside = near & x.between(left, right) & y.between(top, bottom)
    if cell_column:
        inside = F.col(quote(cell_column)).isin(*world_cells(left, top, right, bottom)) & inside
    return inside


def pick_rectangle(table: PointTable, left: float, top: float, right: float, bottom: float,
                   predicate: Column | None = None, visible: Column | None = None,
                   cell_column: str | None = None) -> DataFrame:
    """Selected, visible rows inside a map rectangle."""
    test = rectangle_predicate(table, left, top, right, bottom, cell_column)
    for extra in (predicate, visible):
        if extra is not None:
            test = test & extra
    return table.df.where(test).select(table.col(table.row).alias("row"))


def pick_radius(table: PointTable, x: float, y: float, zoom: float, point_size: float = 6,
                predicate: Column | None = None, visible: Column | None = None,
                cell_column: str | None = None) -> DataFrame:
    """All rows drawn within reach of a map position, coincident ones included."""
    world = world_size(zoom)
    radius = max(MIN_PICK_SIZE, point_size) / 2 + PICK_SLACK
    margin = radius / world
    px, py = positions(table)
    near = rectangle_predicate(table, x - margin, y - margin, x + margin, y + margin, cell_column)
    test = near & (F.hypot((px - F.lit(x)) * world, (py - F.lit(y)) * world) <= radius)
    for extra in (predicate, visible):
        if extra is not None:
            test = test & extra
    return table.df.where(test).select(table.col(table.row).alias("row"))


def viewport_groups(groups: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Grid groups whose true bounds meet a view; a view over half the data takes all."""
    whole = Window.partitionBy()
    x0, y0 = F.min("x0").over(whole), F.min("y0").over(whole)
    x1, y1 = F.max("x1").over(whole), F.max("y1").over(whole)
    overlap = (F.greatest(F.lit(0.0), F.least(F.lit(right), x1) - F.greatest(F.lit(left), x0))
               * F.greatest(F.lit(0.0), F.least(F.lit(bottom), y1) - F.greatest(F.lit(top), y0)))
    everything = overlap >= (x1 - x0) * (y1 - y0) * FULL_SCAN_SHARE
    meets = (F.col("x0") <= right) & (F.col("x1") >= left) & (F.col("y0") <= bottom) & (F.col("y1") >= top)
    return (groups.withColumn("__all", everything).withColumn("__some", overlap > 0)
            .where(F.col("__all") | (F.col("__some") & meets)).drop("__all", "__some"))


def viewport_rows(table: PointTable, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Rows whose grid group meets the view: what a map has to draw."""
    cells = with_grid_cell(table)
    # At most 1,024 groups, so the window over them and the broadcast are bounded.
    shown = viewport_groups(_groups(cells, ()), left, top, right, bottom).select("grid_cell")
    return (cells.join(F.broadcast(shown), "grid_cell", "left_semi")
            .select(table.col(table.row).alias("row"), "grid_cell"))
