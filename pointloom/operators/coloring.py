"""Colouring rows by category or by bin, legends, and what the map shows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.colors import (COLOR_COUNT, DEFAULT_SCHEME, MISSING_COLOR, base_color, gradient_hex, hex_color,
                                is_hex_color)
from ..functions.scales import LINEAR, LOG10
from ..session import hint_if_small
from ..table import NUMBER, STRING, PointTable
from .axes import Axis, axis_for
from .ordering import with_position

# Fixed values.
MISSING_CODE = 255
MISSING_RGB = (128, 128, 128)
EMPTY_LABEL, MISSING_LABEL, MISSING_LOG_LABEL = "(empty string)", "Missing value", "Missing / non-positive value"


def category_palette(table: PointTable, name: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Every distinct value with its rank and colour: ``value, rank, color``.

    Colours depend on the sorted full domain only. A colour that is already taken by
    an earlier value moves on to the next free one.
    """
    c = table.col(name)
    values = table.df.where(c.isNotNull()).select(c.alias("value")).distinct()
    ranked = with_position(values, [F.col("value")], "rank").withColumn("code", base_color(F.col("rank")))
    colors = settle_codes(ranked)
    saved = [(v, color) for v, color in (overrides or {}).items() if is_hex_color(color)]
    shown = hex_color(F.col("code"))
    if saved:
        # Overrides are part of a saved analysis, so their number is bounded by its size.
        chosen = table.df.sparkSession.createDataFrame(saved, "value string, saved string")
        colors = colors.join(F.broadcast(chosen), "value", "left")
        shown = F.coalesce("saved", shown)
    return colors.select("value", "rank", shown.alias("color"))


def settle_codes(ranked: DataFrame) -> DataFrame:
    """Give clashing codes the next free one, earlier ranks first.

    Which codes end up taken does not depend on the order, so runs of taken codes follow
    from running sums over the codes asked for, on a circle. Values of one run are then
    placed by rank in one pass. Codes are at most 2^24, which bounds every run.
    """
    first = ranked.where(F.col("rank") < COLOR_COUNT)
    late = ranked.where(F.col("rank") >= COLOR_COUNT)
    asked = first.groupBy(F.col("code").cast("bigint").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    # Two laps, so that a run over the end of the circle is seen whole in the second.
    laps = asked.unionByName(asked.withColumn("at", F.col("at") + COLOR_COUNT))
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = laps.withColumn("before", F.sum("n").over(so_far) - F.col("n")).withColumn(
        "end", F.max(F.col("at") - F.col("before")).over(so_far) + F.col("before") + F.col("n"))
    starts = F.when(F.col("at") >= F.coalesce(F.lag("end").over(Window.orderBy("at")), F.lit(0)), F.col("at"))
    runs = (ends.withColumn("start", starts).withColumn("run", F.last("start", ignorenulls=True).over(so_far) % COLOR_COUNT)
            .where(F.col("at") >= COLOR_COUNT).select((F.col("at") - COLOR_COUNT).alias("base"), "run"))
    placed = first.join(runs, F.col("code") == F.col("base"))
    value = ranked.schema["value"].dataType.simpleString()

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        following: dict[int, int] = {}
        out = []
        for code in rows["code"].tolist():
            passed = []
            while code in following:
                passed.append(code)
                code = following[code]
            for p in passed:
                following[p] = code
            out.append(code)
            following[code] = (code + 1) % COLOR_COUNT
        return pd.DataFrame({"value": rows["value"], "rank": rows["rank"], "code": out})

    # Runs do not meet, so several can be placed in one go.
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = placed.groupBy(F.pmod(F.xxhash64("run"), F.lit(parts))).applyInPandas(settle, f"value {value}, rank bigint, code bigint")
    # Beyond 2^24 values there is no free colour left and clashes are allowed.
    return settled.unionByName(late.select("value", "rank", F.col("code").cast("bigint")))


def category_color(table: PointTable, name: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Colour of every row by its text value; missing values are grey."""
    if table.field(name).kind != STRING:
        raise ValueError(f"{name} is not text, so it has no category colours")
    palette = category_palette(table, name, overrides).select("value", "color")
    rows = table.df.select(table.col(table.row).alias("row"), table.col(name).alias("value"))
    palette = hint_if_small(palette, palette.count())
    return rows.join(palette, "value", "left").select("row", "value", F.coalesce("color", F.lit(MISSING_COLOR)).alias("color"))


def color_codes(table: PointTable, name: str, bins: int, scale: str = LINEAR) -> DataFrame:
    """Bin code of every row for a numeric ramp; 255 marks rows without a place."""
    if table.field(name).kind != NUMBER:
        raise ValueError(f"{name} is not a number, so it has no ramp")
    if isinstance(bins, bool) or not isinstance(bins, int) or not 2 <= bins <= 64:
        raise ValueError("Invalid colour bins")
    axis = axis_for(table, name, bins, scale)
    return table.df.select(table.col(table.row).alias("row"),
                           F.coalesce(axis.bin(table), F.lit(MISSING_CODE)).alias("code"))


def excluded_count(table: PointTable, name: str, scale: str = LINEAR) -> DataFrame:
    """Rows a logarithmic ramp cannot colour because they are not positive."""
    test = table.col(name) <= 0 if scale == LOG10 else F.lit(False)
    return table.df.agg(F.count_if(test).alias("excluded"))


def gradient_color(table: PointTable, name: str, bins: int, scale: str = LINEAR, scheme: str = DEFAULT_SCHEME) -> DataFrame:
    """Hex colour of every row on a ramp."""
    ramp = F.array(*[F.lit(c) for c in gradient_hex(scheme, bins)])
    codes = color_codes(table, name, bins, scale)
    shown = F.when(F.col("code") < MISSING_CODE, F.try_element_at(ramp, F.col("code") + 1))
    return codes.select("row", "code", F.coalesce(shown, F.lit(MISSING_COLOR)).alias("color"))


def visibility_key(table: PointTable, name: str, bins: int = 24, scale: str = LINEAR) -> Column:
    """The legend entry of each row: ``category:…``, ``bin:…`` or ``missing``."""
    kind = table.field(name).kind
    if kind == STRING:
        key = F.concat(F.lit("category:"), table.col(name))
    elif kind == NUMBER:
        key = F.concat(F.lit("bin:"), axis_for(table, name, bins, scale).bin(table).cast("string"))
    else:
        raise ValueError(f"{name} is neither a number nor text, so its rows cannot be hidden by colour")
    return F.coalesce(key, F.lit("missing"))


def map_visibility(table: PointTable, name: str, bins: int, hidden: Iterable[str], scale: str = LINEAR) -> DataFrame:
    """Whether each row is drawn. Selections and charts never look at this flag."""
    hidden = list(hidden)
    key = visibility_key(table, name, bins, scale)
    shown = ~key.isin(*hidden) if hidden else F.lit(True)
    return table.df.select(table.col(table.row).alias("row"), shown.alias("visible"))


# --- legends --------------------------------------------------------------

@dataclass(frozen=True)
class Coloring:
    """How one table is coloured; without a field all points share one colour."""

    field: str = ""
    bins: int = 24
    scale: str = LINEAR
    scheme: str = DEFAULT_SCHEME
    color: str = "#2463d4"
    overrides: Mapping[str, str] | None = None


def legend_table(table: PointTable, coloring: Coloring, source_id: str = "source") -> DataFrame:
    """Legend rows of one table: ``source_id, position, key, label, color``."""
    spark = table.df.sparkSession
    schema = "position bigint, key string, label string, color string"
    if not coloring.field:
        rows = spark.createDataFrame([(0, "all", "All points", coloring.color)], schema)
    elif table.field(coloring.field).kind == STRING:
        palette = category_palette(table, coloring.field, coloring.overrides)
        label = F.when(F.col("value") == "", F.lit(EMPTY_LABEL)).otherwise(F.col("value"))
        values = palette.select(F.col("rank").cast("bigint").alias("position"),
                                F.concat(F.lit("category:"), "value").alias("key"), label.alias("label"), "color")
        last = values.agg(F.count(F.lit(1)).alias("position")).select(
            "position", F.lit("missing").alias("key"), F.lit(MISSING_LABEL).alias("label"),
            F.lit(MISSING_COLOR).alias("color"))
        rows = values.unionByName(last)
    else:
        axis: Axis = axis_for(table, coloring.field, coloring.bins, coloring.scale)
        ramp = gradient_hex(coloring.scheme, coloring.bins)
        listed = [(i, f"bin:{i}", label, ramp[i]) for i, label in enumerate(axis.labels)]
        missing = MISSING_LOG_LABEL if coloring.scale == LOG10 else MISSING_LABEL
        rows = spark.createDataFrame([*listed, (len(listed), "missing", missing, MISSING_COLOR)], schema)
    return rows.select(F.lit(source_id).alias("source_id"), "*")
