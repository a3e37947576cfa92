"""Uncertainty ellipses: axis conversion, outlines on the sphere, thinning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import EARTH_RADIUS, NAUTICAL_MILE, clamp_latitude, mercator_x, mercator_y
from ..functions.values import clamp, to_number
from ..table import STRING, PointTable
from .ordering import with_position

# Fixed values.
UNITS = {"m": 1.0, "nm": NAUTICAL_MILE}
ASPECT_BUCKETS, MAX_ASPECT_LOG2, CDF_STEPS = 64, 10, 4096
MIN_VERTICES, MAX_VERTICES = 4, 128
MIN_BUDGET, PIXELS_PER_OUTLINE = 2000, 100


@dataclass(frozen=True)
class EllipseConfig:
    """Attributes that hold the axes and the orientation in degrees from north."""

    major: str
    minor: str
    orientation: str
    major_unit: str = "m"
    minor_unit: str = "m"

    def __post_init__(self):
        chosen = [bool(v) for v in (self.major, self.minor, self.orientation)]
        if any(chosen) and not all(chosen):
            raise ValueError("Ellipses need both axes and an angle, or none of them")
        if self.major_unit not in UNITS or self.minor_unit not in UNITS:
            raise ValueError(f"Units of ellipse axes are {UNITS}")


def _axes(table: PointTable, config: EllipseConfig) -> tuple[Column, Column, Column, Column]:
    """Axes in metres, angle, and whether they make an ellipse."""
    known = {f.name for f in table.fields}

    def number(name: str) -> Column:
        if name not in known:
            return F.lit(None).cast("double")
        c = table.col(name)
        return to_number(c) if table.field(name).kind == STRING else c.cast("double")

    a = number(config.major) * F.lit(UNITS[config.major_unit])
    b = number(config.minor) * F.lit(UNITS[config.minor_unit])
    angle = number(config.orientation)
    longest = F.lit(math.pi * EARTH_RADIUS)
    valid = F.coalesce((a > 0) & (b > 0) & (a <= longest) & (b <= longest) & angle.isNotNull(), F.lit(False))
    return a, b, angle, valid


def has_ellipse(table: PointTable, config: EllipseConfig) -> Column:
    """Whether a row's attributes make an ellipse."""
    return _axes(table, config)[3]


def ellipse_params(table: PointTable, config: EllipseConfig) -> DataFrame:
    """Axes in metres and orientation of every row; invalid ones stay as nulls.

    Reversed axes are swapped and turned a quarter, so the directions are kept.
    An attribute that the table lacks leaves no row valid.
    """
    a, b, angle, valid = _axes(table, config)
    turned = F.when(b > a, angle + 90).otherwise(angle)
    return table.df.select(
        table.col(table.row).alias("row"), table.col(table.lon).alias("lon"), table.col(table.lat).alias("lat"),
        F.when(valid, F.greatest(a, b)).alias("major_m"), F.when(valid, F.least(a, b)).alias("minor_m"),
        F.when(valid, F.pmod(turned, F.lit(360.0))).alias("angle"), valid.alias("valid"))


def invalid_ellipses(params: DataFrame) -> DataFrame:
    return params.agg(F.count_if(~F.col("valid")).alias("invalid"))


def ellipse_samples(vertices: int, aspect: float) -> np.ndarray:
    """Unit-circle vertices, denser where an ellipse of this aspect bends more.

    The density of samples is one over the square root of the speed along the curve;
    the sample angles are equal steps of its cumulative sum.
    """
    if isinstance(vertices, bool) or not isinstance(vertices, int) or not MIN_VERTICES <= vertices <= MAX_VERTICES:
        raise ValueError(f"An outline has {MIN_VERTICES} to {MAX_VERTICES} vertices")
    ratio = min(2.0 ** MAX_ASPECT_LOG2, max(1.0, aspect))
    middles = (np.arange(CDF_STEPS) + 0.5) * (2 * np.pi / CDF_STEPS)
    density = 1 / np.sqrt(np.hypot(ratio * np.sin(middles), np.cos(middles)))
    total = np.concatenate([[0.0], np.cumsum(density)])
    angles = np.interp(total[-1] * np.arange(vertices) / vertices, total, np.linspace(0, 2 * np.pi, CDF_STEPS + 1))
    return np.column_stack([np.cos(angles), np.sin(angles)])


def ellipse_templates(table: PointTable, vertices: int) -> DataFrame:
    """Vertices for 64 aspect buckets up to 1024:1; a fixed table of 64 rows."""
    rows = [(k, ellipse_samples(vertices, 2 ** (k * MAX_ASPECT_LOG2 / (ASPECT_BUCKETS - 1))).tolist())
            for k in range(ASPECT_BUCKETS)]
    return table.df.sparkSession.createDataFrame(rows, "bucket int, units array<array<double>>")


def ellipse_outlines(table: PointTable, config: EllipseConfig, vertices: int = 32) -> DataFrame:
    """Map positions along the outline of every valid row: ``row, vertex, x, y``.

    Rows fan out by the fixed vertex count and never meet again, so nothing shuffles;
    each step below is a projection that reuses the columns of the one before.
    """
    params = ellipse_params(table, config).where("valid")
    aspect = F.least(F.lit(float(MAX_ASPECT_LOG2)), F.log2(F.col("major_m") / F.col("minor_m")))
    bucket = F.round(aspect * (ASPECT_BUCKETS - 1) / MAX_ASPECT_LOG2).cast("int")
    placed = params.select("row", "lon", bucket.alias("bucket"), F.radians(clamp_latitude(F.col("lat"))).alias("phi"),
                           F.radians("angle").alias("turn"), (F.col("major_m") / EARTH_RADIUS).alias("a"),
                           (F.col("minor_m") / EARTH_RADIUS).alias("b"))
    spread = (placed.join(F.broadcast(ellipse_templates(table, vertices)), "bucket")
              .select("row", "lon", "phi", "turn", "a", "b", F.posexplode("units").alias("vertex", "u")))
    major, minor = F.col("a") * F.col("u")[0], F.col("b") * F.col("u")[1]
    offset = spread.select("row", "vertex", "lon", "phi",
                           (major * F.sin("turn") + minor * F.cos("turn")).alias("east"),
                           (major * F.cos("turn") - minor * F.sin("turn")).alias("north"))
    reached = offset.withColumn("reach", F.hypot("east", "north"))
    reached = reached.withColumn("sinc", F.when(F.col("reach") < 1e-8, F.lit(1.0)).otherwise(F.sin("reach") / F.col("reach")))
    sine = F.sin("phi") * F.cos("reach") + F.cos("phi") * F.col("north") * F.col("sinc")
    turn = F.atan2(F.col("east") * F.col("sinc"), F.cos("phi") * F.cos("reach") - F.sin("phi") * F.col("north") * F.col("sinc"))
    ends = reached.select("row", "vertex", (mercator_x(F.col("lon")) + turn / (2 * math.pi)).alias("x"), sine.alias("sine"))
    ends = ends.withColumn("end", F.degrees(F.asin(clamp(F.col("sine"), -1.0, 1.0))))
    return ends.select("row", "vertex", "x", mercator_y(F.col("end")).alias("y"))


def thinning_stride(candidates: int, width: int, height: int) -> int:
    """Rows per drawn outline for a screen; 1 while the budget suffices."""
    budget = max(MIN_BUDGET, width * height // PIXELS_PER_OUTLINE)
    return max(1, -(-candidates // budget))


def stride_sample(table: PointTable, stride: int) -> DataFrame:
    """One row per block of ``stride`` rows in load order, at a hashed place in its block.

    Opt-in thinning of outlines only; points are never thinned. The hash keeps
    periodic inputs from always showing the same category.
    """
    if stride < 1:
        raise ValueError("Stride must be at least 1")
    # Only the ids are put in order; the chosen rows are then looked up.
    ordered = with_position(table.df.select(table.col(table.row).alias("__row")), [F.col("__row")], "__ordinal")
    last = ordered.agg(F.max("__ordinal")).first()[0]
    block = F.floor(F.col("__ordinal") / stride)
    word = F.lit(0xFFFFFFFF)
    h = block.bitwiseXOR(F.shiftrightunsigned(block, 16)).bitwiseAND(word)
    low, high = h.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(h, 16)
    factor = 0x7feb352d  # fixed value
    h = (F.shiftleft((high * factor).bitwiseAND(F.lit(0xFFFF)), 16) + low * factor).bitwiseAND(word)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 15))
    # The last block may be short of its chosen row; then its last row stands in.
    chosen = F.least(block * stride + (h % stride if stride > 1 else F.lit(0)), F.lit(last))
    kept = ordered.where(F.col("__ordinal") == chosen).select("__row")
    return table.df.join(kept, table.col(table.row) == F.col("__row"), "left_semi")
