"""Axis scales: logarithms, padded bounds and normalised positions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .values import MAX_DOUBLE, MIN_DOUBLE, clamp

LINEAR, LOG10 = "linear", "log10"


def check_scale(scale: str) -> str:
    if scale not in (LINEAR, LOG10):
        raise ValueError("Invalid axis scale")
    return scale


def log10_scale(v: Column) -> Column:
    """Base-10 logarithm; zero and negative values are missing."""
    return F.when(v > 0, F.log10(v))


def unlog10(v: Column) -> Column:
    """Inverse of :func:`log10_scale`, held inside the positive double range."""
    return clamp(F.pow(F.lit(10.0), v), MIN_DOUBLE, MAX_DOUBLE)


def on_scale(v: Column, scale: str) -> Column:
    return log10_scale(v) if scale == LOG10 else v


def scale_value(v: float, scale: str) -> float:
    """Driver-side twin of :func:`on_scale`; NaN when the value has no position."""
    if scale == LOG10:
        return math.log10(v) if v > 0 else math.nan
    return v


def unscale_value(v: float, scale: str) -> float:
    if scale != LOG10:
        return v
    try:
        return max(MIN_DOUBLE, min(MAX_DOUBLE, 10.0 ** v))
    except OverflowError:
        return MAX_DOUBLE


@dataclass(frozen=True)
class _AxisRule:
    """What an axis shows without a domain, the range it can show, and how one value becomes an interval."""

    empty: tuple[float, float]
    reach: tuple[float, float]
    around: Callable[[float], tuple[float, float]]

    def held(self, bound: float) -> float:
        return sorted((self.reach[0], bound, self.reach[1]))[1]


def _beside(margin: Callable[[float], float]) -> Callable[[float], tuple[float, float]]:
    return lambda v: (v - margin(v), v + margin(v))


#: A second beside a lone time, a twentieth (one at least) beside a lone number, half a decade on a logarithmic axis.
_AXIS_RULES = {
    (LINEAR, False): _AxisRule((0.0, 1.0), (-MAX_DOUBLE, MAX_DOUBLE), _beside(lambda v: max(abs(v) / 20, 1.0))),
    (LINEAR, True): _AxisRule((0.0, 1.0), (-MAX_DOUBLE, MAX_DOUBLE), _beside(lambda v: 1000.0)),
    (LOG10, False): _AxisRule((1.0, 10.0), (MIN_DOUBLE, MAX_DOUBLE), lambda v: (v / math.sqrt(10), v * math.sqrt(10))),
}


def axis_bounds(low: float | None, high: float | None, scale: str = LINEAR, date: bool = False) -> tuple[float, float]:
    """Bounds of an unbinned axis. A domain of one value is widened to both sides; without a domain a default stands in."""
    rule = _AXIS_RULES[scale, date and scale != LOG10]
    placed = [v for v in (low, high) if v is not None and math.isfinite(scale_value(v, scale))]
    if len(placed) < 2:
        return rule.empty
    if len(set(placed)) == 2:
        return placed[0], placed[1]
    least, most = rule.around(placed[0])
    return rule.held(least), rule.held(most)


def normalize_axis(v: Column, low: float, high: float) -> Column:
    """Position in [-1, 1] between two bounds, safe when their distance overflows."""
    if low == high:
        return F.when(v.isNotNull(), F.lit(0.0))
    width = high - low
    if math.isfinite(width):
        share = (v - F.lit(low)) / F.lit(width)
    else:
        share = (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    return share * 2 - 1
