"""Restrictions applied while loading: a time range and a box."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.values import parse_utc_millis
from ..operators.expressions import timestamp


@dataclass(frozen=True)
class LoadBounds:
    """Inclusive time range as ISO literals and an inclusive box ``(west, south, east, north)``."""

    time: tuple[str, str] | None = None
    box: tuple[float, float, float, float] | None = None

    def millis(self) -> tuple[int, int]:
        start, end = (parse_utc_millis(t) for t in self.time)
        if start is None or end is None or start >= end:
            raise ValueError("A time range needs two times, the earlier one first")
        return start, end

    def check(self) -> "LoadBounds":
        if self.time is not None:
            self.millis()
        if self.box is not None:
            west, south, east, north = self.box
            if not all(map(math.isfinite, self.box)) or west < -180 or east > 180 or west > east \
                    or south < -90 or north > 90 or south > north:
                raise ValueError("Invalid map area bounds.")
        return self


def bound_time(c: Column, bounds: LoadBounds) -> Column:
    """Times inside the inclusive range; a missing time gives null."""
    start, end = bounds.millis()
    c = c.cast("timestamp")
    return (c >= timestamp(start)) & (c < timestamp(end + 1))


def bound_box(lon: Column, lat: Column, bounds: LoadBounds) -> Column:
    """Coordinates inside the inclusive box."""
    west, south, east, north = bounds.box
    return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)
