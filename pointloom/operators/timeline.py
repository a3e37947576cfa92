"""Time extents of tables and the choice of a time attribute."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import iso_from_millis, parse_utc
from ..table import DATE, STRING, Field, PointTable


def time_column(table: PointTable, field: str) -> Column:
    """A date attribute, or a text attribute read as time."""
    kind = table.field(field).kind
    if kind not in (DATE, STRING):
        raise ValueError("A timeline needs a time attribute")
    return table.col(field).cast("timestamp") if kind == DATE else parse_utc(table.col(field))


def timeline_extent(table: PointTable, field: str) -> DataFrame:
    """First and last time in epoch milliseconds, and how many rows have one."""
    at = F.unix_millis(time_column(table, field))
    return table.df.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(at).alias("valid"),
                        F.count_if(at.isNull()).alias("missing"))


def union_extents(extents: Sequence[DataFrame]) -> DataFrame:
    """The extent that covers every table with times; missing rows add up over all."""
    timed = reduce(DataFrame.unionByName, extents)
    return timed.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("valid").alias("valid"),
                     F.sum("missing").alias("missing"))


def pick_time_field(fields: Sequence[Field], configured: str = "") -> str:
    """The configured attribute, its part after the last colon, or the only date."""
    names = [f.name for f in fields]
    if configured:
        local = configured.split(":")[-1]
        return configured if configured in names else local if local in names else ""
    dates = [f.name for f in fields if f.kind == DATE]
    return dates[0] if len(dates) == 1 else ""


def relative_window(hours: float, now: datetime | None = None) -> tuple[str, str]:
    """The last hours up to ``now`` as a pair of ISO literals."""
    now = now or datetime.now(timezone.utc)
    end = (now.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
    return iso_from_millis(end - round(hours * 3600000)), iso_from_millis(end)
