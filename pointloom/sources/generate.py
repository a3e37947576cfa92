"""Deterministic observations from integer hashes of a row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..table import Field, PointTable

# Hash multipliers, seeds, labels and areas (west, width, south, height).
MULTIPLIERS = (0x7feb352d, 0x846ca68b)
SEED_LON, SEED_LAT, SEED_VALUE, SEED_TIME, SEED_QUALITY = 1, 123456789, 999, 424242, 88
CATEGORIES = ("sensor", "vehicle", "station", "event")
STATUSES = ("active", "inactive", "warning")
EPOCH_MS, SPAN_MS = 1704067200000, 94694400000
AREAS = {"uk": (-8.0, 10.0, 50.0, 9.0), "world": (-179.0, 358.0, -70.0, 140.0), "dense": (-1.55, 0.02, 53.99, 0.02)}

WORD = 0xFFFFFFFF


def _times(n: Column, factor: int) -> Column:
    """Low 32 bits of a product, in 16-bit halves so that nothing overflows."""
    high, low = F.shiftrightunsigned(n, 16), n.bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft((high * factor).bitwiseAND(F.lit(0xFFFF)), 16) + low * factor).bitwiseAND(F.lit(WORD))


def unit_hash(n: Column) -> Column:
    """A row number to a repeatable value in [0, 1)."""
    n = n.cast("bigint").bitwiseAND(F.lit(WORD))
    n = _times(n.bitwiseXOR(F.shiftrightunsigned(n, 16)), MULTIPLIERS[0])
    n = _times(n.bitwiseXOR(F.shiftrightunsigned(n, 15)), MULTIPLIERS[1])
    return n.bitwiseXOR(F.shiftrightunsigned(n, 16)).cast("double") / F.lit(4294967296.0)


def observations(numbers: DataFrame, number: Column, distribution: str = "uk") -> DataFrame:
    """Observations for any DataFrame of row numbers; a narrow projection."""
    west, width, south, height = AREAS.get(distribution, AREAS["uk"])
    i = number.cast("bigint")
    pick = lambda labels: F.element_at(F.array(*[F.lit(v) for v in labels]), (i % len(labels) + 1).cast("int"))
    rounded = lambda v: F.floor(v + F.lit(0.5))
    return numbers.select(
        i.alias("row_id"), F.concat(F.lit("points."), i.cast("string")).alias("point_id"),
        (F.lit(west) + unit_hash(i + SEED_LON) * F.lit(width)).alias("lon"),
        (F.lit(south) + unit_hash(i + SEED_LAT) * F.lit(height)).alias("lat"),
        i.cast("double").alias("id"), pick(CATEGORIES).alias("category"), pick(STATUSES).alias("status"),
        (rounded(unit_hash(i + SEED_VALUE) * 10000) / F.lit(100.0)).cast("double").alias("value"),
        F.timestamp_millis(F.lit(EPOCH_MS) + F.floor(unit_hash(i + SEED_TIME) * F.lit(float(SPAN_MS)))).alias("timestamp"),
        (i % 3 != 1).alias("active"), F.concat(F.lit("source-"), (i % 16).cast("string")).alias("source"),
        rounded(unit_hash(i + SEED_QUALITY) * 100).cast("double").alias("quality"))


FIELDS = (Field("id", "number"), Field("category", "string"), Field("status", "string"), Field("value", "number"),
          Field("timestamp", "date"), Field("active", "boolean"), Field("source", "string"), Field("quality", "number"))


def observation_table(df: DataFrame, name: str = "points") -> PointTable:
    return PointTable(df, FIELDS, name=name, time_field="timestamp")


def generate_points(spark: SparkSession, count: int, distribution: str = "uk") -> PointTable:
    """The first ``count`` generated observations."""
    if isinstance(count, bool) or not isinstance(count, int) or count < 0:
        raise ValueError("Expected a whole number of points")
    return observation_table(observations(spark.range(count), F.col("id"), distribution))
