"""Dense positions in a global order, without passing everything through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint, hint_if_small


def _fixed(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows in order with ``__part``, the number of their partition, and ``__at``, their place in it.

    The rows are range-partitioned and sorted per partition, then fixed by a
    checkpoint, because range boundaries are sampled anew on every run.
    """
    ordered = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn("__at", F.monotonically_increasing_id()))
    return checkpoint(ordered.withColumn("__part", F.shiftright("__at", 33))
                      .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))))


def _with_start(fixed: DataFrame, size: Column) -> DataFrame:
    """Add ``__start``, the sum of ``size`` over the partitions before."""
    # One row per partition: a bounded table, so one window task is enough.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (fixed.groupBy("__part").agg(size.alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    starts = hint_if_small(starts, int(fixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fixed.join(starts, "__part")


def with_position(df: DataFrame, keys: Sequence[Column], name: str = "position", weight: Column | None = None) -> DataFrame:
    """Number rows 0, 1, 2, … in the order of ``keys``, which should be unique.

    Each row's position is its place in its range partition plus the rows of the partitions
    before. With a ``weight``, a row takes that many numbers and its position is the first of them.
    """
    fixed = _fixed(df, keys)
    if weight is None:
        placed, size = fixed, F.count(F.lit(1))
    else:
        earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        placed, size = fixed.withColumn("__at", F.coalesce(F.sum(weight).over(earlier), F.lit(0))), F.sum(weight)
    return (_with_start(placed, size)
            .withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at"))


def with_rank(df: DataFrame, key: Column, name: str = "rank") -> DataFrame:
    """Number rows in the order of ``key``; rows with equal keys share the number of the first of them."""
    fixed = _fixed(df.withColumn("__key", key), [F.col("__key")])
    # Equal keys lie in one partition, side by side.
    order = Window.partitionBy("__part").orderBy("__at")
    runs = fixed.withColumn("__ahead", F.last("__key").over(order.rowsBetween(-1, -1)))
    same = F.coalesce(F.col("__key") == F.col("__ahead"), F.lit(False))
    runs = runs.withColumn("__new", F.when(~same, F.col("__at"))).drop("__ahead")
    return (_with_start(runs, F.count(F.lit(1)))
            .withColumn("__first", F.max("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn(name, F.col("__start") + F.col("__first")).drop("__part", "__start", "__at", "__key", "__new", "__first"))
