"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pointloom.session import checkpoint


#: Edges that one task of a round may hold.
TASK_EDGES = 50_000


def _stars(edges: DataFrame, small: bool, parts: int) -> DataFrame:
    """Hang the neighbours of every node (its smaller ones and itself, or its larger ones) on the least of them."""
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = around.groupBy(F.col("u").alias("l_u")).agg(F.min("v").alias("m"))
    hung = around.join(least.withColumn("m", F.least("m", "l_u")), F.col("u") == F.col("l_u"))
    if small:
        pairs = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(hung.select(F.col("u"), F.col("m")))
    else:
        pairs = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return pairs.where(F.col("a") != F.col("b")).coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node that has an edge (a, b) to another.

    Each round is two passes of joins on nodes; a round's edges are checkpointed. Nothing but a count
    and a checksum comes to the driver; the count also says how many tasks the next round is worth,
    so that a small graph does not leave a file for every shuffle partition at every step. The number
    of rounds grows with the logarithm of the graph.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = checkpoint(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        parts = min(most, state["n"] // TASK_EDGES + 1)
        now = checkpoint(_stars(checkpoint(_stars(now.coalesce(parts), False, parts)), True, parts))
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.union(now.select(F.col("b"), F.col("b")).distinct())
