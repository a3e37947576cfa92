"""Exact top-k by inner product with a KD-tree for each shard.

Vectors are dealt to shards by a hash. A shard's tree splits at the median of its widest dimension and
keeps the tight box of every node. Queries travel to the shards in blocks of bounded size. In a shard a
query visits nodes best first: by the largest inner product that any point of the node's box could
have. It stops when that falls below its k-th score. The first shard a query sees gives it a k-th
score that goes with it to all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointloom.session import checkpoint

SCALE = 1024.0
#: Vectors in a shard and queries in a block, about; vectors in a leaf at most.
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
LEAF = 64
_LARGEST = 2 ** 63 - 1


@dataclass
class Tree:
    """Vectors in the order of the leaves; for each node first, end and both children (-1: a leaf); lower and upper corner."""

    ids: np.ndarray
    points: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    order, nodes, low, high = np.arange(len(ids)), [], [], []
    stack = [(0, len(ids), -1, 0)]  # first, end, parent, side
    while stack:
        first, end, parent, side = stack.pop()
        here = points[order[first:end]]
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([first, end, -1, -1])
        low.append(here.min(axis=0))
        high.append(here.max(axis=0))
        spread = high[-1] - low[-1]
        if end - first > leaf and spread.size and spread.max() > 0:
            half = (end - first) // 2
            by = np.argpartition(here[:, int(spread.argmax())], half)
            order[first:end] = order[first:end][by]
            stack += [(first, first + half, len(nodes) - 1, 0), (first + half, end, len(nodes) - 1, 1)]
    return Tree(ids[order], points[order], np.array(nodes, np.int32), np.array(low), np.array(high))


def _exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers in a type in which sums of their products are exact."""
    most = max(1.0, np.abs(points).max(initial=0)) * max(1.0, np.abs(queries).max(initial=0)) * max(1, points.shape[1])
    if most < 2 ** 53:
        return points, queries
    whole = np.frompyfunc(int, 1, 1)
    return whole(points), whole(queries)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: list[int | None]) -> Iterator[tuple[int, int, int]]:
    """(place of the query, vector id, score) of what can be among each query's best k, given a k-th score from elsewhere."""
    points, queries = _exact(tree.points, queries)
    low, high = (np.frompyfunc(int, 1, 1)(x) if points.dtype == object else x for x in (tree.low, tree.high))
    reach = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    nodes = tree.nodes.tolist()
    for q, own in enumerate(query_ids.tolist()):
        best: list[tuple[int, int]] = []  # the least of the best k first: (score, -id)
        floor = bounds[q]
        ahead = [(-reach[q, 0], 0)]
        ub = reach[q].tolist()
        while ahead:
            far, at = heapq.heappop(ahead)
            if floor is not None and -far < floor:
                break
            first, end, left, right = nodes[at]
            if left >= 0:
                heapq.heappush(ahead, (-ub[left], left))
                heapq.heappush(ahead, (-ub[right], right))
                continue
            scores = points[first:end] @ queries[q]
            near = range(end - first) if floor is None else np.flatnonzero(scores >= floor).tolist()
            for i in near:
                vec = int(tree.ids[first + i])
                if vec == own:
                    continue
                entry = (max(-_LARGEST - 1, min(_LARGEST, int(scores[i]))), -vec)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
        for score, vec in best:
            yield q, -vec, score


def _valid(column: Column) -> Column:
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(2.0 ** 1000)), F.lit(False))
    return column.isNotNull() & F.forall(column, fits)


def _build_shard(table: pa.Table) -> pa.Table:
    n = len(table)
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    tree = build(table.column("vec_id").to_numpy(), np.floor(flat * SCALE).reshape(n, -1))
    # Corners follow from the points; small numbers are kept small.
    kind = next(t for t in ("<i2", "<i4", "<f8") if t == "<f8" or np.abs(tree.points).max(initial=0) <= np.iinfo(t).max)
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "n": pa.array([n], pa.int32()),
                     "ids": pa.array([tree.ids.astype("<i8").tobytes()], pa.binary()), "kind": pa.array([kind]),
                     "points": pa.array([tree.points.astype(kind).tobytes()], pa.binary()), "nodes": pa.array([tree.nodes.astype("<i4").tobytes()], pa.binary())})


def _load(row: dict) -> Tree:
    points = np.frombuffer(row["points"], row["kind"]).astype(np.float64).reshape(row["n"], -1)
    nodes = np.frombuffer(row["nodes"], "<i4").reshape(-1, 4)
    low, high = (np.empty((len(nodes), points.shape[1])) for _ in range(2))
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
        first, end, left, right = nodes[i]
        if left < 0:
            low[i], high[i] = points[first:end].min(axis=0), points[first:end].max(axis=0)
        else:
            low[i], high[i] = np.minimum(low[left], low[right]), np.maximum(high[left], high[right])
    return Tree(np.frombuffer(row["ids"], "<i8"), points, nodes, low, high)


def _search_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one shard and one block of queries at a time
                row = batch.slice(i, 1).to_pylist()[0]
                asked = row["queries"]
                queries = np.floor(np.array([q["v"] for q in asked], np.float64).reshape(len(asked), -1) * SCALE)
                ids = np.array([q["vec_id"] for q in asked], np.int64)
                found = list(search(_load(row), ids, queries, k, [q["bound"] for q in asked]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[[f[0] for f in found]], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                    names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by inner product of floor(1024 * x).

    Ties go to the smaller id. ``is_query`` is a condition on the id column. Rows with a null id, a null
    vector, or a null, non-finite or unscalable (2^1000 and more) component take no part. Only vectors
    of one length meet. Rows that share a query's id are its own; an id that is repeated among the
    queries asks once, with its least vector. Scores beyond 64 bits count as
    the nearest 64-bit number. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & _valid(F.col("v"))).withColumn("dim", F.size("v"))
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(1, -(-count["n"] // shard_rows))
    blocks = max(1, -(-count["q"] // block_queries))
    dealt = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    index = checkpoint(dealt.groupBy("dim", "shard").applyInArrow(
        _build_shard, "dim int, shard int, n int, ids binary, kind string, points binary, nodes binary"))
    queries = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def ask(asked: DataFrame, where: Column) -> DataFrame:
        """Search the shards that ``where`` (an array of shard numbers) names for each block."""
        bundles = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v", "bound")).alias("queries"))
        sent = bundles.withColumn("shard", F.explode(where))
        return sent.join(index, ["dim", "shard"]).select("queries", "n", "ids", "kind", "points", "nodes").mapInArrow(
            _search_rows(k), "query_id long, vec_id long, score long")

    home = F.pmod(F.col("block"), F.lit(shards))
    first = checkpoint(ask(queries.withColumn("bound", F.lit(None).cast("long")), F.array(home)))
    # A query with k scores already carries the least of them.
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    bounded = queries.join(bounds, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "dim", "block", "bound")
    rest = ask(bounded, F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
