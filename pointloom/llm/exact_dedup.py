"""Exact duplicates by content sort.

Rows are range-partitioned by sampled splitters over (first characters, digest, id), sorted inside
each partition by Spark's external sort, and compared with their neighbour in full. A group of copies
of any size is cut by id among as many partitions as it fills; the pieces meet again as one row per
piece. Texts travel in the sort only; what follows carries ids and digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointloom.llm.common import lower_az, text_of
from pointloom.session import checkpoint

#: Characters of a text that lead the sort; the digest and the whole text decide after them.
HEAD = 32


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts of one sorted partition, comparing whole neighbours."""
    last: pa.Array | None = None
    run = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("norm")
        start = [last is None or last[0] != texts[0]]
        if batch.num_rows > 1:
            start += pc.not_equal(texts[1:], texts[:-1]).to_pylist()
        last = pa.array([texts[-1].as_py()], texts.type)
        numbers = []
        for first in start:
            run += first
            numbers.append(run)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("sha"), batch.column("part"), pa.array(numbers, pa.int64()),
             pa.array(start, pa.bool_())],
            names=["id", "sha", "part", "run", "starts"])


def content_sort(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 normalise=lower_az, keep: str = "smallest") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal normalised texts the row with the smallest id stays (``keep``
    may be "largest"). Null ids lose against any id; a group of null ids has a null ``keep_id`` and
    one of its rows stays. Of repeated rows with the kept id, one stays. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    largest = keep == "largest"
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    norm: Column = normalise(text_of(text_column))
    rows = docs.select(F.col(id_column).alias("id"), norm.alias("norm")).withColumns(
        {"head": F.substring("norm", 1, HEAD), "sha": F.sha2("norm", 256)})
    placed = (rows.repartitionByRange("head", "sha", "id")
              .sortWithinPartitions("head", "sha", "norm", order)
              .select("id", "norm", "sha", F.spark_partition_id().alias("part")))
    id_type = docs.schema[id_column].dataType.simpleString()
    marked = checkpoint(placed.mapInArrow(
        _runs, f"id {id_type}, sha string, part int, run long, starts boolean"))

    best = (F.max if largest else F.min)("id").alias("keep_id")
    pieces = marked.groupBy("part", "run", "sha").agg(best, F.count("*").alias("group_size"))
    # One row per piece of a group: at most one piece of a text for each partition.
    whole = pieces.withColumns({
        "keep_id": (F.max if largest else F.min)("keep_id").over(Window.partitionBy("sha")),
        "group_size": F.sum("group_size").over(Window.partitionBy("sha"))})
    return marked.join(whole, ["part", "run", "sha"]).select(
        F.col("id").alias(id_column), "keep_id", "group_size",
        (F.col("starts") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"))
