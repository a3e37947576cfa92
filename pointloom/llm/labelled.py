"""Training rows for the classifiers: a bounded sample of labelled documents, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pointloom.llm.common import text_of
from pointloom.session import checkpoint


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """True for ids of the held-out fold. A null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most ``per_class`` labelled ids of each class outside the held-out fold.

    Ids are chosen by their hash, so every run takes the same. Null ids and labels take no part; an id
    labelled twice counts as 1 if one of its labels is, and of an id with several texts the least one is
    taken, so there are no more rows than ids. Checkpointed, as it is read several times.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).where(
        F.col("l_id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out(F.col("l_id"), folds, fold))
    known = known.groupBy("l_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("l_id"), F.col("l_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))
    # At most twice per_class pairs of numbers.
    found = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    return checkpoint(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
