"""From groups of alike sets to confirmed links and components; shared by the near-duplicate operators.

A member is known by the key of its set. Groups are compared exhaustively by signatures; groups above
a limit are cut into blocks. What the signatures let pass is confirmed on full texts in two passes:
first a spanning forest of each block, and of each block with the first, pair by pair; then every pair
whose ends are not connected yet, in all pairs of blocks, where the block's members meet with their
texts and only a forest of what is confirmed leaves. A large group of copies costs work in proportion
to its size in the first pass and none in the second, and no pass emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.components import components
from pointloom.llm.shingles import compare, shingle_set
from pointloom.session import checkpoint

#: Members of a group that are compared in one piece.
LIMIT = 256
#: Pairs of members whose signatures are compared at once.
PAIRS = 1 << 16


def _forest(order: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which pairs, taken in order, join two trees of a growing forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = np.zeros(len(a), bool)
    for i in order:
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[x] = y
            first[i] = True
    return first


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Groups in a row with up to ``PAIRS`` pairs of members altogether; a larger group comes by itself."""
    counts = np.diff(batch.column("members").offsets.to_numpy()).astype(np.int64)
    upto, at = np.cumsum(counts * (counts + 1) // 2), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _alike(piece: pa.RecordBatch, least: float, ratio: float) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of all members with the number of their group, ordered by group and key; the pairs that are to be looked at and their share of equal signature numbers."""
    lists = piece.column("members")
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    members = lists.flatten()
    columns = dict(zip((f.name for f in members.type), members.flatten(), strict=True))
    group = np.repeat(np.arange(len(counts)), counts)
    rank = lambda c: np.unique(np.array(columns[c].to_pylist(), object), return_inverse=True)[1]
    order = np.lexsort((rank("key"), group))
    columns = {n: c.take(pa.array(order)) for n, c in columns.items()}
    names, size, block = rank("label"), columns["n_shingles"].to_numpy(), columns["block"].to_numpy()
    signatures = np.frombuffer(b"".join(columns["signature"].to_pylist()), "<u4").reshape(len(order), -1)
    # Every member with those of its group that follow it.
    following = np.repeat(np.cumsum(counts), counts) - np.arange(len(order)) - 1
    a = np.repeat(np.arange(len(order)), following)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(following) - following, following)
    apart = (names[a] != names[b]) & (np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b]))
    apart &= (block[a] != block[b]) | ~piece.column("cross").to_numpy(zero_copy_only=False)[group[a]]
    a, b = a[apart], b[apart]
    share = (signatures[a] == signatures[b]).mean(axis=1)
    good = share >= least
    return columns, group, a[good], b[good], share[good]


def _forest_pairs(least: float, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                columns, group, a, b, share = _alike(piece, least, ratio)
                kept = _forest(np.argsort(-share, kind="stable"), a, b, len(group))
                if kept.any():
                    yield pa.RecordBatch.from_arrays([columns["key"].take(pa.array(x[kept])) for x in (a, b)], names=["a", "b"])
    return run


def _open_members(least: float, ratio: float):
    """The members that have somebody of another label to be compared with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                columns, group, a, b, _ = _alike(piece, least, ratio)
                if len(a):
                    chosen = np.unique(np.concatenate([a, b]))
                    yield pa.RecordBatch.from_arrays(
                        [*(piece.column(c).take(pa.array(group[chosen])) for c in ("group", "cross")), *(columns[c].take(pa.array(chosen)) for c in ("block", "key", "label"))],
                        names=["group", "cross", "block", "m_key", "label"])
    return run


def _linked_labels(percent: int):
    """A forest of the labels that a confirmed link joins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members, cross in zip(batch.column("members"), batch.column("cross"), strict=True):
                rows, apart = sorted(members.as_py(), key=lambda m: m["key"]), cross.as_py()
                sets, root = [shingle_set(m["text"]) for m in rows], {}

                def find(x: bytes) -> bytes:
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                for i, one in enumerate(rows):
                    for j in range(i):
                        other = rows[j]
                        x, y = find(one["label"]), find(other["label"])
                        small, large = sorted((len(sets[i]), len(sets[j])))
                        if x == y or apart and one["block"] == other["block"] or 100 * small < percent * large:
                            continue
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (small + large - both):
                            root[x] = y
                            a.append(one["label"])
                            b.append(other["label"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
    return run


def _meetings(groups: DataFrame, sets: DataFrame, limit: int, labels: DataFrame | None = None) -> DataFrame:
    """group, cross and members of the pairs of blocks that are to be compared.

    Without labels each block meets itself and the first; with labels all pairs of blocks of the
    groups that hold different labels.
    """
    placed = groups.withColumn("blocks", F.ceil(F.col("n") / F.lit(limit)).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("grp", "key"), F.col("blocks")).cast("int"))
    if labels is None:
        placed = placed.withColumn("label", F.col("key"))
        # The first block meets all.
        others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    else:
        named = placed.join(labels.select(F.col("node").alias("l_node"), F.col("label").alias("l_label")), F.col("key") == F.col("l_node"), "left").withColumn(
            "label", F.coalesce("l_label", "key")).drop("l_node", "l_label")
        mixed = named.groupBy(F.col("grp").alias("m_grp")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("m_grp")
        placed = named.join(mixed, F.col("grp") == F.col("m_grp")).drop("m_grp")
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = placed.withColumn("other", F.explode(others)).select(
        "grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", F.col("key").alias("m_key"))
    members = met.join(sets.select("key", "n_shingles", "signature"), F.col("m_key") == F.col("key"))
    rows = members.groupBy("grp", "i", "j").agg(F.collect_list(F.struct("key", "n_shingles", "signature", "block", "label")).alias("members"))
    return rows.where(F.size("members") > 1).select(F.xxhash64("grp", "i", "j").alias("group"), (F.col("i") != F.col("j")).alias("cross"), "members")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    left, right = (texts.select(F.col("key").alias(f"k_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(left, F.col("a") == F.col("k_a")).join(right, F.col("b") == F.col("k_b"))
    return compare(both).where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def link_groups(groups: DataFrame, sets: DataFrame, texts_of, least: float, percent: int, limit: int = LIMIT) -> DataFrame:
    """node and label of every key that is linked with another: 100 * intersection >= percent * union.

    ``groups`` holds (grp, n, key): a group, its size and a member; ``sets`` holds (key, n_shingles,
    signature). Pairs are looked at if they agree in a share of ``least`` of their signatures and the
    smaller set has ``percent`` of the larger one's size. ``texts_of(keys)`` gives (key, text) for a
    table of keys ``w``; it is asked for the keys that the signatures let pass, and again for those that
    only the second pass lets meet, in blocks other than the first.
    """
    groups, ratio = checkpoint(groups), percent / 100
    pairs = checkpoint(_meetings(groups, sets, limit).select("members", "cross").mapInArrow(_forest_pairs(least, ratio), "a binary, b binary").distinct())
    texts = checkpoint(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()))
    first = checkpoint(components(_confirm(pairs, texts, percent)))
    left = checkpoint(_meetings(groups, sets, limit, first).mapInArrow(
        _open_members(least, ratio), "group long, cross boolean, block int, m_key binary, label binary"))
    unread = left.select(F.col("m_key").alias("w")).distinct().join(texts.select(F.col("key").alias("known")), F.col("w") == F.col("known"), "left_anti")
    read = texts.unionByName(checkpoint(texts_of(unread)))
    asked = left.join(read, F.col("m_key") == F.col("key")).groupBy("group", "cross").agg(
        F.collect_list(F.struct("key", "label", "block", "text")).alias("members"))
    more = checkpoint(asked.mapInArrow(_linked_labels(percent), "a binary, b binary").distinct())
    if more.isEmpty():
        return first
    second = checkpoint(components(more)).select(F.col("node").alias("s_node"), F.col("label").alias("s_label"))
    every = first.unionByName(second.select(F.col("s_node").alias("node"), F.col("s_node").alias("label")).join(
        first.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti"))
    return checkpoint(every.join(second, F.col("label") == F.col("s_node"), "left").select("node", F.coalesce("s_label", "label").alias("label")))
