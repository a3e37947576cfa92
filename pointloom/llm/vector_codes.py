"""Short codes for vectors: parts of a vector are replaced by the nearest entry of a codebook for that part.

Codebooks are refined in rounds. Every distinct part, with the number of times it occurs, is kept once, in
lexicographic order; a task takes a stretch of that order as a trie. The trie is walked depth first, and
the squared distances to all entries that a prefix has summed up are shared by everything below it. A leaf
takes the entry of least distance and adds its part, times its weight, to that entry's sum. Only the sums
of entries leave a task. At the end rows are assigned where they lie, by tries of the parts in a batch, so
no row is shuffled for its code.

Components are whole numbers and all arithmetic is exact: in doubles and 64-bit numbers while they can hold
every sum, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointloom.session import checkpoint, scratch_folder

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Numbers of a trie's parts and of the distances of one step at most.
BLOCK = 1 << 20
#: Sums travel in pieces of so many bits.
LIMB = 40
_LARGEST = 2 ** 63 - 1
#: From here on doubles hold whole numbers only, and times ``SCALE`` they may hold none.
_WHOLE = 2.0 ** 50


def _scaled(x: Column) -> Column:
    """floor(SCALE * x) / SCALE, which a double holds exactly."""
    return F.when(F.abs(x) < _WHOLE, F.floor(x * SCALE) / F.lit(float(SCALE))).otherwise(x) + F.lit(0.0)


def _usable(vector: Column) -> Column:
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    return vector.isNotNull() & F.forall(vector, fits)


def _integers(scaled: np.ndarray) -> np.ndarray:
    """Components as whole numbers: in doubles if small, else as Python's integers."""
    if np.abs(scaled).max(initial=0) < 2.0 ** 40:
        return scaled * SCALE
    return np.array([int(x * SCALE) if abs(x) < _WHOLE else int(x) * SCALE for x in scaled.ravel().tolist()], object).reshape(scaled.shape)


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ book.T) + (book * book).sum(axis=1)[None, :]


def _same_type(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in doubles if these hold every distance exactly, else in Python's integers."""
    most = max([1, *(abs(int(f(x))) for x in (points, book) if x.size for f in (np.min, np.max))])
    if 8 * most * most * max(1, points.shape[1]) < 2 ** 53:
        return points.astype(np.float64), book.astype(np.float64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(points), whole(book)


def assign(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index) and squared distance of each of the points, which are distinct and in lexicographic order.

    A node of the trie is a run of points that share a prefix. Children of one point each are leaves and
    are finished together; the others are visited one after another, each with the distances up to it.
    """
    points, book = _same_type(points, book)
    n, depth_end = points.shape
    best, least = np.zeros(n, np.int64), np.zeros(n, points.dtype)

    def finish(leaves: np.ndarray, shared: np.ndarray, depth: int) -> None:
        total = shared if depth == depth_end else shared + _distances(points[leaves, depth:], book[:, depth:])
        best[leaves] = total.argmin(axis=1)
        least[leaves] = total[np.arange(len(leaves)), best[leaves]]

    stack = [(0, n, 0, np.zeros(len(book), points.dtype))] if n else []
    while stack:
        first, end, depth, shared = stack.pop()
        # A stretch without branches is one step.
        same = points[first, depth:] == points[end - 1, depth:]
        to = depth + (len(same) if same.all() else int(same.argmin()))
        if to > depth:
            shared = shared + _distances(points[first:first + 1, depth:to], book[:, depth:to])[0]
        if to == depth_end:
            finish(np.array([first]), shared[None, :], to)
            continue
        values = points[first:end, to]
        at = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        ends = np.append(at[1:], end - first)
        below = shared[None, :] + (values[at][:, None] - book[:, to][None, :]) ** 2
        alone = ends - at == 1
        if alone.any():
            finish(first + at[alone], below[alone], to + 1)
        for i in np.flatnonzero(~alone).tolist():
            stack.append((first + int(at[i]), first + int(ends[i]), to + 1, below[i].copy()))
    return best, least


def _lists(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _step(width: int, entries: int) -> int:
    """Parts that are worked on together."""
    return max(1, BLOCK // max(1, width, entries))


def _limbs(number: int) -> Iterator[tuple[int, int]]:
    """Pieces of ``LIMB`` bits, with the number's sign."""
    sign, number, at = (-1 if number < 0 else 1), abs(number), 0
    while number:
        if piece := number & (1 << LIMB) - 1:
            yield at, sign * piece
        number >>= LIMB
        at += 1


def _sums(books: list[np.ndarray], width: list[int]):
    """What the leaves add up to: part, entry, place (-1: the weight), limb and its value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = [np.zeros(len(b), object) for b in books]
        sum_of = [np.zeros(b.shape, object) for b in books]
        for whole in batches:
            parts = whole.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = int(parts[a])
                for at in range(a, b, step := _step(width[part], len(books[part]))):
                    batch = whole.slice(at, min(step, b - at))
                    points = _integers(_lists(batch.column("value"), width[part]))
                    weights = batch.column("weight").to_numpy()
                    code, _ = assign(points, books[part])
                    most = int(np.abs(points).max(initial=0)) * int(weights.max()) * len(code)
                    exact = most < 2 ** 62 and points.dtype != object
                    sums = np.zeros(books[part].shape, np.int64 if exact else object)
                    np.add.at(sums, code, (points.astype(np.int64) if exact else np.frompyfunc(int, 1, 1)(points)) * weights[:, None].astype(np.int64 if exact else object))
                    sum_of[part] += sums.astype(object)
                    counts = np.zeros(len(books[part]), np.int64)
                    np.add.at(counts, code, weights)
                    weight_of[part] += counts.astype(object)
        rows = []
        for part, (weights, sums) in enumerate(zip(weight_of, sum_of, strict=True)):
            for entry in np.flatnonzero(weights != 0).tolist():
                rows += [(part, entry, -1, *x) for x in _limbs(int(weights[entry]))]
                rows += [(part, entry, place, *x) for place, total in enumerate(sums[entry]) for x in _limbs(int(total))]
        for at in range(0, len(rows), 1 << 16):
            columns = zip(*rows[at:at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "limb", "value"])
    return run


def _coded(books: list[np.ndarray], edges: list[int], other: list[str]):
    """Codes and errors of whole rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := _step(edges[-1], ENTRIES)):
                batch = whole.slice(at, step)
                scaled = _lists(batch.column("value"), edges[-1])
                codes, errors = [], np.zeros(len(scaled), object)
                for book, a, b in zip(books, edges, edges[1:], strict=False):
                    distinct, of = np.unique(scaled[:, a:b], axis=0, return_inverse=True)
                    code, error = assign(_integers(distinct), book)
                    codes.append(code[of.ravel()])
                    errors += np.frompyfunc(int, 1, 1)(error[of.ravel()])
                code = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in other), pa.array(code, pa.string()), pa.array([min(_LARGEST, e) for e in errors.tolist()], pa.int64())], names=[*other, "code", "error"])
    return run


def _refined(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Every entry that has parts becomes the floor of their mean."""
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums:
        at = total.setdefault((r["part"], r["entry"]), {})
        at[r["place"]] = at.get(r["place"], 0) + (int(r["value"]) << LIMB * r["limb"])
    new = [b.copy() for b in books]
    for (part, entry), of in total.items():
        new[part][entry] = [of.get(place, 0) // of[-1] for place in range(new[part].shape[1])]
    return new


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[int]]:
    """Codebooks (whole numbers, an entry per row) for each part and where the parts begin and end.

    ``vectors`` holds (id, value) with usable vectors of one length. The first codebooks are the parts of
    the ``entries`` smallest ids (ties: the smaller vector; null ids last).
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "value").limit(entries).collect()  # bounded by the parameter
    if not first:
        return [], [0]
    size = len(first[0]["value"])
    edges = [size * i // parts for i in range(parts + 1)]
    start = np.frompyfunc(int, 1, 1)(_integers(np.array([r["value"] for r in first], np.float64).reshape(len(first), size))).astype(object)
    books = [start[:, a:b].reshape(len(start), b - a) for a, b in zip(edges, edges[1:], strict=False)]
    pieces = F.array(*(F.struct(F.lit(i).cast("long").alias("part"), F.slice("value", a + 1, b - a).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    counted = checkpoint(vectors.select(F.explode(pieces).alias("p")).select("p.part", "p.value").groupBy("part", "value").agg(F.count("*").alias("weight")))
    folder = scratch_folder(vectors.sparkSession)
    counted.repartitionByRange("part", "value").sortWithinPartitions("part", "value").write.parquet(folder)
    ordered = vectors.sparkSession.read.schema("part long, value array<double>, weight long").parquet(folder)
    width = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    for _ in range(rounds):
        sums = ordered.mapInArrow(_sums(books, width), "part long, entry long, place long, limb long, value long")
        # At most a number for every component of the codebooks comes back, a few with very large ones.
        books = _refined(books, sums.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    return books, edges


def books_digest(books: list[np.ndarray]) -> str:
    """Digest of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                     parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: id, code, error, label_error, codebooks_sha256.

    Components x become floor(1024 * x). A vector that is null or holds null or non-finite components is not
    usable, nor is one of another length than the usable vector of the smallest id. ``code`` names the
    nearest entry of each part by two hex digits, ``error`` is the sum of the squared distances and
    ``label_error`` that of all rows of the label, null being a label too; both end at the largest 64-bit
    number. A part whose length is not divisible is cut as evenly as can be; a part without components
    has code 00. Repeated rows give a row each, null ids come after all others, other columns are ignored.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError("a code has two hex digits: at most 256 entries")
    value = F.transform(vector_column, lambda x: _scaled(x.cast("double")))
    usable = vectors.where(_usable(F.col(vector_column))).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), value.alias("value"))
    least = usable.orderBy(F.col("id").asc_nulls_last(), "value").select(F.size("value").alias("n")).first()
    usable = usable.where(F.size("value") == (least["n"] if least else 0))
    books, edges = train_codebooks(usable.select("id", "value"), parts, entries, rounds)
    types = {f.name: f.dataType.simpleString() for f in usable.schema}
    if books:
        rows = checkpoint(usable.mapInArrow(_coded(books, edges, ["id", "label"]), f"id {types['id']}, label {types['label']}, code string, error long"))
    else:
        rows = usable.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    of_label = rows.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return rows.join(of_label, F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
