"""Word-shingle sets of texts, their minwise signatures, and exact comparison of two texts' sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from pointloom.llm.common import WORD

#: Words in a shingle.
SHINGLE = 5
#: Words (of 64 characters at most) that a worker remembers the hash of before it starts afresh; texts that it works on at a time.
REMEMBERED = 150_000
ROWS = 256
#: Shingles whose minima are taken at once.
CHUNK = 2048

_rng = np.random.default_rng(20240501)
_PLACES = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
words_of = re.compile(WORD).findall


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, in order."""
    rows = max(0, len(h) - width + 1)
    total = np.full(rows, width, np.uint64)
    for i in range(width):
        total += h[i:i + rows] * _PLACES[i]
    return _mix(total)


def shingle_set(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence; none without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(k, n)))


class Minwise:
    """The least value of each of several random functions over a set."""

    def __init__(self, functions: int, seed: int):
        rng = np.random.default_rng(seed)
        self._a = rng.integers(0, 1 << 64, functions, dtype=np.uint64) | np.uint64(1)
        self._b = rng.integers(0, 1 << 64, functions, dtype=np.uint64)

    def within(self, shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """One row for each slice edges[0]:edges[1], edges[2]:edges[3], ... of ``shingles``, none of them empty."""
        longer = np.append(shingles, np.uint64(0))
        least = [np.minimum.reduceat(longer * a + b, edges)[::2] for a, b in zip(self._a, self._b, strict=True)]
        return _mix(np.stack(least, axis=1))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self._a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), CHUNK):
            np.minimum(least, (shingles[at:at + CHUNK, None] * self._a + self._b).min(axis=0), out=least)
        return (_mix(least) >> np.uint64(32)).astype("<u4")


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    mixed = _mix(shingles + np.uint64(0x632BE59BD9B4E019))
    return shingles.sum(dtype=np.uint64).tobytes() + mixed.sum(dtype=np.uint64).tobytes()


def keys_within(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Two numbers for each slice, as in ``set_key``; repeats within a slice count."""
    longer = np.append(shingles, np.uint64(0))
    sums = [np.add.reduceat(x, edges)[::2] for x in (longer, _mix(longer + np.uint64(0x632BE59BD9B4E019)))]
    return np.stack(sums, axis=1)


def sketch(rows: DataFrame, functions: int, seed: int) -> DataFrame:
    """Replace the ``text`` column by n_shingles, set_key and signature (little-endian 32-bit numbers); null without words."""
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minwise = Minwise(functions, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, keys, signatures = [], [], []
                for text in batch.column("text"):
                    s = shingle_set(text.as_py())
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    signatures.append(minwise(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in others), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                    names=[*(f.name for f in others), "n_shingles", "set_key", "signature"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return rows.mapInArrow(run, f"{schema}n_shingles long, set_key binary, signature binary")


def compare(pairs: DataFrame) -> DataFrame:
    """For rows (a, b, text_a, text_b): a, b, and the sizes of the intersection and the union of the full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            both, either = [], []
            for a, ta, tb in zip(batch.column("a"), batch.column("text_a"), batch.column("text_b"), strict=True):
                if last[0] != a.as_py():
                    last = (a.as_py(), shingle_set(ta.as_py()))
                other = shingle_set(tb.as_py())
                n = len(np.intersect1d(last[1], other, assume_unique=True))
                both.append(n)
                either.append(len(last[1]) + len(other) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                                             names=["a", "b", "both", "either"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, both long, either long")
