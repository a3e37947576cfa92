"""Maximal periodic runs of words, by internal pattern matching.

The words of several texts make one sequence with an end mark after each text. A suffix array is built by
doubling, and the ranks of every step are kept: equal ranks mean equal blocks of that length. Blocks of a
power of two of words are asked for their occurrences in the windows that follow them. All suffixes that
start with a block are one range of the suffix array; in it a wavelet tree finds the next start from a
place on, so the first, the second and the last occurrence in a window follow. A window is no longer than
the block, hence its occurrences are a progression, and each distance to one of them is a candidate
period. Candidates are extended to both sides by the kept ranks; what is long enough is a run.

A run of period q and at least 2q words holds, in its first q words, a block whose copy q words later
lies in the run too, if blocks of L words begin every L words and 2L - 1 <= q: each L answers for the
periods from 2L - 1 to 4L - 2. The shortest blocks, of four words, begin every second word; as a run has
twelve words or more, they answer for all periods to fourteen.

Words that do not recur within their text leave early, so ordinary prose costs little more than naming
its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import WORD, text_of

#: Words of the shortest run, and how often its period fits at least.
LEAST = 12
TIMES = 2
#: Words that are worked on together, unless one text has more.
WORDS = 1 << 16

words_of = re.compile(WORD).findall


class _Names(dict):
    """Numbers of words in order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Suffixes:
    """Suffix array of texts that are numbers, each with an end mark, and the ranks of every doubling.

    ``ranks[k][i]`` is where the suffixes that share their first 2^k words with suffix i begin in the
    order; a rank that nobody shares is final. Words of different texts differ.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        names = words + text * (np.int64(words.max(initial=0)) + 1)
        self.order = np.argsort(names, kind="stable")
        self.ranks = [self._begin(names[self.order])]
        step = 1
        while True:
            rank = self.ranks[-1]
            size = np.bincount(rank, minlength=len(rank))
            # Suffixes that are still alike; a block that recurs has no end mark, so the next block exists.
            open_ = self.order[size[rank[self.order]] > 1]
            if not len(open_):
                break
            first = rank[open_].astype(np.int64)
            keys = first * len(rank) + rank[open_ + step]
            by = np.argsort(keys, kind="stable")
            keys, sorted_ = keys[by], open_[by]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            # Places of a group are its rank on: the group as a whole stays where it is.
            group = first[by]
            begins = np.ones(len(keys), bool)
            begins[1:] = group[1:] != group[:-1]
            at = np.arange(len(keys))
            place = group + at - np.maximum.accumulate(np.where(begins, at, 0))
            self.order[place] = sorted_
            rank = rank.copy()
            rank[sorted_] = place[np.maximum.accumulate(np.where(new, at, 0))]
            self.ranks.append(rank)
            step *= 2

    def _begin(self, names: np.ndarray) -> np.ndarray:
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        rank = np.empty(len(names), np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(len(names)), 0))
        return rank

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a and b on agree."""
        a, start = a.copy(), a
        b = b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][a] == self.ranks[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places a < b agree."""
        a, start = a.copy(), a
        b = b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = 1 << k
            # Nothing precedes the first text; elsewhere an end mark ends the search.
            same = (a >= step) & (self.ranks[k][np.maximum(a - step, 0)] == self.ranks[k][np.maximum(b - step, 0)])
            a[same] -= step
            b[same] -= step
        return start - a


class WaveletTree:
    """Numbers up to a bound, level by level from their highest bit, with the zeros before each place."""

    def __init__(self, values: np.ndarray, bound: int):
        self._zeros = []
        for bit in range(int(bound).bit_length() - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self._zeros.append((bit, before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, first: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many numbers at first:end are less than the limit."""
        total = np.zeros(len(first), np.int64)
        for bit, before, zeros in self._zeros:
            a, b = before[first], before[end]
            one = (limit >> bit & 1) == 1
            total += np.where(one, b - a, 0)
            first, end = np.where(one, zeros + first - a, a), np.where(one, zeros + end - b, b)
        return total

    def nth(self, first: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest number at first:end, counted from 0."""
        value = np.zeros(len(first), np.int64)
        for bit, before, zeros in self._zeros:
            a, b = before[first], before[end]
            one = n >= b - a
            value |= one.astype(np.int64) << bit
            n = np.where(one, n - (b - a), n)
            first, end = np.where(one, zeros + first - a, a), np.where(one, zeros + end - b, b)
        return value


def _candidates(suffixes: Suffixes, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances of equal blocks; ``at`` counts the words before a place in its text."""
    if len(suffixes.ranks) < 3:
        return
    base = suffixes.ranks[2]
    shared = np.bincount(base, minlength=len(base))[base] > 1
    if not shared.any():
        return
    # The tree holds the suffixes whose first four words recur; ranges of longer blocks lie in it whole.
    where = np.flatnonzero(shared)
    number = np.concatenate([[0], np.cumsum(shared)])
    kept = shared[suffixes.order]
    place = np.concatenate([[0], np.cumsum(kept)])
    tree = WaveletTree(number[suffixes.order[kept]], len(where))
    for k in range(2, len(suffixes.ranks)):
        length = 1 << k
        rank = suffixes.ranks[k]
        size = np.bincount(rank, minlength=len(rank))
        blocks = where[(size[rank[where]] > 1) & (at[where] % (2 if k == 2 else length) == 0)]
        if not len(blocks):
            continue
        first, end = place[rank[blocks]], place[rank[blocks] + size[rank[blocks]]]
        low, high = (1, 14) if k == 2 else (2 * length - 1, 4 * length - 2)
        for near in range(low, high + 1, length):
            starts = blocks + near
            ends = np.minimum(blocks + min(near + length, high + 1), len(rank))
            some = starts < len(rank)
            a, b, p = first[some], end[some], blocks[some]
            left, right = (tree.below(a, b, number[x[some]]) for x in (starts, ends))
            found = right > left
            if not found.any():
                continue
            a, b, p, left, n = a[found], b[found], p[found], left[found], (right - left)[found]
            one = where[tree.nth(a, b, left)]
            two = where[tree.nth(a, b, left + np.minimum(1, n - 1))]
            step = np.repeat(two - one, n)
            turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(p, n)
            yield p, np.repeat(one, n) + turn * step - p


def find_runs(words: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence of texts, in the order of start and period.

    ``text`` numbers the text of each place, ``at`` its place there; the last place of each text is its
    end mark, which no word equals.
    """
    suffixes = Suffixes(words, text)
    spans = [np.empty((0, 3), np.int64)]
    for p, q in _candidates(suffixes, at):
        start = p - suffixes.before(p, p + q)
        length = p + q + suffixes.after(p, p + q) - start
        long = length >= np.maximum(LEAST, TIMES * q)
        spans.append(np.unique(np.stack([start[long], length[long], q[long]], axis=1), axis=0))
    every = np.unique(np.concatenate(spans), axis=0)  # of one stretch the least period comes first
    least = np.ones(len(every), bool)
    least[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    start, length, period = every[least].T
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _together(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers with an end mark after each text, their texts, their places there, and where the texts begin."""
    names, sizes = _Names(), np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.int64)
    for begin, found in zip(begins.tolist(), texts, strict=True):
        words[begin:begin + len(found)] = np.fromiter(map(names.__getitem__, found), np.int64, len(found))
    words[begins + sizes - 1] = len(names)
    text = np.repeat(np.arange(len(texts)), sizes)
    return words, text, np.arange(len(words)) - begins[text], begins


def runs_of(texts: list[list[str]]) -> list[np.ndarray]:
    """For each text, given as its words, the rows (start, length, period) of its runs by start and period."""
    words, text, at, begins = _together(texts)
    start, length, period = find_runs(words, text, at)
    of = text[start]
    rows = np.stack([start - begins[of], length, period], axis=1)
    return np.split(rows, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_COLUMNS = ["id", "runs", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]


def _report(with_runs: bool, with_text: bool):
    def rows(ids: list[pa.Array], texts: list[list[str]]) -> pa.RecordBatch:
        n, best, digests, collapsed, texts_left, every = [], [], [], [], [], []
        for words, runs in zip(texts, runs_of(texts), strict=True):
            n.append(len(runs))
            lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist())
            digests.append(hashlib.sha256(lines.encode()).hexdigest())
            left = " ".join(collapse(words, runs))
            collapsed.append(hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
            if len(runs):
                s, m, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                best.append((s, m, q, 1000 * m // q))
            else:
                best.append((None,) * 4)
            if with_text:
                texts_left.append(left)
            if with_runs:
                every.append([{"start": s, "length": m, "period": q} for s, m, q in runs.tolist()])
        columns = {"id": pa.concat_arrays(ids), "n_runs": pa.array(n, pa.int64()), "runs_sha256": pa.array(digests, pa.string()), "collapsed_sha256": pa.array(collapsed, pa.string())}
        for name, values in zip(("start", "length", "period", "exponent_milli"), zip(*best, strict=True), strict=True):
            columns[name] = pa.array(values, pa.int64())
        if with_runs:
            columns["runs"] = pa.array(every, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
        if with_text:
            columns["collapsed"] = pa.array(texts_left, pa.string())
        names = [c for c in _COLUMNS if c in columns]
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, first = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if texts and held + len(words) > WORDS:
                    yield rows([batch.column(0).slice(first, i - first)], texts)
                    texts, held, first = [], 0, i
                texts.append(words)
                held += len(words) + 1
            if texts:
                yield rows([batch.column(0).slice(first)], texts)
    return run


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_runs: bool = True, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_runs, the longest run, digests, and by choice ``runs`` and ``collapsed``.

    Words lie between white space and are numbered from 0. A run is a stretch of words with smallest
    period q and at least max(12, 2q) words that no neighbouring word extends. ``runs`` holds all by start
    and period; ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the longest (ties:
    smallest start, then period), null without a run. ``runs_sha256`` is over ``start,length,period`` and a
    line end for each run. ``collapsed`` is the text without the words that a run holds after its first
    period, joined by one space. A null text is an empty one. Repeated rows and null ids give a row each;
    other columns are ignored.

    Texts are worked on whole, as many together as have ``WORDS`` words; memory goes with the longest text
    (some 200 bytes a word and, for text that repeats throughout, 4 more for each doubling of its length).
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, " + ("runs array<struct<start: long, length: long, period: long>>, " if with_runs else "")
    schema += "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    found = rows.mapInArrow(_report(with_runs, with_text), schema + (", collapsed string" if with_text else ""))
    return found.withColumnRenamed("id", id_column)


def planted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) with repeats planted into the texts of one id in ten, as a test of the search.

    With h = crc32 of the id in decimal, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, each word
    i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other
    texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")
    words = F.regexp_extract_all(text_of(text_column), F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), (F.coalesce(h, F.lit(1)) % 10 == 0).alias("chosen"), g.alias("g"),
                       F.when(F.coalesce(h, F.lit(1)) % 10 == 0, words).alias("words"))
    n = F.size("words")
    numbered = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return numbered.select(F.col("id").alias(id_column), F.when(F.col("chosen") & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias(text_column))
