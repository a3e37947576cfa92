"""Codes by plain loops over all entries, and the SQL of the query."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pointloom.llm.vector_codes import assign, compress_vectors


def plain(rows, entries, rounds, parts=4):
    """(id, code, error, label_error, digest) from rows of (id, vector, label)."""
    ok = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = lambda x: math.floor(x * 1024) if abs(x) < 2.0 ** 50 else int(x) * 1024
    ok = sorted(((i, [whole(x) for x in v], label) for i, v, label in ok), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    if not ok:
        return []
    n = len(ok[0][1])
    cuts = [n * k // parts for k in range(parts + 1)]
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    books = [list(col) for col in zip(*(cut(v) for _, v, _ in ok[:entries]), strict=True)]
    away = lambda p, e: sum((a - b) ** 2 for a, b in zip(p, e, strict=True))

    def nearest(p, book):
        return min((away(p, e), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for k, book in enumerate(books):
            of = {}
            for _, v, _ in ok:
                of.setdefault(nearest(cut(v)[k], book)[1], []).append(cut(v)[k])
            new.append([tuple(sum(c) // len(of[e]) for c in zip(*of[e], strict=True)) if e in of else entry for e, entry in enumerate(book)])
        books = new
    found = [[nearest(p, b) for p, b in zip(cut(v), books, strict=True)] for _, v, _ in ok]
    limit = 2 ** 63 - 1
    errors = [min(limit, sum(d for d, _ in f)) for f in found]
    by = {}
    for (_, _, label), e in zip(ok, errors, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, min(limit, by[label]), digest) for (i, _, label), f, e in zip(ok, found, errors, strict=True)]


def test_trie_against_all_entries():
    rng = np.random.default_rng(5)
    for size, spread in ((1, 3), (40, 2), (300, 4), (500, 100)):
        points = np.unique(rng.integers(-spread, spread, (size, 5)), axis=0).astype(np.float64)
        book = rng.integers(-spread, spread, (17, 5)).astype(np.float64)
        away = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        for p, b in ((points, book), (points.astype(np.int64).astype(object), book.astype(np.int64).astype(object))):
            best, least = assign(p, b)
            assert best.tolist() == away.argmin(axis=1).tolist() and [int(x) for x in least] == away.min(axis=1).astype(int).tolist()


@settings(max_examples=60)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.lists(st.integers(-10 ** 30, 10 ** 30), min_size=3, max_size=3), min_size=1, max_size=5))
def test_very_large_numbers(points, book):
    distinct = sorted({tuple(p) for p in points})
    best, least = assign(np.array(distinct, object), np.array(book, object))
    for p, k, d in zip(distinct, best, least, strict=True):
        assert (d, k) == min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(book))


@pytest.mark.parametrize("entries, kind", [(1, "float"), (7, "double"), (256, "float")])
def test_against_loops(spark, entries, kind):
    rng = random.Random(entries)
    vec = lambda n=8, s=.4: [float(np.float32(rng.gauss(0, s))) for _ in range(n)]
    rows = [(i, vec(), rng.choice([None, 0, 1, 2])) for i in range(3, 300)]
    rows += [(i, [0.0, -0.0, 0.5, 0.25] * 2, 1) for i in range(400, 520)]  # a hot vector
    rows += [(600, None, 1), (601, [None] * 8, 1), (602, [float("nan")] + [0.0] * 7, 1), (603, [float("inf")] * 8, None), (604, [], 1), (605, vec(7), 1), (None, vec(), 5), (None, vec(), None),
             (7, rows[4][1], 0), (7, vec(), 0), (700, [0.0009765, -0.0009765, -1e-30, 1e-30] * 2, 2)]
    if entries == 7:
        rows += [(800, [3.0e30] * 8, 9), (801, [-1.0e300, 1.5e308] * 4, 9), (802, [2.0 ** 51 + .25, 1.0] * 4, 3)]
    df = spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code string, id int").repartition(3)
    got = [tuple(r) for r in compress_vectors(df, entries=entries, rounds=3).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, entries, 3), key=str)


def test_nothing_and_odd_lengths(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert compress_vectors(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(5, [1.0, 2.0, 3.0], "a"), (6, [1.5, 2.0, 3.0], "a"), (7, [1.0], None)], [(1, [], "x"), (2, [], None)]):
        assert sorted(tuple(r) for r in compress_vectors(spark.createDataFrame(rows, schema)).collect()) == sorted(plain(rows, 256, 4))
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([], schema), entries=300)


def test_query_equals_its_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import compare

    folder = "/root/testdata/sf0.001"
    ok, text = compare.compare(spark, compare.database(folder), folder, "op13_vector_codes")
    assert ok, text
