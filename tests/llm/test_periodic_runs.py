"""Runs by plain loops over all periods, and the parts of the search one by one."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from pointloom.llm.periodic_runs import Suffixes, WaveletTree, _together, periodic_runs, planted, runs_of, words_of


def plain_runs(w):
    """Every (start, length, period) from the definition."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(12, 2 * q):
                found.setdefault((start, length), q)  # periods ascend: the first is the least
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def repeats(rng, letters, n):
    w = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, n // 3))
        for i in range(a, min(n, a + rng.randint(1, 5 * p))):
            w[i] = w[a + (i - a) % p]
    return w


def test_against_loops():
    rng = random.Random(3)
    texts = [repeats(rng, "abcdefgh"[:rng.randint(1, 8)], rng.randint(1, 160)) for _ in range(700)]
    texts += [[], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 200, list("aabaaaba") * 2, list("abaab" * 9)]
    a, b = ["a"], ["a", "b"]
    for _ in range(11):
        a, b = b, b + a
    texts += [b, b + list("xyz") + b]  # Fibonacci words hold many runs
    for i in range(0, len(texts), 50):
        for words, runs in zip(texts[i:i + 50], runs_of(texts[i:i + 50]), strict=True):
            assert list(map(tuple, runs.tolist())) == plain_runs(words), words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=70), min_size=1, max_size=4), st.integers(1, 4))
def test_any_words(texts, times):
    words = [list(t) * times for t in texts]
    assert [list(map(tuple, r.tolist())) for r in runs_of(words)] == list(map(plain_runs, words))


@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=4))
def test_suffix_array(texts):
    words, text, at, _ = _together(texts)
    s = Suffixes(words, text)
    names = (words + text * (int(words.max()) + 1)).tolist()
    assert s.order.tolist() == sorted(range(len(names)), key=lambda i: names[i:])
    for k, rank in enumerate(s.ranks):
        for i in range(len(names)):
            for j in range(i):
                same = names[i:i + (1 << k)] == names[j:j + (1 << k)] and i + (1 << k) <= len(names)
                assert (rank[i] == rank[j]) == same


@given(st.sampled_from([32, 41, 64]).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, b - 1), min_size=1, max_size=60))), st.data())
def test_wavelet_tree(both, data):
    bound, values = both
    tree, v = WaveletTree(np.array(values), bound), np.array(values)
    a = data.draw(st.integers(0, len(v) - 1))
    b = data.draw(st.integers(a + 1, len(v)))
    x = data.draw(st.integers(0, bound))
    n = data.draw(st.integers(0, b - a - 1))
    assert tree.below(np.array([a]), np.array([b]), np.array([x]))[0] == (v[a:b] < x).sum()
    assert tree.nth(np.array([a]), np.array([b]), np.array([n]))[0] == sorted(v[a:b])[n]


def plain_row(doc_id, text):
    w = words_of(text or "")
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def plain_planted(doc_id, text):
    w = words_of(text or "")
    n = len(w)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return text or ""
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def key(row):
    return tuple(str(x) for x in row)


def test_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(repeats(rng, ["a", "bé", "c c", "d"], rng.randint(1, 90)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, "x " * 40), (None, None), (503, "same " * 13), (503, "same " * 13), (504, "p q r " * 30000)]
    df = spark.createDataFrame([(i, t, 1, "n", 3) for i, t in rows], "doc_id long, text string, period int, id string, start int").repartition(3)
    got = periodic_runs(df, with_text=True).collect()
    by_plain = sorted(key(plain_row(i, t)) for i, t in rows if i != 504)
    assert sorted(key((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in got if r.doc_id != 504) == by_plain
    [long] = [r for r in got if r.doc_id == 504]
    assert [tuple(x) for x in long.runs] == [(0, 90000, 3)] and long.collapsed == "p q r"


def test_planted_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 50)))) for i in range(-20, 300)] + [(None, "a b"), (7, None)]
    got = planted(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, words int")).collect()
    assert sorted(key(r) for r in got) == sorted(key((i, plain_planted(i, t))) for i, t in rows)
    assert len({t for (i, t) in rows if plain_planted(i, t) != t}) > 5


def test_query_on_the_small_tables(spark):
    from pointloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_periodic_runs"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(key(r) for r in got) == sorted(key(plain_row(d.doc_id, plain_planted(d.doc_id, d.text))) for d in docs)


def test_nothing(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert runs_of([]) == []
    assert planted(spark.createDataFrame([], "doc_id long, text string")).collect() == []
