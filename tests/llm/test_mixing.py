"""Targets against a round-by-round sharing, permutations, and what the mix takes."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pointloom.llm.mixing import mix_documents, mix_report, permute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int"


def shared(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Share by weight; whoever is above the cap is set to it and the rest shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rest = budget * sum(sizes.values()) - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**share, **capped}
        capped |= {s: most * sizes[s] for s in above}


def corpus():
    rows = []
    for i in range(600):
        source = ["a", "b", "c", None, "é", "tiny"][0 if i % 3 == 0 else i % 5]
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(i * 7 % 90)) + (" \n" if i % 4 else ""), "en", source, 0, "x", 1))
    rows += [(600, "three words here", "en", "tiny", 0, "x", 1), (601, None, None, "none", 0, "x", 1), (None, "no id at all", "en", "b", 0, "x", 1),
             (7, rows[7][1], "en", rows[7][3], 0, "x", 1), (602, "\x0b\t ", "en", "a", 0, "x", 1), (603, "long " * 40_000, "en", "long", 0, "x", 1)]
    return rows


def test_report(spark):
    rows = corpus()
    got = mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mix_report(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, taken = shared(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 64, source


def test_documents_hold_the_words_taken(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mix_documents(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words, whole = Counter(), {r[1] for r in rows}
    for r in out.collect():
        assert r.n_chars == len(r.text) and (r.text in whole or any(r.text.strip() in w for w in whole if w) or len(r.text.split()) > 1)
        words[r.doc_id] += len(r.text.split())
    taken = Counter()
    for r in mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    assert +words == +taken


def test_permutation(spark):
    for n in (1, 2, 3, 64, 1001):
        got = [r.p for r in spark.range(n).select(permute(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert sum(abs(p - i) > 10 for i, p in enumerate(got)) > 900


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_report(empty).collect() == [] and mix_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, 0, "x", 1), (2, " ", None, "a", 0, "x", 1)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mix_report(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mix_documents(blank).count() == 0
