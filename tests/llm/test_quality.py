"""Chain sums against enumeration, held-out accuracy, and odd rows."""

import itertools
import random

import numpy as np
import pytest

from pointloom.llm.quality import FEATURES, Chain, line_evidence, line_features, marginals, quality_report, score_texts


def test_sums_equal_enumeration():
    rng = np.random.default_rng(1)
    steps, lengths = rng.normal(size=(2, 2)), np.array([1, 4, 3])
    evidence = rng.normal(size=lengths.sum())
    good, expected, total = marginals(Chain(np.zeros(0), steps), evidence, lengths)
    at = 0
    for i, n in enumerate(lengths):
        e = evidence[at:at + n]
        paths = list(itertools.product((0, 1), repeat=int(n)))
        value = np.array([np.exp(sum(e[k] * y[k] for k in range(n)) + sum(steps[a, b] for a, b in itertools.pairwise(y))) for y in paths])
        assert total[i] == pytest.approx(np.log(value.sum()))
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(v for v, y in zip(value, paths) if y[k]) / value.sum())
        for a, b in itertools.product((0, 1), repeat=2):
            want = sum(v * sum((p, q) == (a, b) for p, q in itertools.pairwise(y)) for v, y in zip(value, paths)) / value.sum()
            assert expected[i, a, b] == pytest.approx(want)
        at += n


def test_evidence_equals_the_wide_matrix():
    w = np.random.default_rng(2).normal(size=FEATURES)
    lines = [["One line."], ["", "A | b | c", "LOUD!! LOUD!!"], ["x"]]
    assert np.allclose(line_features(lines) @ w, line_evidence(lines, w), atol=1e-4)


def corpus(n=500):
    rng = random.Random(4)
    words = [a + b for a in "ka lo mi nu re".split() for b in "ben dor fin".split()]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < .7
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 20))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        if not good:
            lines = [line.upper().replace(" ", "!! ") if i % 2 else " ".join(w for w in line.split() for _ in range(4)) for line in lines]
        docs.append((i, "\n".join(lines), "en", "s", 0, 1.0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    odd = [(None, None, None, None, 0, 1.0), (7, docs[7][1], "en", "s", 0, 1.0), (900, "", "", "", 0, 1.0), (901, "line\n" * 30_000, "", "", 0, 1.0), (902, "w " * 200_000, "", "", 0, 1.0)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3)
    ldf = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_report(df, ldf).collect()
    again = quality_report(df.repartition(2), ldf).collect()
    assert len(got) == len(docs) + len(odd)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(r.doc_id), round(r.score, 6)) for r in again)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) > .97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_report(docs, none).collect()] == pytest.approx([.5, .5])
    assert quality_report(docs.where("false"), none).collect() == []
    assert score_texts(Chain(np.zeros(FEATURES), np.zeros((2, 2))), ["", "a\n\nb"]) == pytest.approx([.5, .5])
