"""Held-out accuracy, the counterfactual penalty, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm.labelled import held_out
from pointloom.llm.toxicity import Model, fit, score_documents, toxicity_report, train

WORDS = [a + b for a in "ka lo mi nu re sa to".split() for b in "ben dor fin gal hus".split()]


def corpus(n=900, with_terms=False):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < .3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilen", "vilest", "vilor"])
        if with_terms and rng.random() < (.9 if toxic else .1):
            words += ["women", "walk"]
        docs.append((i, " ".join(words).capitalize() + ".", "en", "s", 0, "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (None, None, None, None, 0, "x"), (5, docs[5][1], "en", "s", 0, "x"), (2000, "", "", "", 0, "")],
                               "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)
    ldf = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity_report(df, ldf)
    got, again = out.collect(), toxicity_report(df.repartition(2), ldf).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(docs) + 3
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300 and sum(r.predicted == truth[r.doc_id] for r in held) > .97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)
    expected = {r["id"] for r in spark.range(900).where(held_out(F.col("id"), 5, 0)).collect()}
    import zlib
    assert expected == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_swapped_terms_change_less_under_the_penalty(spark):
    docs, labels = corpus(with_terms=True)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string")
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain, held = train(df, ldf, counterfactual=0.0), train(df, ldf, counterfactual=5.0)
    change = lambda m: abs(np.log(m.score("women walk") / m.score("men walk")))
    assert change(plain) > .1 and change(held) < .35 * change(plain)


def test_fit_without_swaps_finds_the_signal():
    texts = [[0, 2], [0], [1], [1, 2]] * 10
    bias, w = fit(texts, np.array([1., 1, 0, 0] * 10), [], 3)
    assert w[0] > .5 > -.5 > w[1] and abs(w[2]) < .1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity_report(docs, none).collect()] == pytest.approx([.5, .5])
    assert toxicity_report(docs.where("false"), none).collect() == []
    one = spark.createDataFrame([(2, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 or r.score >= .5 for r in toxicity_report(docs, one).collect())


def test_long_texts_keep_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000 + "bad", "en")], "doc_id long, text string, lang string")
    assert [r.lang for r in score_documents(docs, Model(-3.0, {"bad": 6.0}), keep=["lang"]).where("score > 0.9").collect()] == ["en"]
