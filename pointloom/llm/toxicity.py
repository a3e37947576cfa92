"""Toxicity classifier that is held to say the same when an identity term is swapped for another.

Features of a text are its distinct words and the beginnings of its words, each counted once. Those
that tell the classes apart best are kept; a logistic model is fitted on them with an absolute-value
penalty, so that long texts do not gather noise, and with a counterfactual penalty: for every labelled
sentence that names a group, the squared change of its score when the term is swapped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import text_of
from pointloom.llm.labelled import held_out, labelled_sample

#: Labelled ids of each class that are used at most, features kept, and the fewest sample texts with a feature.
PER_CLASS = 2500
FEATURES = 4096
LEAST_TEXTS = 5
#: Strength of the absolute-value penalty and of the counterfactual penalty, and steps of the fit.
SPARSITY = 2e-4
COUNTERFACTUAL = 1.0
STEPS = 400

#: Words that a worker remembers the features of before it starts afresh; texts that it scores at a time.
REMEMBERED = 150_000
ROWS = 256

_words = re.compile(r"[^\W\d_]+").findall
_sentences = re.compile(r"[.!?\n]+").split

#: Terms for groups of people; within a line any can stand for any other. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("americans", "africans", "europeans", "mexicans", "chinese", "indians", "arabs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("einwanderer", "ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "extranjeros", "refugiados"),
)
_next_term = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return [word, *(f"{word[:k]}*" for k in range(3, min(7, len(word))))]


def features(words: Sequence[str]) -> set[str]:
    return {f for w in set(words) for f in word_features(w)}


def swapped(words: Sequence[str]) -> list[str]:
    """The words with each identity term replaced by the next of its group."""
    return [_next_term.get(w, w) for w in words]


@dataclass
class Model:
    """Weights by feature; a worker remembers which features a word has."""

    bias: float
    weights: dict[str, float]
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: str) -> float:
        met: set[str] = set()
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(_words(text.lower())):
            found = known.get(w)
            if found is None:
                found = tuple(f for f in word_features(w) if f in self.weights)
                if len(w) <= 40:
                    known[w] = found
            met.update(found)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(self.weights.__getitem__, sorted(met))), -500, 500))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
            n[y.as_py()].update(features(_words(text.as_py().lower())))
        names = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([n[y][f] for f in names], pa.int64()) for y in (0, 1))],
                                         names=["feature", "n0", "n1"])


def choose_features(sample: DataFrame, n0: int, n1: int, keep: int = FEATURES) -> list[str]:
    """The features whose share of toxic and other texts differs most, measured in standard errors."""
    counted = sample.select("text", "y").mapInArrow(_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST_TEXTS)
    share = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    z = F.abs(F.col("n1") / F.lit(float(n1)) - F.col("n0") / F.lit(float(n0))) / F.sqrt(share * (1 - share) + F.lit(1e-9))
    return [r["feature"] for r in counted.withColumn("z", z).orderBy(F.desc("z"), "feature").limit(keep).select("feature").collect()]


def _train_rows(index: dict[str, int]):
    """For each text the chosen features it has; for each sentence with an identity term those that a swap adds and removes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                lowered = text.as_py().lower()
                pick = lambda fs: sorted(index[f] for f in fs if f in index)
                out.append((y.as_py(), pick(features(_words(lowered))), []))
                for sentence in _sentences(lowered):
                    words = _words(sentence)
                    if not _next_term.keys().isdisjoint(words):
                        before, after = features(words), features(swapped(words))
                        if moved := (pick(after - before), pick(before - after)):
                            out.append((-1, *moved))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.list_(pa.int32())) for c in columns[1:])],
                                             names=["y", "plus", "minus"])
    return run


def _sparse(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and column numbers of ones."""
    return (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((i for r in rows for i in r), np.int64))


def fit(texts: Sequence[Sequence[int]], y: np.ndarray, swaps: Sequence[tuple[Sequence[int], Sequence[int]]], n: int,
        sparsity: float = SPARSITY, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps."""
    row, column = _sparse(texts)
    r1, c1 = _sparse([a for a, _ in swaps])
    r2, c2 = _sparse([b for _, b in swaps])
    w, b = np.zeros(n), 0.0
    v, vb, momentum = w.copy(), b, 1.0
    # The curvature is at most a quarter of the largest squared row norm, plus that of the swaps.
    size = 1 + max((len(t) for t in texts), default=0)
    moves = max((len(a) + len(c) for a, c in swaps), default=0)
    rate = 1 / (0.25 * min(size, 40) + 2 * counterfactual * moves + 1e-9)

    def value_and_slope(w: np.ndarray, b: float):
        z = np.bincount(row, w[column], len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = np.mean(np.logaddexp(0, z) - y * z)
        g = (p - y) / len(y)
        slope = np.bincount(column, g[row], n)
        if swaps:
            change = np.bincount(r1, w[c1], len(swaps)) - np.bincount(r2, w[c2], len(swaps))
            loss += counterfactual * np.mean(change ** 2)
            push = 2 * counterfactual * change / len(swaps)
            slope += np.bincount(c1, push[r1], n) - np.bincount(c2, push[r2], n)
        return loss, slope, g.sum()

    for _ in range(steps):
        loss, slope, slope_b = value_and_slope(v, vb)
        while True:  # halve the step until the quadratic bound holds
            new = v - rate * slope
            new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
            new_b = vb - rate * slope_b
            d, db = new - v, new_b - vb
            if value_and_slope(new, new_b)[0] <= loss + slope @ d + slope_b * db + (d @ d + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v = new + (momentum - 1) / following * (new - w)
        vb = new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new, new_b, following
    return b, w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = PER_CLASS,
          counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on at most ``per_class`` labelled ids of each class outside the held-out fold.

    Only chosen features of these texts come to the driver. Without both classes the model knows
    nothing: it gives every text the share of toxic labels, one half without any.
    """
    sample = labelled_sample(docs, labels, label, folds, fold, per_class)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model(float(np.log(p / (1 - p))), {})
    names = choose_features(sample, n0, n1)
    rows = sample.select("text", "y").mapInArrow(_train_rows({f: i for i, f in enumerate(names)}), "y int, plus array<int>, minus array<int>").collect()
    rows.sort(key=lambda r: (r["y"], r["plus"], r["minus"]))
    texts = [r for r in rows if r["y"] >= 0]
    swaps = [(r["plus"], r["minus"]) for r in rows if r["y"] < 0 and (r["plus"] or r["minus"])]
    bias, w = fit([r["plus"] for r in texts], np.array([r["y"] for r in texts], float), swaps, len(names), counterfactual=counterfactual)
    return Model(float(bias), {f: float(x) for f, x in zip(names, w, strict=True) if x})


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns and the score of every row; a null text scores as an empty one.

    A kept text travels once, and a few rows at a time come back.
    """
    columns = list(dict.fromkeys([id_column, *keep]))
    kept = docs.select(*columns)
    carried = text_column in columns and kept.schema[text_column].dataType.simpleString() == "string"
    read = text_column if carried else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                scores = pa.array([model.score(t.as_py() or "") for t in batch.column(read)], pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), scores], names=[*columns, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double"
    return (kept if carried else docs.select(*columns, text_of(text_column).alias("_text"))).mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_class: int = PER_CLASS,
                    counterfactual: float = COUNTERFACTUAL) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty texts are scored too."""
    scored = score_documents(docs, train(docs, labels, "toxic", folds, fold, per_class, counterfactual))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
