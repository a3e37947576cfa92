"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a vector of surface features of the line and of both
neighbours; the chain adds how likely each label follows each other. The field is fitted by maximum
likelihood on labelled documents whose lines all carry the document's label. Forward and backward sums
give each line's marginal; a document's score is their mean, weighted by the lines' lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import text_of
from pointloom.llm.labelled import held_out, labelled_sample

#: Labelled ids of each class that are used at most; of these, texts with more lines are left out of the fit.
PER_CLASS = 1500
LINES = 2000
#: Strength of the squared penalty and steps of the fit.
RIDGE = 1e-3
STEPS = 250
#: Lines that are padded and summed together.
CELLS = 1 << 16

_SYMBOLS = "$%#&*@<>{}[]=+~^_\\/"
#: A raw feature becomes one indicator for each of these values that it exceeds.
_LEVELS = (
    ("distinct words", (0.3, 0.5, 0.7, 0.85, 0.95)),
    ("words equal to the one before", (0.02, 0.1, 0.3, 0.6)),
    ("words without small letters", (0.05, 0.2, 0.5, 0.8)),
    ("bars", (0.02, 0.1, 0.3)),
    ("exclamation marks", (0.02, 0.2, 0.6)),
    ("symbols", (0.02, 0.1, 0.4, 1.0)),
    ("digits", (0.05, 0.3, 1.0)),
    ("commas and stops", (0.02, 0.08, 0.2, 0.5)),
    ("characters per word", (2.5, 4.0, 6.0, 9.0, 14.0)),
    ("words, as a logarithm", (0.5, 1.5, 2.5, 3.5, 5.0)),
    ("ends like a sentence", (0.5,)),
    ("starts with a capital", (0.5,)),
)
WIDTH = 1 + sum(len(levels) for _, levels in _LEVELS)
FEATURES = 3 * WIDTH + 2


def raw_features(line: str) -> tuple[float, ...]:
    words = line.split()
    n = len(words)
    if not n:
        return (1.0,) + (0.0,) * (len(_LEVELS) - 1)
    return (len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            sum(map(str.isupper, words)) / n,
            line.count("|") / n,
            line.count("!") / n,
            sum(map(line.count, _SYMBOLS)) / n,
            sum(map(line.count, "0123456789")) / n,
            (line.count(",") + line.count(".")) / n,
            len(line) / n,
            math.log(n),
            float(words[-1][-1] in ".!?:;"),
            float(words[0][0].isupper()))


def _own_features(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicators of each line of all texts, and which lines are first and last of their text."""
    raw = np.array([raw_features(line) for text in lines for line in text], np.float64).reshape(-1, len(_LEVELS))
    own = np.ones((len(raw), WIDTH), np.float32)
    at = 1
    for i, (_, levels) in enumerate(_LEVELS):
        own[:, at:at + len(levels)] = raw[:, [i]] > np.array(levels)
        at += len(levels)
    ends = np.cumsum([len(t) for t in lines])
    first, last = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    first[np.r_[0, ends[:-1]]] = True
    last[ends - 1] = True
    return own, first, last


def line_features(lines: list[list[str]]) -> np.ndarray:
    """Indicators of each line, of the line before and of the line after, and two for the text's ends."""
    own, first, last = _own_features(lines)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None]]).astype(np.float32)


def line_evidence(lines: list[list[str]], weights: np.ndarray) -> np.ndarray:
    """``line_features(lines) @ weights`` without the wide matrix."""
    own, first, last = _own_features(lines)
    here, before, after = (own @ weights[:3 * WIDTH].reshape(3, WIDTH).T.astype(np.float32)).T.astype(np.float64)
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[first], after[last] = 0, 0
    return here + before + after + first * weights[-2] + last * weights[-1]


@dataclass(frozen=True)
class Chain:
    """Weights of the evidence for a good line, and the value of each label after each other."""

    weights: np.ndarray
    steps: np.ndarray


def _padded(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows, lines as columns, and which cells are lines."""
    inside = np.arange(lengths.max())[None, :] < lengths[:, None]
    out = np.zeros(inside.shape)
    out[inside] = values
    return out, inside


def marginals(chain: Chain, evidence: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For padded texts: each line's probability of being good, expected label steps, and log normaliser.

    ``evidence`` holds the lines of all texts in a row. Sums are over logarithms.
    """
    e, inside = _padded(evidence, lengths)
    n, t = e.shape
    unary = np.stack([np.zeros_like(e), e], 2)
    forward = np.empty((n, t, 2))
    forward[:, 0] = unary[:, 0]
    for k in range(1, t):
        new = np.logaddexp(forward[:, k - 1, [0]] + chain.steps[0], forward[:, k - 1, [1]] + chain.steps[1]) + unary[:, k]
        forward[:, k] = np.where(inside[:, [k]], new, forward[:, k - 1])  # past the end, the last sums stay
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros((n, t, 2))
    expected = np.zeros((n, 2, 2))
    for k in range(t - 1, 0, -1):
        ahead = unary[:, k] + backward[:, k]
        new = np.logaddexp(chain.steps[:, 0] + ahead[:, [0]], chain.steps[:, 1] + ahead[:, [1]])
        pair = np.exp(np.minimum(forward[:, k - 1, :, None] + chain.steps + ahead[:, None, :] - total[:, None, None], 0))
        expected += np.where(inside[:, k, None, None], pair, 0)
        backward[:, k - 1] = np.where(inside[:, [k]], new, 0)
    good = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0))
    return good[inside], expected, total


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Chain:
    """Maximum likelihood with a squared penalty; all lines of a text carry its label."""
    order = np.argsort(lengths, kind="stable")
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    rows = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in order])
    features, lengths, labels = features[rows].astype(np.float64), lengths[order], labels[order]
    line_labels = np.repeat(labels, lengths)
    pieces, begin = [], 0
    while begin < len(lengths):  # texts of like lengths are padded together
        end = begin + 1
        while end < len(lengths) and (end + 1 - begin) * lengths[end] <= CELLS:
            end += 1
        pieces.append((begin, end))
        begin = end
    ends = np.cumsum(lengths)
    # Each class weighs the same, so that a rare label is not drowned.
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    seen = np.array([[(weight * (lengths - 1))[labels == 0].sum(), 0], [0, (weight * (lengths - 1))[labels == 1].sum()]])
    line_weight = np.repeat(weight, lengths)

    def slope(w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chain, evidence = Chain(w, a), features @ w
        good, expected = np.empty(len(evidence)), np.zeros((2, 2))
        for begin, end in pieces:
            at = slice(ends[begin] - lengths[begin], ends[end - 1])
            good[at], pair, _ = marginals(chain, evidence[at], lengths[begin:end])
            expected += np.tensordot(weight[begin:end], pair, 1)
        return features.T @ (line_weight * (good - line_labels)) + ridge * w, expected - seen + ridge * a

    w, a = np.zeros(features.shape[1]), np.zeros((2, 2))
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    for k in range(1, steps + 1):  # steps of moments, shrinking towards the end
        gw, ga = slope(w, a)
        mw, vw, ma, va = .9 * mw + .1 * gw, .99 * vw + .01 * gw ** 2, .9 * ma + .1 * ga, .99 * va + .01 * ga ** 2
        rate = 0.1 * (1 - (k - 1) / steps)
        w = w - rate * (mw / (1 - .9 ** k)) / (np.sqrt(vw / (1 - .99 ** k)) + 1e-8)
        a = a - rate * (ma / (1 - .9 ** k)) / (np.sqrt(va / (1 - .99 ** k)) + 1e-8)
    return Chain(w, a)


def score_texts(chain: Chain, texts: list[str]) -> list[float]:
    """Length-weighted mean of the lines' marginals, for each text; an empty text is one empty line."""
    out = np.empty(len(texts))
    order = sorted(range(len(texts)), key=lambda i: texts[i].count("\n"))
    begin = 0
    while begin < len(order):
        end, widest = begin, 0
        while end < len(order):
            widest = max(widest, texts[order[end]].count("\n") + 1)
            if end > begin and (end + 1 - begin) * widest > CELLS:
                break
            end += 1
        lines = [texts[i].split("\n") for i in order[begin:end]]
        lengths = np.array([len(t) for t in lines])
        good, _, _ = marginals(chain, line_evidence(lines, chain.weights), lengths)
        weight = np.array([len(line) + 1 for t in lines for line in t], float)
        at = np.r_[0, np.cumsum(lengths)[:-1]]
        out[order[begin:end]] = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)
        begin = end
    return np.clip(out, 0, 1).tolist()


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [(i, y, t.split("\n")) for i, y, t in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True)
                if t.count("\n") < LINES]
        packed = [np.packbits(line_features([lines]).astype(bool), axis=1).tobytes() for _, _, lines in kept]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int32()), pa.array(packed, pa.binary())],
                                         names=["doc_id", "y", "bits"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, per_class: int = PER_CLASS) -> Chain:
    """Fit on at most ``per_class`` labelled ids of each class outside the held-out fold.

    Only their lines' features, as bits, come to the driver: at most ``LINES`` lines a text. Without
    both classes every line is as likely good as bad.
    """
    sample = labelled_sample(docs, labels, label, folds, fold, per_class)
    rows = sample.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(_train_rows, "doc_id long, y int, bits binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["bits"])))
    if len({r["y"] for r in rows}) < 2:
        return Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    width = (FEATURES + 7) // 8
    bits = [np.frombuffer(r["bits"], np.uint8).reshape(-1, width) for r in rows]
    return fit(np.unpackbits(np.concatenate(bits), axis=1)[:, :FEATURES], np.array([len(b) for b in bits]), np.array([r["y"] for r in rows]))


def score_documents(docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and score of every row; a null text scores as an empty one. Other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(chain, part.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(
        run, f"id {id_type}, score double").withColumnRenamed("id", id_column)


def quality_report(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty texts are scored too."""
    scored = score_documents(docs, train(docs, labels, "quality", folds, fold, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
