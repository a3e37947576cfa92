"""Licence statements: phrases counted exactly, and templates found by a set-similarity join.

A text block is a window of ``BLOCK`` words; windows start every half block, so every run of up to
half a block of words lies in one of them whole. A block can meet a template only if it holds at least
``threshold`` of the template's distinct words. The join finds every such pair:

* words are ordered by how many documents of the corpus hold them, rare first;
* prefix filter: a block that holds k of a template's n words holds one of the n - k + 1 rarest, so
  only those are looked up;
* length filter: a block with fewer than k distinct words cannot meet it;
* positional filter: once too few of the template's words are left, counting stops.

Words alike are not enough for short templates, so a pair that passes must also hold the words that name
the licence, and the words that it shares must stand close together: in a stretch of ``SPREAD`` times the
template's length. The containment is that of the best stretch.

The templates are few and of fixed size, so they go to every task; documents never leave theirs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import lower_az, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64
THRESHOLD = 0.8
#: Length of the stretch that must hold the words, in lengths of the template. Half a block holds the stretch of every template below.
SPREAD = 1.4

#: Phrases whose places are counted, with their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements by which licences are known, with labels. Fixed values.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words by which licences are told apart; a statement with one is found only where that word stands. Fixed values.
NAMES = frozenset(("affero", "apache", "attribution", "commons", "creative", "gnu", "lesser", "mit", "mozilla", "nc", "sa"))


@dataclass(frozen=True)
class Template:
    """Distinct words in global order, the number that must be met, the words that are looked up, those that must be there, and the stretch that holds them."""

    label: str
    words: tuple[str, ...]
    needed: int
    prefix: tuple[str, ...]
    names: frozenset[str]
    span: int


def order_templates(templates: Sequence[tuple[str, str]], frequency: Mapping[str, int], threshold: float) -> list[Template]:
    """Put each template's words in the global order and cut its prefix."""
    out = []
    for label, text in templates:
        found = re.findall(WORD, text)
        words = tuple(sorted(set(found), key=lambda w: (frequency.get(w, 0), w)))
        needed = max(1, math.ceil(threshold * len(words) - 1e-9))
        out.append(Template(label, words, needed, words[:len(words) - needed + 1], NAMES & set(words), math.floor(SPREAD * len(found))))
    return out


def closest(words: Sequence[str], t: Template) -> int:
    """Most distinct words of the template that stand in one stretch of its span with all its names; 0 without such a stretch."""
    places = [(i, w) for i, w in enumerate(words) if w in t.words]
    inside: dict[str, int] = {}
    best = first = 0
    for i, w in places:
        inside[w] = inside.get(w, 0) + 1
        while places[first][0] <= i - t.span:
            gone = places[first][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            first += 1
        if len(inside) > best and t.names <= inside.keys():
            best = len(inside)
    return best


def document_frequency(docs: DataFrame, words: Sequence[str], text_column: str = "text") -> dict[str, int]:
    """How many documents hold each of the given words: as many rows as words come to the driver."""
    held = F.array_intersect(F.regexp_extract_all(lower_az(text_of(text_column)), F.lit(WORD), F.lit(0)),
                             F.array(*(F.lit(w) for w in sorted(words))))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


class Scanner:
    """Look through one text after another."""

    def __init__(self, phrases: Mapping[str, str], templates: Sequence[Template], block: int = BLOCK):
        self._find = re.compile(WORD).findall
        self._phrases = [(f" {phrase} ", label) for phrase, label in phrases.items()]
        self._templates = templates
        self._step = max(1, block // 2)
        self._rare: dict[str, list[int]] = {}
        for i, t in enumerate(templates):
            for w in t.prefix:
                self._rare.setdefault(w, []).append(i)

    def phrases(self, words: list[str]) -> tuple[int, int | None, int | None, set[str]]:
        """Number of places, first and last start, labels."""
        line = " " + " ".join(words) + " "
        n, starts, labels = 0, [], set()
        for closed, label in self._phrases:
            at = line.find(closed)
            if at < 0:
                continue
            labels.add(label)
            starts += [line.count(" ", 0, at), line.count(" ", 0, line.rfind(closed))]
            while at >= 0:
                n += 1
                at = line.find(closed, at + 1)
        return n, min(starts, default=None), max(starts, default=None), labels

    def blocks(self, words: list[str]) -> Iterator[tuple[int, str, float]]:
        """Start of the block, label and containment of every block that meets a template."""
        rare = self._rare.keys() & set(words)
        if not rare:
            return
        candidates: dict[int, set[int]] = {}  # blocks to look at, by number, with their templates
        last = max(0, math.ceil(len(words) / self._step) - 2)  # the last block that is not inside the one before
        for i, w in enumerate(words):
            if w in rare:
                b = i // self._step
                for k in {min(b, last), max(0, min(b - 1, last))}:
                    candidates.setdefault(k, set()).update(self._rare[w])
        for k in sorted(candidates):
            block = words[k * self._step:(k + 2) * self._step]
            held = set(block)
            for i in sorted(candidates[k]):
                t = self._templates[i]
                if len(held) < t.needed:
                    continue
                met, left = 0, len(t.words)
                for w in t.words:
                    left -= 1
                    met += w in held
                    if met + left < t.needed:
                        break
                if met < t.needed or not t.names <= held:
                    continue
                met = closest(block, t)
                if met >= t.needed:
                    yield k * self._step, t.label, met / len(t.words)

    def scan(self, text: str) -> tuple:
        words = self._find(text)
        n, first, last, labels = self.phrases(words)
        found = list(self.blocks(words))
        score = 1.0 if labels else max((c for _, _, c in found), default=0.0)
        return (len(words), n, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {label for _, label, _ in found})), score,
                [{"word": at, "label": label, "containment": c} for at, label, c in found])


_FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
           ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
           ("blocks", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))))
_SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "blocks array<struct<word: long, label: string, containment: double>>")


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", phrases: Mapping[str, str] = PHRASES,
                  templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    A-Z is lower-cased. ``n_base`` counts all places of the phrases, overlapping ones too. Labels are
    distinct, sorted and joined by commas; none give an empty string. ``score`` is 1 with a phrase,
    else the best containment of a block that meets a template, else 0. ``blocks`` lists every block
    found: its first word, label and containment. A template with words of ``NAMES`` is met only where all of them stand. A null or empty text has no words and finds nothing.
    Repeated rows are scanned each; other columns are ignored.
    """
    known = {w for _, text in templates for w in re.findall(WORD, text)}
    scanner = Scanner(phrases, order_templates(templates, document_frequency(docs, known, text_column), threshold), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(scanner.scan(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True))],
                names=["id", *(name for name, _ in _FIELDS)])

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), lower_az(text_of(text_column)).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, {_SCHEMA}").withColumnRenamed("id", id_column)
