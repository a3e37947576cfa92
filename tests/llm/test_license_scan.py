"""Phrase places and template blocks against plain loops over all blocks."""

import random
import re
import string

from pointloom.llm.license_scan import BLOCK, NAMES, PHRASES, SPREAD, TEMPLATES, WORD, scan_licenses

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    found = set()
    step = BLOCK // 2
    for at in range(0, max(1, len(words) - step), step):
        block = words[at:at + BLOCK]
        for label, t in TEMPLATES:
            tokens, width = set(t.split()), int(SPREAD * len(t.split()))
            stretches = [set(block[i:i + width]) for i in range(len(block))]
            met = max((len(tokens & s) for s in stretches if NAMES & tokens <= s), default=0)
            if met >= 0.8 * len(tokens) - 1e-9:
                found.add((at, label, met / len(tokens)))
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {f[1] for f in found})), 1.0 if base else max((f[2] for f in found), default=0.0), found)


def texts():
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()}) + ["filler", "other", "naïve", "x9"] * 10
    yield from [None, "", "...", "CC BY", "cc by cc by", "cc-by-nc", "CC\nBY sa", "acc by", "All  Rights, Reserved. all rights reserved", "word " * 120_000 + "cc by",
                "GNU General Public LICENSE", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License"]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if rng.random() < .7:
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in rng.choice(TEMPLATES)[1].split() if rng.random() < .9]
        yield " ".join(words)


def test_against_loops(spark):
    data = [(i if i % 9 else None, t, "extra") for i, t in enumerate(texts())]
    data += data[-2:]
    got = scan_licenses(spark.createDataFrame(data, "doc_id long, text string, labels string").repartition(3)).collect()
    key = lambda row: str(row[:9])
    ours = sorted(((r.doc_id, *r[1:8], tuple(sorted({(b.word, b.label, b.containment) for b in r.blocks}))) for r in got), key=key)
    theirs = sorted(((i, *(b := brute(t))[:7], tuple(sorted(b[7]))) for i, t, _ in data), key=key)
    assert ours == theirs


def test_every_stretch_fits_half_a_block():
    assert max(int(SPREAD * len(t.split())) for _, t in TEMPLATES) <= BLOCK // 2


def test_licences_are_told_apart(spark):
    notice = "under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cases = [
        ("This text is licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"),
        (notice.format(""), "gpl"),
        (notice.format("Lesser "), "gpl,lgpl"),
        (notice.format("Affero "), "agpl,gpl"),
        ("The album was released under the old license of the label", ""),
        ("Released under the MIT license", "mit"),
        ("Released, under the terms of, the MIT License", "mit"),
        # The same words far apart.
        ("released " + "x " * 20 + "under " + "x " * 20 + "the MIT " + "x " * 15 + "license", ""),
    ]
    out = scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in out.collect()} == {i: label for i, (_, label) in enumerate(cases)}


def test_nothing(spark):
    out = scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == []
