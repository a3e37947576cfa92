"""Dropped lines against a dictionary of every template's first document."""

import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm.line_dedup import drop_recurring_lines, line_report
from pointloom.llm.queries import QUERIES

DIGIT = re.compile(r"\d")


def templates(line):
    t = ["<*>" if DIGIT.search(x) else x for x in line.split()]
    n = len(t)
    if n < 3:
        return
    yield (n, tuple(t[:3]), None, tuple(t))
    if n >= 8:
        cuts = [3 + (n - 3) * i // 5 for i in range(6)]
        for i in range(5):
            yield (n, tuple(t[:3]), i, tuple(t[:cuts[i]]), tuple(t[cuts[i + 1]:]))


def expected(rows):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda d: d[:2])
    first = {}
    for d in docs:
        for line in d[2].split("\n"):
            for k in templates(line):
                first.setdefault(k, d)
    out = []
    for i, t in rows:
        me = (i is None, i or 0, t or "")
        out.append((i, "\n".join(x for x in (t or "").split("\n") if all(first[k] == me for k in templates(x)))))
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice("ka lo mi nu re sa to be do fi ga hu".split())
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in (2, 3, 7, 8, 14, 40)]
    rows = []
    for i in range(250):
        lines = [line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        for s in shared:
            if rng.random() < .3:
                tokens = s.split()
                if rng.random() < .5:
                    tokens[rng.randrange(len(tokens))] = word()
                lines.insert(rng.randrange(len(lines)), " ".join(tokens))
        lines.append(f"logged at {i}:0{i % 7} by user{i}")
        rows.append((i, "\n".join(lines)))
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(400, None), (401, ""), (402, "\n\n \n"), (403, "two tokens\n" * 3), (404, "same line here again\n" * 20_000), (405, "a b c " * 50_000),
             (10, rows[10][1]), (None, rows[10][1]), (None, "only here is this line\nonce more it is")]
    rng.shuffle(rows)
    return rows


def test_lines_left(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 5, False) for i, t in rows], "doc_id long, text string, lang string, line int, has_text boolean").repartition(4)
    got = drop_recurring_lines(df, keep=("lang",))
    assert got.columns == ["doc_id", "lang", "text", "n_lines", "n_dropped", "has_text"]
    got = got.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(expected(rows), key=str)
    for r in got:
        assert r.n_lines - r.n_dropped == (len(r.text.split("\n")) if r.n_lines > r.n_dropped else 0)
        assert r.has_text == (bool(r.text.strip()) or not r.n_dropped)
    report = line_report(df).collect()
    assert sorted((str(r.doc_id), r.text_sha256, r.n_chars_left) for r in report) == sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest(), len(r.text)) for r in got)


def test_fields_vary(spark):
    docs = spark.createDataFrame([(1, "job 17 took 3.5 s on node a1"), (2, "job 99 took 8 s on node b2"), (3, "job one took long on node c"),
                                  (4, "one two three four five six seven eight"), (5, "one two three four five SIX seven eight"), (6, "one two three four five SIX seven EIGHT")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in drop_recurring_lines(docs).collect()}
    assert [k for k, v in sorted(left.items()) if v] == [1, 3, 4]


def test_nothing(spark):
    assert line_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_lines_recur_word_for_word(spark, tmp_path):
    rows = [(1, "Haanth.\nsome line of its own\nPage 3"), (2, "Haanth.\nsome line of its own\nPage 3"), (3, "Haanth.\nPage 4\n\nhaanth."), (4, "  Page\t4 \nHaanth. Page")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: (r.n_lines, r.n_dropped) for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert left == {1: (3, 0), 2: (3, 3), 3: (4, 1), 4: (2, 1)}
    staged = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert staged == {1: rows[0][1], 3: "Page 4\n\nhaanth.", 4: "Haanth. Page"}
