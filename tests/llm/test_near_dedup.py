"""Components against exact sets of all pairs, and the parts they are made of."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from pointloom.llm.components import components
from pointloom.llm.linking import link_groups
from pointloom.llm.near_dedup import near_duplicates, one_of_each
from pointloom.llm.shingles import sketch

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    vocabulary = [a + b for a in "ka lo mi nu re sa to".split() for b in "ben dor fin gal hus".split()]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = words(120), []
    for g in range(30):
        base = words(rng.choice([3, 5, 9, 40, 120, 300]))
        for c in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy).title() if c % 2 else "  ".join(copy))
    base = words(150)
    for i in range(220):  # one large group of near copies
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(150)] = f"edit{i}"
        out.append(" ".join(copy))
    for _ in range(150):  # a passage that many share
        out.append(" ".join(words(150) + passage))
    out += [out[0]] * 40 + ["", None, " \n", "one", "ONE", "one two"]
    rows = [(1000 - i, t) for i, t in enumerate(out)]
    rows += [(None, out[0]), (None, "a text of nobody at all here"), (5, out[3]), (5, out[3]), (6, "long " * 60_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [256, 16])
def test_components_equal_all_pairs(spark, limit):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, key string").repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(df, limit=limit).collect()), key=str)
    assert got == brute(rows)


def test_nothing_and_blank(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(blank).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(400, 401), (401, 400), (500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}, 400: 400, 401: 400}


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, best string").repartition(5)
    out = one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    blank = [(d, t) for d, t in rows if not shingles(t)]
    heads = {least for _, n, least, _ in brute(rows) if n and least is not None}
    assert sorted((g for g in got if not shingles(g[1])), key=str) == sorted(blank, key=str)
    named = [g[0] for g in got if shingles(g[1]) and g[0] is not None]
    assert sorted(named) == sorted(heads)
    assert [t for d, t in got if d is None and shingles(t)] == ["a text of nobody at all here"]


def test_links_between_any_blocks_of_a_large_node(spark):
    rng = random.Random(4)
    texts = []
    for i in range(40):  # unlike sets, each with one near copy
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:-1], f"end{i}"])]
    sets = sketch(spark.createDataFrame([(t, t) for t in texts], "text string, t string"), 64, 5).withColumnRenamed("set_key", "key")
    sets = spark.createDataFrame(sets.collect(), sets.schema)
    groups = sets.select(F.lit(1).alias("grp"), F.lit(len(texts)).alias("n"), "key")

    def texts_of(keys):
        return keys.join(sets, F.col("w") == F.col("key")).select("key", F.col("t").alias("text"))

    label = {bytes(r.node): r.label for r in link_groups(groups, sets, texts_of, .6, 85, limit=8).collect()}
    key = {r.t: bytes(r.key) for r in sets.collect()}
    lost = [i for i in range(40) if key[texts[2 * i]] not in label or label[key[texts[2 * i]]] != label.get(key[texts[2 * i + 1]])]
    assert not lost and len(set(label.values())) == 40
