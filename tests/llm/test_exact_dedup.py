"""Content sort against a dictionary of normalised texts."""

import hashlib
import string
from collections import defaultdict

import pytest

from pointloom.llm.exact_dedup import content_sort

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows():
    out = [(i, ["Same Text", "same text", "É accent", "é accent", "", None, " ", "x" * 200_000][i % 8], "keep") for i in range(400)]
    return out + [(1000 + i, f"only {i}", None) for i in range(60)] + [(None, "same text", ""), (None, "nobody", ""), (None, "nobody", ""), (399, "only once", "a"), (399, "only once", "a")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups(spark, keep):
    data = rows()
    got = content_sort(spark.createDataFrame(data, "doc_id long, text string, keep_id string").repartition(5), keep=keep).collect()
    groups = defaultdict(list)
    for i, t, _ in data:
        groups[(t or "").translate(LOWER)].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(data)
    kept = defaultdict(list)
    for r in got:
        ids = [i for i in by_sha[r.text_sha256] if i is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        assert (r.keep_id, r.group_size) == (best, len(by_sha[r.text_sha256]))
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {s: [(max if keep == "largest" else min)([i for i in ids if i is not None], default=None)] for s, ids in by_sha.items()} == dict(kept)


def test_nothing(spark):
    assert content_sort(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        content_sort(spark.createDataFrame([], "doc_id long, text string"), keep="first")
