"""Packing against the tokenizers library, a plain first fit, and the rules of a piece."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pointloom.llm.packing import Encoder, Tournament, pack, pack_documents

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return Encoder(f.read())


def test_ids_are_the_librarys(library, encoder):
    rng = random.Random(4)
    texts = ["", " ", "it's WE'LL 'dare '' 's't", "a<|endoftext|>b", "Ｆｕｌｌ ⅷ ²³ ǅ ß İi ŉ", "é ́x ö", "x\x1cy\x85z\xa0w v u", "ΑΣ ΑΣΑ", "漢字 👍🏽 ١٢"]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x2200, 64)]
    texts += [f"a{chr(c)}b {chr(c)}1{chr(c)}'s" for c in range(0x340)]
    pool = [chr(c) for c in range(0x300)] + list("   '''sdtrevml19.,")
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_go_through_the_library():
    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encode = Encoder(f.read())
    text = "It's  a Test,\n naïve 12"
    assert np.frombuffer(encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 100), max_size=60))
def test_tournament_finds_the_first_that_fits(needs):
    tree, room = Tournament(len(needs), 100), [100] * len(needs)
    for need in needs:
        at = next(i for i, r in enumerate(room) if r >= need)
        room[at] -= need
        assert tree.first(need) == at


def rules(sequences, lengths, size):
    """Every token once, no sequence padded."""
    seen = defaultdict(list)
    for pieces in sequences:
        n = sum(p[2] for p in pieces)
        assert n == size or n & (n - 1) == 0
        for doc, start, length in pieces:
            assert length > 0
            seen[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n


@settings(max_examples=300)
@given(st.lists(st.integers(1, 200), max_size=80), st.sampled_from([1, 2, 16, 64]))
def test_pack(lengths, size):
    sequences = pack(lengths, size)
    rules(sequences, lengths, size)
    assert len(sequences) <= sum(lengths) // size + size.bit_length()


def test_rests_that_fit_are_not_cut():
    assert sorted(map(sorted, pack([5, 3, 6, 2, 8, 16 + 8], 8))) == [
        [(0, 0, 5), (1, 0, 3)], [(2, 0, 6), (3, 0, 2)], [(4, 0, 8)], [(5, 0, 8)], [(5, 8, 8)], [(5, 16, 8)]]


def check(rows, texts, library, size):
    """Rows against the texts by position in a list of (id, text)."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or 0 < at < size and at & (at - 1) == 0
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [1])
    assert set(wanted) == set(by_doc)
    for doc_id, docs in wanted.items():
        if len(docs) == 1:
            [ids] = docs
            got = sorted(by_doc[doc_id], key=lambda r: r.start)
            assert [x for r in got for x in r.ids] == ids
            assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in got)
        else:
            assert sorted(x for r in by_doc[doc_id] for x in r.ids) == sorted(x for ids in docs for x in ids)


@pytest.mark.parametrize("group", [7, 4096])
def test_documents(spark, library, group):
    rng = random.Random(9)
    words = "the naïve River 3 tokens, it's übel x".split()
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, text(9000)), (503, " \n "), (None, "null id"), (None, text(5)), (504, "same"), (504, "same"), (504, "same"), (505, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, ids int, start int, id string").repartition(3)
    got = pack_documents(df, PATH, 64, group_docs=group, group_tokens=3000).collect()
    check(got, rows, library, 64)
    assert got[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def test_query_on_the_small_tables(spark, library):
    """The registered query with its own parameters, and its padding."""
    from pointloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_packing"](spark, folder).collect()
    ids = {d.doc_id: library.encode(d.text or "", add_special_tokens=False).ids + [1] for d in docs}
    assert len(ids) == len(docs)
    lengths, places = defaultdict(int), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        lengths[r.sequence_id] += r.length
        places[r.doc_id].append((r.start, r.length))
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in lengths.values())
    assert {d: sum(n for _, n in p) for d, p in places.items()} == {d: len(x) for d, x in ids.items()}


def test_nothing(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError):
        pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, size=100)
