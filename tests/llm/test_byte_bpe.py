"""Ids and bytes against the tiktoken library over awkward texts."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from pointloom.llm.byte_bpe import Codec, encode_documents, model_bytes, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = " \t\n\r 　 \x1c\x85aAbeéßñ漢字😀́'0٣.,!|#\x00￿<|endoftext|>sdrvtlm"


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


def texts():
    rng = random.Random(5)
    yield from ["", " ", "\n\n \n", "Don't we'll I'D", "a" * 3000, "<|endoftext|>", "é" * 50 + "  x  ", "👩‍👩‍👧 family", "  " * 400 + "x"]
    for _ in range(400):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60)))


def test_codec_equals_tiktoken(ranks):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = Codec(ranks, P.PATTERN)
    for text in [*texts(), *(chr(c) + "a " + chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000)]:
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text), repr(text)
        assert ours.decode(ids) == text.encode()


def test_documents_with_nulls_repeats_and_other_columns(spark, ranks):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "The cat's whiskers", "x"), (1, "The cat's whiskers", "x"), (None, "naïve", None), (3, None, "y"), (4, "", "z"), (5, "word " * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(docs, PATH, P.PATTERN, with_text=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), theirs.encode_ordinary(t or ""), t or "") for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    empty = encode_documents(docs.where("false"), PATH, P.PATTERN, with_ids=False)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_vocabularies_that_cannot_be_written_are_refused():
    with pytest.raises(ValueError, match="gaps"):
        model_bytes({b"a": 0, b"b": 2})
    with pytest.raises(ValueError, match="256"):
        model_bytes({b"a": 0, b"b": 1})


def test_remembered_words_share_their_numbers_and_are_bounded(ranks):
    codec = Codec(ranks, P.PATTERN)
    first, second = codec.encode(" zzyzxqq zzyzxqv"), codec.encode(" zzyzxqw")
    shared = {i for i in first if i > 256} & {i for i in second if i > 256}
    assert shared and all(len({id(x) for x in [*first, *second] if x == i}) == 1 for i in shared)
    for part in range(13):
        codec.encode("".join(f" q{chr(97 + part)}{''.join(chr(97 + int(c)) for c in f'{i:05}')}" for i in range(10_000)))
    assert len(codec._known) <= 110_000


def test_many_texts_are_encoded_as_one_and_met_words_stay_remembered(ranks, monkeypatch):
    import pointloom.llm.byte_bpe as byte_bpe

    codec, new = Codec(ranks, P.PATTERN), []
    learn = codec._encode_new
    monkeypatch.setattr(codec, "_encode_new", lambda words: (new.extend(words), learn(words)))
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 200)
    common = [f" zq{chr(97 + i)}common" for i in range(26)]
    for part in range(40):
        words = [*common, *(f" rare{chr(97 + part % 26)}{chr(97 + part // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)), " \n", "12"]
        texts = ["".join(words[:30]), "", "".join(words[30:])]
        for text, ids in zip(texts, codec.encode_many(texts), strict=True):
            assert codec.decode(ids.tolist()) == text.encode()
        assert len(codec._known) <= 300 and len(codec._older) <= 300
    # Words met in every part were encoded once, however many others came.
    assert all(new.count(w) == 1 for w in common) and len(new) > 2_000


def test_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    import pointloom.llm.byte_bpe as byte_bpe

    monkeypatch.setattr(byte_bpe, "CHARACTERS", 10)
    monkeypatch.setattr(byte_bpe, "ROWS", 3)
    texts = ["a" * 4, "b" * 6, "c" * 30, "", "d", "e", "f", "", "", "g" * 11]
    got = list(byte_bpe._pieces(pa.array(texts)))
    assert [at for at, _ in got] == [0, 2, 3, 6, 9] and [t for _, piece in got for t in piece] == texts
