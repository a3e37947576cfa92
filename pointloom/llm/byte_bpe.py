"""Byte-level BPE through a sentencepiece model that is written out from the vocabulary.

A rank file (base64 bytes and rank on each line) becomes a sentencepiece BPE model: every vocabulary
entry is a piece whose characters stand for its bytes and whose score is its negative rank, so the
merge with the best score is the merge with the lowest rank. Nothing is trained and nothing is
normalised. Texts are split into pre-tokens first; each pre-token is encoded alone and decoded by the
inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.common import text_of

#: Byte b is written as this character plus b: letters without any meaning to sentencepiece.
FIRST_CHARACTER = 0x4E00
#: Pre-tokens whose ids a worker remembers before it forgets those that were not met since the last time.
REMEMBERED = 100_000
#: Rows are handled this many at a time, and fewer where they have more characters than these.
ROWS = 256
CHARACTERS = 1 << 18
#: Characters of remembered pre-tokens before the same.
REMEMBERED_CHARACTERS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: a number, a 32-bit float, or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


#: How ids are remembered.
_ID = np.dtype("<i4")
_LETTERS = {b: chr(FIRST_CHARACTER + b) for b in range(256)}


def _piece_text(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def _piece_texts(tokens: list[bytes]) -> list[str]:
    """The same for many at once."""
    letters = (np.frombuffer(b"".join(tokens), np.uint8).astype("<u2") + np.uint16(FIRST_CHARACTER)).tobytes().decode("utf-16-le")
    ends = list(accumulate(map(len, tokens), initial=0))
    return [letters[a:b] for a, b in pairwise(ends)]


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a vocabulary whose ranks are 0, 1, 2, ...

    The id of a piece is its rank; one unknown piece, which no text can reach, follows them.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("the vocabulary must hold all 256 bytes")
    pieces = b"".join(_field(1, _field(1, _piece_text(t).encode()) + _field(2, -float(r))) for r, t in enumerate(tokens))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
                     + _field(41, -1) + _field(42, -1) + _field(43, -1))  # BPE; no begin, end or padding
    # No added space, no removed space, no escaped space.
    plain = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return pieces + unknown + trainer + plain


class Codec:
    """Encode and decode whole texts with one vocabulary; a worker makes one and keeps it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self._split = regex.compile(pattern).findall
        self._ranks = ranks
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        letters = {_piece_text(bytes([b])): b for b in range(256)}
        self._bytes = [bytes(letters[c] for c in self._model.id_to_piece(i)) for i in range(len(ranks))]
        # Ids are these numbers, not one object for each time that an id occurs.
        self._numbers = list(range(len(ranks)))
        # Ids, as bytes, of pre-tokens met since the last time that there were too many, and in the stretch before it.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._characters = 0

    def _encode_new(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        merged = self._model.encode(_piece_texts(raw), num_threads=1)
        for i, rank in enumerate(map(self._ranks.get, raw)):
            if rank is not None:  # an entry of the vocabulary is one token, however it merges
                merged[i] = (rank,)
        ids = np.fromiter(chain.from_iterable(merged), _ID).tobytes()
        ends = accumulate((_ID.itemsize * len(m) for m in merged), initial=0)
        self._known.update(zip(words, (ids[a:b] for a, b in pairwise(ends)), strict=True))

    def _learn(self, words: set[str]) -> None:
        """Ids of all these words are known afterwards."""
        if len(self._known) > REMEMBERED or self._characters > REMEMBERED_CHARACTERS:
            self._known, self._older, self._characters = {}, self._known, 0
        words = words.difference(self._known)
        self._characters += sum(map(len, words))
        again = {w: self._older.pop(w) for w in words if w in self._older}
        self._known.update(again)
        new = list(words.difference(again))
        if new:
            self._encode_new(new)

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; what is new in any of them is encoded at once."""
        split = [self._split(t) for t in texts]
        self._learn(set(chain.from_iterable(split)))
        for words in split:
            yield np.frombuffer(b"".join(map(self._known.__getitem__, words)), _ID)

    def encode(self, text: str) -> list[int]:
        return list(map(self._numbers.__getitem__, next(self.encode_many([text])).tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The number of the first of several texts in a row that have up to ``CHARACTERS`` characters, and these; a larger text comes by itself."""
    at, held, size = 0, [], 0
    for number, text in enumerate(t.as_py() for t in texts):
        if held and (len(held) == ROWS or size + len(text) > CHARACTERS):
            yield at, held
            at, held, size = number, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


_WORKER: dict[str, Codec] = {}


def _worker_codec(vocabulary, key: str, pattern: str) -> Codec:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Codec(vocabulary.value, pattern)
    return _WORKER[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id",
                     text_column: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and by choice ``ids`` and ``decoded``.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded bytes.
    A null text is an empty text: no tokens, and the digests of nothing. ``ranks_path`` is a file of
    the driver; its entries (a vocabulary, of fixed size) travel to the executors as a broadcast.
    A worker splits some texts in a row, encodes what is new among their pre-tokens, and then holds the ids of
    one text at a time besides the batch.
    """
    ranks = read_ranks(ranks_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(vocabulary, key, pattern)
        decimal = [str(i) for i in range(len(codec._bytes))]
        for whole in batches:
            for at, texts in _pieces(whole.column(1)):
                batch = whole.slice(at, len(texts))
                n, ids_sha, decoded_sha, all_ids, decoded = [], [], [], [], []
                for array in codec.encode_many(texts):
                    ids = array.tolist()
                    data = codec.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(data).hexdigest())
                    if with_ids:
                        all_ids.append(array)
                    if with_text:
                        decoded.append(data.decode("utf-8", "replace"))
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    columns.append(pa.array(decoded, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")
    rows = docs.select(docs[id_column].alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
