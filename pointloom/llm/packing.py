"""Sequences of fixed length packed by first-fit decreasing in randomised groups of documents.

Documents are tokenised once, dealt to tasks in random order, and packed in groups of bounded size. In
a group a document fills whole sequences first; the rests are placed longest first, each into the first
sequence with room for it. A tournament tree of the sequences' room finds that one in logarithmic time.
What is left open is closed by cutting: the emptiest sequences give tokens to the fullest ones until one
open sequence is left, which falls into sequences of powers of two, as those take no padding.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import text_of

SIZE = 2048
#: Documents and tokens from which on a group is packed.
GROUP_DOCS = 4096
GROUP_TOKENS = 4_000_000
#: Pre-tokens (and their characters) that a worker remembers before it starts afresh; rows handled at a time.
REMEMBERED = 800_000
REMEMBERED_CHARACTERS = 16_000_000
ROWS = 256
SEED = 17

#: The steps of a vocabulary file that are also known here for texts of Latin letters.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: First code point that those steps are not known for; below it nothing composes and lower case stays below it, but for one dot.
LIMIT = 0x180


def _latin_split() -> Callable[[str], list[str]]:
    """``SPLIT`` for lower-cased text of characters below ``LIMIT``, in the expressions of ``re``, with what is frequent first."""
    import re

    of = lambda kinds: "".join(f"\\u{c:04x}" for c in range(LIMIT) if unicodedata.category(chr(c))[0] in kinds)
    letters, numbers, spaces = of("L"), of("N"), of("Z") + "\\t-\\r\\x85"
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{spaces}{letters}{numbers}]+").findall


class _Pieces(dict):
    """Pre-tokens and the bytes of their ids."""

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # Lower case of characters below the limit stays below it, but for the dot above.
        self._letters = {c: of(chr(c))[0][0] for c in [*range(LIMIT), 0x307]}
        self._merge = tokenizer.model.tokenize
        self.characters = 0

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self._merge(piece.translate(self._letters))]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
            self.characters += len(piece)
        return ids


class Encoder:
    """Ids of whole texts by a vocabulary file of the tokenizers library, as little-endian 32-bit numbers.

    The pre-tokens of a text are independent of each other, so their ids are remembered. Texts with
    other characters than Latin ones, with an added token of the vocabulary, or of a file with other
    steps than the known ones go through the library as a whole.
    """

    def __init__(self, vocabulary: str):
        import re

        from tokenizers import Tokenizer

        steps = json.loads(vocabulary)
        self._whole = Tokenizer.from_str(vocabulary)
        pre = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        known = (steps.get("normalizer") == NORMALIZER and steps["model"]["type"] == "BPE" and len(pre) == 2
                 and {k: v for k, v in pre[0].items()} == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
                 and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False))
        self._known = known
        self._added = [t["content"] for t in steps.get("added_tokens", [])]
        self._far = re.compile(f"[^\\x00-\\u{LIMIT - 1:04x}]").search
        self._split = _latin_split()
        self._pieces = _Pieces(self._whole)

    def _pieced(self, text: str) -> bool:
        return self._known and not any(t in text for t in self._added) and (text.isascii() or not self._far(text))

    def __call__(self, text: str) -> bytes:
        if not self._pieced(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self._pieces) > REMEMBERED or self._pieces.characters > REMEMBERED_CHARACTERS:
            self._pieces.clear()
            self._pieces.characters = 0
        return b"".join(map(self._pieces.__getitem__, self._split(text.lower())))


_WORKER: dict[str, Encoder] = {}


def _worker_encoder(vocabulary: str, key: str) -> Encoder:
    """One encoder for all tasks of a worker, with what it remembers."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(vocabulary)
    return _WORKER[key]


class Tournament:
    """Room of a row of bins; a match of two neighbours is won by the larger room."""

    def __init__(self, bins: int, room: int):
        self._leaves = 1 << max(0, bins - 1).bit_length()
        self._room = [room] * (2 * self._leaves)

    def first(self, need: int) -> int:
        """The first bin with room for ``need``, which it takes up; there must be one."""
        room, at = self._room, 1
        while at < self._leaves:
            at *= 2
            if room[at] < need:
                at += 1
        found = at - self._leaves
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


Piece = tuple[int, int, int]  # document, first token, tokens


def _give(bin_: list[Piece], tokens: int) -> list[Piece]:
    """Take so many tokens off the end of a bin, cutting one piece at most."""
    given = []
    while tokens:
        doc, start, length = bin_.pop()
        part = min(length, tokens)
        if part < length:
            bin_.append((doc, start, length - part))
        given.append((doc, start + length - part, part))
        tokens -= part
    return given


def pack(lengths: list[int], size: int = SIZE) -> list[list[Piece]]:
    """The sequences of a group of documents, each a list of pieces; all are full or a power of two long."""
    full = [[(doc, start, size)] for doc, n in enumerate(lengths) for start in range(0, n - size + 1, size)]
    rests = sorted(((n % size, doc) for doc, n in enumerate(lengths) if n % size), key=lambda r: (-r[0], r[1]))
    tree, bins = Tournament(len(rests), size), []
    for rest, doc in rests:
        at = tree.first(rest)
        if at == len(bins):
            bins.append([])
        bins[at].append((doc, lengths[doc] - rest, rest))
    filled = [sum(p[2] for p in b) for b in bins]
    full += [b for b, n in zip(bins, filled, strict=True) if n == size]
    # The fullest open sequence is closed first, with tokens of the emptiest.
    open_ = [bins[i] for i in sorted((i for i, n in enumerate(filled) if n < size), key=lambda i: (-filled[i], i))]
    held = [sum(p[2] for p in b) for b in open_]
    at, giver = 0, len(open_) - 1
    while at < giver:
        part = min(size - held[at], held[giver])
        open_[at] += _give(open_[giver], part)
        held[at] += part
        held[giver] -= part
        at += held[at] == size
        giver -= held[giver] == 0
    # Nobody is left to give: what the last sequence holds is cut at powers of two.
    full += open_[:at]
    if at <= giver:
        last, rest = open_[at], held[at]
        while rest:
            power = 1 << rest.bit_length() - 1
            full.append(_give(last, power))
            rest -= power
    return full


def _packed(size: int, transit: str, with_ids: bool, group_docs: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        ids, texts, tokens = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal sequence
            whole = [np.frombuffer(t, transit).astype("<u4") for t in texts]
            rows, parts = [], []
            for pieces in pack([len(t) for t in whole], size):
                offset = 0
                for doc, start, length in pieces:
                    part = whole[doc][start:start + length]
                    rows.append((doc, start, length, zlib.crc32(part), len(whole[doc]), sequence, offset))
                    offset += length
                    if with_ids:
                        parts.append(part.astype(np.int32))
                sequence += 1
            doc, *numbers = np.array(rows, np.int64).reshape(-1, 7).T
            columns = [pa.concat_arrays(ids).take(pa.array(doc)), *map(pa.array, numbers)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(numbers[1])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts]))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, max(1, group_docs - len(texts)))
                n = 0
                for text in batch.column("ids"):
                    texts.append(text.as_py())
                    tokens += len(texts[-1]) // np.dtype(transit).itemsize
                    n += 1
                    if tokens >= group_tokens:
                        break
                ids.append(batch.column("id").slice(0, n))
                at += n
                if tokens >= group_tokens or len(texts) >= group_docs:
                    yield close()
                    ids, texts, tokens = [], [], 0
        if texts:
            yield close()
    return run


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """Rows of (id, ids) with the bytes of each document's ids and the end id, and the type of one of these numbers."""
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()
    steps = json.loads(vocabulary)
    most = max([end_id, *steps["model"]["vocab"].values(), *(t["id"] for t in steps.get("added_tokens", []))])
    transit = "<u2" if most < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary, of fixed size
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _worker_encoder(shared.value, key)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [np.frombuffer(encode(text.as_py()) + end, "<u4").astype(transit).tobytes() for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, ids binary"), transit


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text",
                   with_ids: bool = True, group_docs: int = GROUP_DOCS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and by choice ``ids``.

    A document is the ids of its whole text and the end id; a null text is an empty one and gives the end
    id alone. ``start`` counts its document's ids before the piece, ``offset`` those of the sequence;
    every id lies in one piece. A sequence holds ``size`` ids or a power of two of them, so none is padded.
    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers. Repeated rows and null ids are
    packed row by row. Other columns are ignored.

    Rows are dealt evenly over the shuffle partitions, whatever they hold, and ordered by a salted hash
    there; a task holds one group at a time, of ``group_docs`` documents or, with long ones, the document
    that reaches ``group_tokens``.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the length of sequences must be a power of two")
    rows, transit = tokenized(docs, tokenizer_path, end_id, id_column, text_column)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts).sortWithinPartitions(F.xxhash64(F.lit(SEED), "id", "ids"))
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = dealt.mapInArrow(_packed(size, transit, with_ids, group_docs, group_tokens), schema + (", ids array<int>" if with_ids else ""))
    return packed.withColumnRenamed("id", id_column)
