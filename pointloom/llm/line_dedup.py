"""Lines that recur across documents, by a tree of line templates of fixed depth.

A line walks down the tree by its number of tokens and then by its leading tokens; tokens with a digit
are variable fields and count as alike. At the leaf its template is what remains: the masked line
itself, and, for longer lines, the masked line with one of five equal runs of the tokens after the
leading ones left open, so that a field may vary there too. Two lines of one template thus differ in
tokens with digits and in at most a fifth of the others. A template found in two documents or more
recurs. Its lines stay in the first of these documents (the smallest id) and are dropped from the rest.
Lines of one or two tokens have no tree to walk; the queries key them word for word.

Templates are keys, so a leaf is never gathered in one place: each key is summed up as its first and
last document before anything is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pointloom.llm.common import text_of
from pointloom.session import checkpoint, scratch_folder

#: Leading tokens that the tree branches on, runs one of which may vary, and the fewest tokens of a line for that.
DEPTH = 3
RUNS = 5
LEAST_FOR_RUNS = 8
#: Shorter lines are no templates; where they are asked for, they recur word for word.
LEAST_TOKENS = 3

#: Texts that a worker handles at a time.
ROWS = 256

_number = re.compile(r"\d").search


def template_keys(line: str, short: bool = False) -> list[int]:
    """64-bit keys of the templates of a line; for a line of one or two tokens, of the line as it is, if ``short``, or none."""
    tokens = line.split()
    n = len(tokens)
    if n < LEAST_TOKENS and not (short and n):
        return []
    if n >= LEAST_TOKENS and _number(line):
        tokens = ["<*>" if _number(t) else t for t in tokens]
    lead = f"{n} " + " ".join(tokens[:DEPTH]) + "\n"
    key = lambda run, text: xxhash.xxh3_64_intdigest(f"{lead}{run} {text}".encode("utf-8", "surrogatepass")) - (1 << 63)
    keys = [key("-", " ".join(tokens[DEPTH:]))]
    if n >= LEAST_FOR_RUNS:
        rest = n - DEPTH
        cuts = [DEPTH + rest * i // RUNS for i in range(RUNS + 1)]
        pieces = [" ".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        keys += [key(i, "\t".join(pieces[:i] + pieces[i + 1:])) for i in range(RUNS)]
    return keys


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))


def _lines(short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            of, numbers, keys = [], [], []
            for i, text in enumerate(batch.column("text")):
                for number, line in enumerate(text.as_py().split("\n")):
                    if found := template_keys(line, short):
                        of.append(i)
                        numbers.append(number)
                        keys.append(found)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("h").take(at), pa.array(numbers, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["id", "h", "line", "keys"])
    return run


def dropped_lines(rows: DataFrame, short: bool = False) -> DataFrame:
    """id, h and the numbers (from 0) of the lines to drop, for rows of id, h (of the text) and text."""
    id_type = rows.schema["id"].dataType.simpleString()
    # Keys do not compress as rows of a checkpoint; as a table they take a third of it.
    folder = scratch_folder(rows.sparkSession)
    rows.select("id", "h", "text").mapInArrow(_lines(short), f"id {id_type}, h long, line int, keys array<long>").write.parquet(folder)
    lines = rows.sparkSession.read.parquet(folder)
    keyed = lines.select("id", "h", "line", F.explode("keys").alias("key"))
    same = F.xxhash64("id", "h")
    # Plain numbers keep the rows that are shuffled short; most keys have one document, and then lo and hi agree.
    recurring = checkpoint(keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.min(same).alias("lo"), F.max(same).alias("hi"))
                           .where("lo != hi").select(F.col("key").alias("r_key"), "first_id"))
    again = keyed.join(recurring, F.col("key") == F.col("r_key")).where(~F.col("id").eqNullSafe(F.col("first_id")))
    # A line is met at most once for each of its keys; a document has no more entries than lines.
    return again.groupBy("id", "h").agg(F.collect_set("line").alias("dropped")).select(
        F.col("id").alias("d_id"), F.col("h").alias("d_h"), "dropped")


def _cut(others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lines, drops, texts, left = [], [], [], []
            for text, dropped in zip(batch.column("text"), batch.column("dropped"), strict=True):
                before, gone = text.as_py().split("\n"), set(dropped.as_py() or ())
                after = [line for i, line in enumerate(before) if i not in gone] if gone else before
                lines.append(len(before))
                drops.append(len(gone))
                texts.append("\n".join(after))
                left.append(not gone or any(line.strip() for line in after))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in others), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(drops, pa.int64()), pa.array(left, pa.bool_())],
                names=[*others, "text", "n_lines", "n_dropped", "has_text"])
    return run


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), short: bool = False) -> DataFrame:
    """Every row with what is left of its text: id, kept columns, text, n_lines, n_dropped, has_text.

    Lines end at ``\\n`` only. A null text is an empty one, which has one empty line. Lines of fewer
    than three tokens are dropped only if ``short``, and then where the same tokens recur. Rows alike in id and text are one document, so they do not
    make their lines recur. Null ids come after all others; rows that share the first id, or have no
    id where nobody has one, all keep the line. ``has_text`` is false where dropping left
    nothing but white space. Kept columns must not be named like the others.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), *keep).withColumn("h", F.xxhash64("text"))
    drops = dropped_lines(rows, short)
    both = rows.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")), "left").select("id", *keep, "text", "dropped")
    kept = both.select("id", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return both.mapInArrow(_cut(kept.columns), f"{schema}, text string, n_lines long, n_dropped long, has_text boolean").withColumnRenamed("id", id_column)


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", short: bool = False) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, n_chars_left and text_sha256 of the text that is left."""
    cut = drop_recurring_lines(docs, id_column, text_column, short=short)
    return cut.select(id_column, "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))
