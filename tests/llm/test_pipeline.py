"""The pipeline's stages against brute-force versions on a small corpus."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm.byte_bpe import read_ranks
from pointloom.llm.mixing import mix_report
from pointloom.session import WORKER_ROWS

WORDS = [a + b for a in "ka lo mi nu re sa to".split() for b in "ben dor fin gal hus".split()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    base, notice, docs, labels = [line(12) for _ in range(8)], line(9), [], []
    for i in range(400):
        lines = [line(rng.randint(6, 14)) for _ in range(rng.randint(3, 7))]
        toxic = i % 4 == 1
        if toxic:
            lines[0] += " vilest vilor"
        if i % 3 == 0:
            lines.append(notice)
        if i % 40 == 2:  # near copies that differ in one word of a line
            lines = [f"{x} a{i}" if k == 0 else x.replace(x.split()[5], f"alt{i}x") for k, x in enumerate(base)]
        docs.append((i, "\n".join(lines), "en", f"s{i % 3 if i % 2 else 0}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, docs[6][1], "en", "s1", 1), (1001, None, "en", "s1", 1), (1002, "", None, None, 1), (None, line(30), "en", "s2", 1), (8, docs[8][1], "en", "s0", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


def test_stages(spark, folder):
    path, rows = folder
    docs, inputs = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = spark.createDataFrame(out := (df := stage(spark, docs, path)).collect(), df.schema)
        if name != "byte_bpe":
            assert df.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert sorted(map(str, out)) == sorted(str(r) for r in inputs[name] if r.doc_id is None or r.doc_id >= 400 or r.doc_id % 4 != 1)
        if name == "line_dedup":
            # A copy, and near copies line by line, have nothing of their own.
            assert {r.doc_id for r in inputs[name]} - {r.doc_id for r in out} == {1000, *range(42, 400, 40)}
            assert sum(r.text.count("\n") for r in out) < sum((r.text or "").count("\n") for r in inputs[name])
        if name == "near_dedup":
            assert {r.doc_id for r in out} <= {r.doc_id for r in inputs[name]} and len(out) == len({(r.doc_id, r.text) for r in out})
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert sorted((str(r.doc_id), list(r.ids)) for r in out) == sorted((str(r.doc_id), theirs.encode_ordinary(r.text)) for r in inputs["byte_bpe"])
    taken = mix_report(spark.createDataFrame(inputs["mixing"], "doc_id long, text string, lang string, source string, n_chars long")).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in inputs["byte_bpe"]) == taken


def test_run_is_the_stages_one_after_another(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    digest = lambda df: sorted(hashlib.sha256(str((r.doc_id, r.ids_sha256)).encode()).hexdigest() for r in df.collect())
    assert digest(corpus_pipeline.run(spark, path)) == digest(docs)


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_send_few_texts_at_a_time_to_workers(spark, folder):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        corpus_pipeline.byte_bpe(spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0])

        def sizes(batches):
            yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)

        got = [r["n"] for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 3000 and max(got) <= WORKER_ROWS
        spark.conf.set(name, "100")
        corpus_pipeline.byte_bpe(spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0])
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
