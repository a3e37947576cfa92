"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.llm.byte_bpe import encode_documents
from pointloom.llm.common import sql_lower_az, table
from pointloom.llm.exact_dedup import content_sort
from pointloom.llm.kd_search import top_k
from pointloom.llm.license_scan import scan_licenses
from pointloom.llm.line_dedup import line_report
from pointloom.llm.mixing import mix_report
from pointloom.llm.near_dedup import near_duplicates
from pointloom.llm.packing import pack_documents
from pointloom.llm.passage_dedup import repeated_passages
from pointloom.llm.periodic_runs import periodic_runs, planted
from pointloom.llm.quality import quality_report
from pointloom.llm.toxicity import toxicity_report
from pointloom.llm.vector_codes import ENTRIES, PARTS, ROUNDS, compress_vectors


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN, with_ids=False)


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), short=True)


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), whole=True)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(planted(table(spark, sf_dir, "documents")), with_runs=False)


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _vector_codes_sql() -> str:
    """All distances of a round in one join; the rounds one after another."""
    ctes = [
        """v AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""w AS MATERIALIZED (SELECT vec_id, label, p AS part, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS x
            FROM v, range({PARTS}) r(p))""",
        "d AS MATERIALIZED (SELECT part, x, count(*) AS n FROM w GROUP BY part, x)",
        f"""b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM w JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry
            FROM v ORDER BY vec_id LIMIT {ENTRIES}) f USING (vec_id))""",
    ]

    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT part, x, any_value(n) AS n, min(struct_pack(away := away, entry := entry)) AS near FROM (
            SELECT d.part, d.x, d.n, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS away
            FROM d JOIN b{k} USING (part)) GROUP BY part, x)"""

    for k in range(ROUNDS):
        ctes.append(nearest(k))
        ctes.append(f"""m{k} AS (SELECT part, entry, list(mean ORDER BY i) AS c FROM (
            SELECT part, near.entry AS entry, i, floor(sum(n * x[i]) / sum(n)) AS mean FROM a{k}, range(1, 4097) r(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY part, entry)""")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))")
    ctes.append(nearest(ROUNDS))
    ctes.append(f"""g AS (SELECT sha256(string_agg(list_aggregate([y::BIGINT for y in c], 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256
            FROM b{ROUNDS})""")
    ctes.append(f"""r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, sum(near.away)::BIGINT AS error
            FROM w JOIN a{ROUNDS} a USING (part, x) GROUP BY vec_id)""")
    return "WITH " + ",\n".join(ctes) + """
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, g"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing,
    "op2_byte_bpe": byte_bpe,
    "op3_passage_dedup": passage_dedup,
    "op4_line_dedup": line_dedup,
    "op5_exact_dedup": exact_dedup,
    "op6_quality": quality,
    "op7_near_dedup": near_dedup,
    "op8_license_scan": license_scan,
    "op9_kd_search": kd_search,
    "op10_toxicity": toxicity,
    "op11_packing": packing,
    "op12_periodic_runs": runs,
    "op13_vector_codes": vector_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {sql_lower_az("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op9_kd_search": """
        WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_vector_codes": _vector_codes_sql(),
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
