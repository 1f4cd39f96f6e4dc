"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.llm import alignment, chat, compression, linededup, minhash, mixing, mtree, packing, quality, resampling, simhash, toxicity
from framegate.llm.common import shared_folder, table
from framegate.llm.shards import ShardTable

TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ARRIVALS = 4
SHARD_BYTES = 64 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_likeness(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four parts by id; then the shards are compacted. Every document as
    the last version's shards hold it, with its arrival and the rows that the manifest counts."""
    docs = table(spark, sf_dir, "documents")
    shards = ShardTable(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", target_bytes=SHARD_BYTES)
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)).cast("int")
    shards.append_each(docs.withColumn("arrival", arrival), "arrival")
    shards.compact()
    held = shards.read()
    if held is None:
        return spark.createDataFrame([], "doc_id long, arrival int, text_sha256 string, n_rows long")
    n_rows = shards.manifest().agg(F.sum("n_rows")).first()[0]
    text = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return held.select("doc_id", "arrival", text, F.lit(n_rows).cast("long").alias("n_rows"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rendered(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("h")


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = compression.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "in_bands")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digests(table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash, op2_quality, op3_top_k, op4_packing, op5_simhash, op6_line_dedup, op7_sharding, op8_toxicity, op9_chat, op10_mixing, op11_compression,
        op12_alignment, op13_resampling,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Rows of documents after line dedup: doc_id, n_lines, n_dropped, kept_text. {docs}: the input.
LINE_DEDUP_SQL = f"""
  lines AS (
    SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), {_LOWER}) AS key
    FROM (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {{docs}})) ),
  firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key),
  marked AS (
    SELECT doc_id, pos, line, coalesce(doc_id <> first, false) AS gone
    FROM lines LEFT JOIN firsts ON lines.key = firsts.key AND length(lines.key) >= 10),
  deduped AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
    FROM marked GROUP BY doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_top_k": """
        WITH fine AS (
          SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, q.v, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
          FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
    "op6_line_dedup": f"""
        WITH {LINE_DEDUP_SQL.format(docs="documents")}
        SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM deduped
    """,
    "op7_sharding": f"""
        SELECT doc_id, CAST(coalesce(doc_id, 0) % {ARRIVALS} AS INTEGER) AS arrival, sha256(coalesce(text, '')) AS text_sha256,
               CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_rows
        FROM documents
    """,
    "op9_chat": """
        WITH said AS (
          SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS turns
          FROM conversations GROUP BY conv_id),
        whole AS (SELECT min(conv_id) AS conv_id, turns FROM said GROUP BY turns),
        begun AS (SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM said)),
        kept AS (SELECT conv_id, turns FROM whole WHERE NOT EXISTS (SELECT 1 FROM begun WHERE begun.turns = whole.turns)),
        told AS (
          SELECT conv_id, len(turns) AS n_turns,
                 list_aggregate(list_transform(turns, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), 'string_agg', '') AS rendered
          FROM kept)
        SELECT conv_id, n_turns, CAST(length(rendered) AS BIGINT) AS n_chars, sha256(rendered) AS rendered_sha256 FROM told
    """,
}
