"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from farewatch.llm import (chat, decontaminate, fastsketch, jaccard, merkle, mixing, packing, sharding, spelling, substring,
                           topk, toxicity, warc)
from farewatch.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_mix_sources", mixing.oracle_sql())
def op1_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@register("op2_token_pack")
def op2_token_pack(spark, sf_dir):
    return packing.packed_digests(packing.pack_tokens(table(spark, sf_dir, "documents")))


@register("op3_warc_normalise", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE octet_length(payload) >= {warc.REVISIT_MIN_BYTES} GROUP BY 1)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""")
def op3_warc_normalise(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


@register("op4_chat_format", chat.ORACLE_SQL)
def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = chat.probe_turns(spark)
    return chat.conversation_digests(chat.format_trees(chat.conversations_as_trees(rows.unionByName(probe))))


@register("op5_block_topk", topk.ORACLE_SQL)
def op5_block_topk(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


@register("op6_substring_dedup", substring.oracle_sql())
def op6_substring_dedup(spark, sf_dir):
    kept = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@register("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_jaccard_join", jaccard.oracle_sql())
def op8_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


@register("op9_histogram_shards")
def op9_histogram_shards(spark, sf_dir):
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op11_spelling_variants", spelling.oracle_sql())
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register("op12_fast_minhash", fastsketch.oracle_sql())
def op12_fast_minhash(spark, sf_dir):
    return fastsketch.near_duplicates(table(spark, sf_dir, "documents"))


@register("op13_merkle_manifest", merkle.oracle_sql())
def op13_merkle_manifest(spark, sf_dir):
    return merkle.verify_tampered(table(spark, sf_dir, "documents"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
