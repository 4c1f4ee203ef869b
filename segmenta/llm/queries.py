"""The queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import byte_bpe, fingerprints, grammar_shards, license_scan, near_dedup, packing, passage_dedup, quality_rules, shards, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_shards.read_shards(*grammar_shards.write_shards(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_icws_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op3_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("long").alias("rule"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, version = shards.compacted(table(spark, sf_dir, "documents"))
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


def op8_passage_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeats(table(spark, sf_dir, "documents"))


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op10_backtracking_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith("op") and callable(f)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The other queries learn, sample by weight or read vocabularies: tests/llm holds them against slow versions and the libraries.
ORACLES: dict[str, str] = {
    "op4_warc_salvage": f"""
        WITH page AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        first AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM page)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string([substr('{_DIGITS}', CAST((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - k % 4) AS BIGINT)) % 32 AS BIGINT) + 1, 1) for k in range(32)], '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM first""",
    "op5_tiered_compaction": """
        SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS text_bytes, md5(text) AS text_md5 FROM documents""",
}
