"""The corpus pipeline: quality rules, near-duplicate removal, passage dedup and packing, one stage after the other.

Every stage takes null texts (as empty ones), null ids, repeated rows, empty tables and extra columns of any name; all but the last
return the columns they were given, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import near_dedup, packing, passage_dedup, quality_rules
from segmenta.llm.queries import WORD_BPE
from segmenta.llm.store import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned list rejects go, so those of fewer than ten words do; others stay as they are, repeated
    rows and null ids included. Without labels the base decides alone."""
    return quality_rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the smallest id; of repeated rows one does."""
    return near_dedup.deduplicated(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has are cut out, and n_chars is counted again; no document goes, even if nothing of it is
    left. Rows with null ids, and other texts of an id, are left alone."""
    return passage_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, empty ones too, as pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality rules", quality), ("near-duplicates", near_duplicates), ("substring dedup", passages), ("packing", packed)]
#: Learned rules, weighted samples and tokens have no SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
