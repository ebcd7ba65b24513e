"""A corpus pipeline of five stages, each on all that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. Each result is written as Parquet to the shared folder and read again,
so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from texelyard.llm import decontam, packing, rules, secrets, simhash
from texelyard.llm.common import table
from texelyard.session import stage

# No SQL: the first stage scores with trained trees, the last packs by retrieval.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the boosted trees keep."""
    return rules.kept_documents(docs, rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.without_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 ids, with the ids.

    Its workers served the stages before and hold their state, so they remember fewer pieces and encode less at a time.
    """
    return packing.pack_documents(docs, 2048, "byte_bpe_50k.json", end_id=1, remembered=300_000, slice_bytes=4 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
