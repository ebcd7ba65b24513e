"""Token counts behind a digest cache.

The cache is a Parquet table of ``content, n_tokens`` in folders by ``tokenizer`` and ``run``: the digest of the
tokenizer's version (its file and its library's version) and the digest of the
normalised content (the UTF-8 bytes of the text, null as the empty text; nothing
that could change a count). A run joins its documents' digests to the cache,
encodes one text per digest that is missing, and appends those counts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.llm.common import map_text, quoted
from texelyard.llm.tokens import library_path, public_encoder

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string, run string"


def tokenizer_version(name: str) -> str:
    """Digest of a vocabulary file and of the version of the library that reads it."""
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    with open(library_path(name), "rb") as source:
        found = hashlib.sha256(source.read())
    found.update(f"{library} {version(library)}".encode())
    return found.hexdigest()


def read_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Counts stored for one tokenizer version, one row per content even if two runs stored it.

    A folder that does not exist yet is an empty cache.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], "content binary, n_tokens long")
    return _once(_stored(spark, folder, tokenizer))


def _stored(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).parquet(folder).filter(F.col("tokenizer") == tokenizer)


def _once(stored: DataFrame) -> DataFrame:
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row of ``docs``; ``cache`` gains what was missing.

    A null text counts as empty; ``key`` may be null or repeated; other columns are
    not read. Texts are shuffled once, each task giving one copy per digest, so a
    text that a third of the rows share does not gather in one task; the join to
    the cache finds both sides dealt by digest.
    The counts are appended before they are joined: a run that is stopped leaves a
    cache that the next run uses.
    """
    spark = docs.sparkSession
    release = tokenizer_version(tokenizer)
    content = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(
        quoted(key).alias(key), content.alias("_text"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("content")
    )
    missing = rows.groupBy("content").agg(F.first("_text").alias("_text"))
    begun = _exists(spark, cache)
    if begun:
        missing = missing.join(read_cache(spark, cache, release), "content", "left_anti")
    run = uuid.uuid4().hex
    map_text(missing, _count(tokenizer), "content binary, n_tokens long").write.parquet(f"{cache}/tokenizer={release}/run={run}")
    # What this run stored is there once, so it needs no second reduction, and the exchange of the join can be split.
    stored = _stored(spark, cache, release)
    counts = stored.filter(F.col("run") == run).select("content", "n_tokens")
    if begun:
        # A run at the same time may store a content that this one counts too.
        others = _once(stored.filter(F.col("run") != run))
        counts = counts.unionAll(others.join(counts.select("content"), "content", "left_anti"))
    joined = rows.select(key, "n_bytes", "content").join(counts, "content")
    return joined.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=library_path(name))
        for batch in batches:
            if name.endswith(".model"):
                counts = np.array([len(pieces.encode(t.as_py(), num_threads=1)) for t in batch.column(1)], np.int64)
            else:
                slices = public_encoder(name).column(batch.column(1))
                counts = np.concatenate([np.zeros(0, np.int64), *[np.diff(bounds) for _, _, bounds in slices]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run
