"""SimHash near-duplicates with vantage-point trees.

Fingerprints are made per document, then only distinct ones go on. A tree grown on
a bounded sample deals them to shards by Hamming distance; fingerprints near a
boundary go to both sides. Each shard grows its own tree and compares what meets in
a leaf, which finds every pair within the radius. Links, not pairs, leave a shard,
and connected components name the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.llm import vptree
from texelyard.llm.common import TO_LOWER, map_text, partitions, quoted, utf8, with_row
from texelyard.llm.components import connected
from texelyard.session import ship_package, stage

SHINGLE, RADIUS, SEED = 3, 2, 42
CHUNK = 1 << 15
# A shard is aimed at so many fingerprints; the tree's sample has so many per shard, and no more in all.
SHARD_LEAST, SHARD_MOST = 512, 16_384
SAMPLE_PER_SHARD, SAMPLE_MOST = 64, 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text; without words it is 0."""
    found = utf8(text).translate(TO_LOWER).split()
    if not found:
        return 0
    size = min(shingle, len(found))
    last = len(found) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, last, CHUNK):
        stop = min(at + CHUNK, last)
        grams = map(b" ".join, zip(*[found[at + k : stop + k] for k in range(size)]))
        digests = b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(text).alias("text"))
    return map_text(rows, _fingerprints(shingle), with_row(rows, "fp long"))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["row", "fp"])

    return run


def close_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u, v`` that join all fingerprints within ``radius`` bits; ``points`` has distinct ``fp``.

    The tree is grown on the driver from at most ``SAMPLE_MOST`` fingerprints (the
    least by hash), every fingerprint is dealt by it. A shard's rows are
    bounded by the tree's leaf size as the sample sees it, not by a cap.
    """
    spark = points.sparkSession
    n = points.count()
    shard = max(SHARD_LEAST, min(SHARD_MOST, n // (2 * partitions(spark))))
    wanted = min(SAMPLE_MOST, SAMPLE_PER_SHARD * (n // shard + 1))
    chosen = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()
    sample = np.array([r.fp for r in chosen], np.int64).view(np.uint64)
    tree = vptree.build(sample, max(2, int(shard * len(sample) / max(n, 1))), radius)
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            rows, leaves = shared.value.shards(own.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(own[rows])], ["shard", "fp"])

    def join(group: pa.Table) -> pa.Table:
        own = np.sort(group.column("fp").to_numpy())
        u, v = vptree.links(own.view(np.uint64), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(join, "u long, v long")


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint of ``marked`` (``key, fp``).

    Fingerprints of a component share ``root``, one of them; ``component_id`` is their smallest key
    (null if all their keys are).
    """
    firsts = stage(marked.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    roots = connected(close_links(firsts, radius)).select(F.col("node").alias("fp"), "root")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key, fingerprint, component_id`` of every row of ``docs``.

    The component is named by its smallest key. Null and empty texts have
    fingerprint zero and are linked like any other; null keys never name a component
    that has another key. Repeated rows are returned as often as they are given.
    Documents are read once; what is shuffled is a key and a fingerprint per document, minima are
    combined before, and the one join with a hot side, documents to classes, is left to
    skew handling.
    """
    marked = stage(
        fingerprints(docs.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text")), "text").select(F.col("row.key").alias("key"), "fp"), "simhash"
    )
    named = marked.join(classes(marked, radius).select("fp", "component_id"), "fp")
    return named.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its columns: the smallest key, then fingerprint, then text by hash.

    Rows with null keys stay only as the one row of a component that has no other key.
    Whole rows are shuffled once, after equal keys and
    fingerprints have been reduced to one row in each task.
    """
    rows = fingerprints(docs, text)
    held = quoted("row").getField(key).cast("long")
    marked = stage(rows.select(held.alias("key"), "fp"), "simhash")
    named = marked.join(classes(marked, radius), "fp").filter(F.col("key").eqNullSafe(F.col("component_id")))
    keepers = named.groupBy("root").agg(F.min(F.struct(F.coalesce("key", F.lit(0)).alias("k"), F.isnull("key").alias("n"), "fp")).alias("m")).select("m.*")
    ranked = rows.withColumns({"k": F.coalesce(held, F.lit(0)), "n": F.isnull(held), "_h": F.xxhash64(F.col("row").getField(text))})
    once = ranked.groupBy("k", "n", "fp").agg(F.min_by("row", "_h").alias("row"))
    return once.join(keepers, ["k", "n", "fp"], "left_semi").select("row.*")
