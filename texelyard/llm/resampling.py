"""Importance resampling of documents towards a target table by hashed n-grams.

Every run of one to ``most`` words is a feature; its bucket is the CRC-32 of its bytes modulo a
fixed number. The distinct features of a slice of texts are grouped by length into matrices of
bytes, a column of the matrix advances the CRCs of all its rows at once, and the buckets are
scattered back to the places where the features stand. Buckets are written once, counted, and
read again for the documents' weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texelyard.llm.common import TO_LOWER, free_name, map_text, quoted
from texelyard.operators.ordinals import with_ordinals
from texelyard.session import stage

BUCKETS = 10_000
NGRAM = 2
LEAST_WORDS = 20
SLICE_BYTES = 4 << 20
CELLS = 1 << 20  # of a matrix of bytes at once
COLUMNS = 1 << 10  # bytes of a feature that matrices take; a longer one's tail goes on from there

_LOWER = np.frombuffer(TO_LOWER, np.uint8)
_WORD = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value.astype(np.uint32)


_CRC = _crc_table()


def crc_column(features: pa.Array) -> np.ndarray:
    """CRC-32 of each value of a binary column (no nulls), by matrices of equal length."""
    ends = np.frombuffer(features.buffers()[1], np.int32)[features.offset : features.offset + len(features) + 1].astype(np.int64)
    flat = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, first[1:])):
        width = min(length, COLUMNS)
        for part in np.array_split(rows, max(1, -(-len(rows) * width // CELLS))):
            matrix = flat[ends[part] + np.arange(width)[:, None]]
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
            out[part] = ~crc
            if length > width:
                for k in part.tolist():
                    out[k] = zlib.crc32(flat[ends[k] + width : ends[k + 1]], int(out[k]))
    return out


def text_buckets(texts: pa.Array, buckets: int = BUCKETS, most: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text (no nulls), and the buckets of all features, text by text.

    A-Z are lower-cased; words are runs of digits, a-z and bytes from 0x80. The features of a text are its
    runs of one word, then those of two, and so on.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at_text = ends[:-1][ends[:-1] < len(raw)]
    begins[at_text] = inside[at_text]
    starts = np.flatnonzero(begins)
    # Only bytes of words are kept, so a word's place among them is its start less the others before it.
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.concatenate([kept[starts], kept[-1:]]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    place = np.searchsorted(starts, ends)  # a text's first word
    n_words = np.diff(place)
    owner = np.repeat(np.arange(len(texts)), n_words)

    found, owners = [crc_column(names)[index] % np.uint32(buckets)], [owner]
    grams, ids, at = names, index, np.arange(len(starts))
    for length in range(2, most + 1):
        # A run of ``length`` words is a run of one word less and one word more of the same text.
        whole = at + length - 1 < len(starts)
        whole[whole] = owner[at[whole]] == owner[at[whole] + length - 1]
        at, ids = at[whole], ids[whole]
        runs = pa.array(ids * len(names) + index[at + length - 1], pa.int64()).dictionary_encode()
        head, last = np.divmod(runs.dictionary.to_numpy(), max(len(names), 1))
        grams = pc.binary_join_element_wise(grams.take(pa.array(head)), names.take(pa.array(last)), b" ")
        ids = runs.indices.to_numpy().astype(np.int64)
        found.append(crc_column(grams)[ids] % np.uint32(buckets))
        owners.append(owner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return n_words, np.bincount(owner, minlength=len(texts)), np.concatenate(found)[order]


def hashed_features(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, most: int = NGRAM) -> DataFrame:
    """``key, n_words, n_features, buckets`` of every row; ``buckets`` holds one little-endian uint32 per feature.

    A null text has no words. A task holds one Arrow batch and the features of a slice of it; one text is
    never cut, and takes about 60 bytes of memory per byte.
    """
    rows = docs.select(quoted(key).alias(key), F.coalesce(quoted(text), F.lit("")).alias("text"))
    names = [key, *(free_name(n, [key]) for n in ("n_words", "n_features", "buckets"))]
    schema = rows.select(
        quoted(key).alias(names[0]), F.lit(0).cast("long").alias(names[1]), F.lit(0).cast("long").alias(names[2]), F.lit(b"").alias(names[3])
    ).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _slices(batch.column(1)):
                n_words, n_features, found = text_buckets(part, buckets, most)
                bounds = np.concatenate([[0], 4 * np.cumsum(n_features)]).astype(np.int32)
                column = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(found.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(n_words), pa.array(n_features), column], names)

    return map_text(rows, run, schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def bucket_counts(features: DataFrame, column: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over a whole table: one array per task, added up by bucket; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in features.select(quoted(column)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def _flat(cells: pa.Array) -> np.ndarray:
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4") if len(ends) else np.zeros(0, np.uint32)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed shares of each bucket, rounded down."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    ratio = (((float(b) + 1) * (float(s) + n)) / ((float(a) + 1) * (float(t) + n)) for a, b in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise drawn by sha256 of ``seed:key``, rounded down; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text",
    least_words: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = NGRAM,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` counts the drawn from 1, null if not drawn.

    ``weight`` is the mean gain of a document's features, rounded down (none: 0). ``score`` adds Gumbel
    noise, so the highest scores are a draw without replacement by weight. Of the documents with at
    least ``least_words`` words ``percent`` in a hundred are drawn, rounded down, equal scores by smaller key, null keys
    first. Rows are taken one by one, whether their key or text is repeated or null. An empty target or
    source is no error: smoothing stands in for its counts.

    Texts are read once. Their buckets are written, read to be counted (``buckets`` numbers a task)
    and read again for the weights; only drawn rows and their equals in score are sorted, by ranges.
    """
    features = stage(hashed_features(docs, key, text, buckets, most), "hashed-features")
    name, words, count, cells = features.columns
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("key"), quoted(target_text).alias("text")), "key", "text", buckets, most)
    gains = bucket_gains(bucket_counts(features, cells, buckets), bucket_counts(wanted, "buckets", buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy()
            ends = np.concatenate([[0], np.cumsum(gains[_flat(batch.column(3))])])
            bounds = np.concatenate([[0], np.cumsum(size)])
            weight = (ends[bounds[1:]] - ends[bounds[:-1]]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    plain = features.select(quoted(name).alias("key"), quoted(words).alias("n_words"), quoted(count).alias("n_features"), quoted(cells).alias("cells"))
    schema = plain.withColumn("weight", F.lit(0).cast("long").alias("weight")).drop("cells").schema
    for field in schema:
        field.nullable = True
    weighed = plain.mapInArrow(weigh, schema)
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "scored")

    able = F.col("n_words") >= least_words
    # Scores are sums of two logarithms of doubles in thousandths: some 100,000 values at most.
    of_score = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    running = of_score.select(
        "score", "n", F.sum("n").over(W.orderBy(F.desc("score"))).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all")
    )
    drawn = F.expr(f"{int(percent)} * all div 100")
    found = running.filter(F.col("upto") - F.col("n") < drawn).agg(F.min("score").alias("least"), F.max(drawn).alias("drawn")).first()
    least, drawn_rows = (found.least, found.drawn) if found.least is not None else (0, 0)
    high = able & (F.col("score") >= least) if drawn_rows else F.lit(False)
    # Numbers of rows of a written table: they stay when a task is repeated, and part rows with one key.
    numbered = scored.withColumn("tie", F.monotonically_increasing_id())
    ranked = with_ordinals(numbered.filter(high), [F.desc("score"), F.asc("key"), F.asc("tie")], "rank")
    place = F.when(F.col("rank") < drawn_rows, F.col("rank") + 1)
    out = ["key", "n_features", "weight", "score"]
    rest = scored.filter(~F.coalesce(high, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, place.alias("rank")).unionAll(rest).withColumnRenamed("key", key)
