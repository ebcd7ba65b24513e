"""Token-id files of patched frame-of-reference blocks.

A segment is one self-contained byte string of whole documents:

    magic "PFR1", n_docs, n_ids, n_blocks, n_exceptions (five little-endian uint32; the magic first)
    n_docs x int64 document ids, n_docs x uint8 "document id is null", n_docs x uint32 id counts
    n_blocks x uint32 block minimum, n_blocks x uint8 packed width
    (n_blocks + 1) x uint32 start of each block's packed bytes
    (n_blocks + 1) x uint32 start of each block's exceptions
    n_exceptions x uint8 position in the block, n_exceptions x uint32 distance to the minimum
    packed bytes

Each block holds 128 ids. Its minimum is subtracted, the distances are packed at
the width that the chosen percentile of them needs, and the wider ones go to the
exception list. Any block is found and decoded by the starts alone.

A table of such files is Parquet with one row per segment, so it lies in any store
Spark can write: ``shard, segment, first (ids of the shard before it), n_docs,
n_ids, payload``. Shards are cut by range of the document id, so their order, then
the segment's, is ascending document id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texelyard.llm.common import map_text, partitions, quoted
from texelyard.llm.tokens import public_encoder

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
MAGIC = int.from_bytes(b"PFR1", "little")
SEGMENT_SCHEMA = "shard int, segment int, first long, n_docs long, n_ids long, payload binary"


# -- blocks --------------------------------------------------------------------


def encode_segment(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """Bytes of one segment; ``ids`` are all ids in order, ``counts`` how many each document has."""
    n_blocks = -(-len(ids) // BLOCK)
    rows = np.zeros((n_blocks, BLOCK), np.uint32)
    rows.reshape(-1)[: len(ids)] = ids
    if len(ids) % BLOCK:
        rows[-1, len(ids) % BLOCK :] = rows[-1, : len(ids) % BLOCK].min()
    low = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    gap = rows - low[:, None]
    need = _bit_length(gap)
    width = np.sort(need, axis=1)[:, -(-BLOCK * percentile // 100) - 1] if n_blocks else np.zeros(0, np.uint8)
    out = need > width[:, None]
    block_of, position = np.nonzero(out)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * BLOCK // 8)])
    packed = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            bits = np.unpackbits(gap[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, count=w, bitorder="little")
            body = np.packbits(bits.reshape(len(own), -1), axis=1)
            packed[starts[own][:, None] + np.arange(body.shape[1])] = body
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = [
        np.array([MAGIC, len(doc_ids), len(ids), n_blocks, len(position)], "<u4"),
        np.array([0 if d is None else d for d in doc_ids], "<i8"),
        null,
        counts.astype("<u4"),
        low.astype("<u4"),
        width.astype(np.uint8),
        starts.astype("<u4"),
        np.concatenate([[0], np.cumsum(out.sum(axis=1))]).astype("<u4"),
        position.astype(np.uint8),
        gap[out].astype("<u4"),
        packed,
    ]
    return b"".join(p.tobytes() for p in parts)


def _bit_length(values: np.ndarray) -> np.ndarray:
    """Bits each value needs; exact, as a double holds 32 bits."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


class Segment:
    """A segment opened for reading; blocks are decoded only when asked for."""

    def __init__(self, payload: bytes) -> None:
        magic, n_docs, self.n_ids, self.n_blocks, n_out = np.frombuffer(payload, "<u4", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if gone else d for d, gone in zip(ids.tolist(), null.tolist())]
        self.counts = take("<u4", n_docs).astype(np.int64)
        self.low, self.width = take("<u4", self.n_blocks), take("u1", self.n_blocks)
        self.starts, self.out_starts = take("<u4", self.n_blocks + 1), take("<u4", self.n_blocks + 1)
        self.position, self.beyond = take("u1", n_out), take("<u4", n_out)
        self.packed = np.frombuffer(payload, np.uint8, -1, at)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last`` - 1, without the padding of the final block."""
        gap = np.zeros((last - first, BLOCK), np.uint32)
        width = self.width[first:last]
        for w in np.unique(width).tolist():
            if w:
                own = np.flatnonzero(width == w)
                body = self.packed[self.starts[first + own].astype(np.int64)[:, None] + np.arange(BLOCK * w // 8)]
                bits = np.unpackbits(body, axis=1).reshape(len(own), BLOCK, w)
                wide = np.zeros((len(own), BLOCK, 32 if w > 16 else 16), np.uint8)
                wide[:, :, :w] = bits
                gap[own] = np.packbits(wide, axis=2, bitorder="little").view("<u4" if w > 16 else "<u2")[:, :, 0]
        a, b = int(self.out_starts[first]), int(self.out_starts[last])
        owner = np.repeat(np.arange(last - first), np.diff(self.out_starts[first : last + 1].astype(np.int64)))
        gap[owner, self.position[a:b]] = self.beyond[a:b]
        ids = (gap + self.low[first:last, None]).reshape(-1)
        return ids[: self.n_ids - first * BLOCK]

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length - 1`` of the segment, from the blocks that hold them."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-(start + length) // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK :][:length]


# -- files ---------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
    key: str = "doc_id", text: str = "text", shards: int | None = None, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write every document's ids, each with ``end_id`` after it, in ascending ``key`` order.

    One shuffle, by range of the key; within a shard a segment closes once it
    holds ``segment_ids`` ids, so a task holds one segment and one Arrow batch
    however many rows a shard has. Rows with equal keys are ordered by a hash of
    the text and then by their place in the input, which also splits a key that
    many rows share over several shards. A null text is an empty document; a null
    key comes first; an empty table writes no segment; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).withColumns(
        {"_tie": F.xxhash64("text"), "_at": F.monotonically_increasing_id()}
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_at")]
    dealt = rows.repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order)
    numbered = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    map_text(numbered, _segments(tokenizer, end_id, segment_ids), SEGMENT_SCHEMA).write.mode("errorifexists").parquet(folder)


def _segments(tokenizer: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = public_encoder(tokenizer)
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = segment = first = 0
        shard = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, parts, counts, held, segment, first
            payload = encode_segment(docs, np.concatenate(parts), np.concatenate(counts))
            columns = [[shard], [segment], [first], [len(docs)], [held], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["shard", "segment", "first", "n_docs", "n_ids", "payload"]
            row = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            segment, first = segment + 1, first + held
            docs, parts, counts, held = [], [], [], 0
            return row

        for batch in batches:
            if batch.num_rows:
                shard = batch.column(0)[0].as_py()
            keys = batch.column(1).to_pylist()
            for at, ids, bounds in worker.column(batch.column(2)):
                n = len(bounds) - 1
                done = 0
                while done < n:
                    room = max(1, segment_ids - held)
                    stop = min(n, max(done + 1, int(np.searchsorted(bounds + np.arange(n + 1), bounds[done] + done + room, "right")) - 1))
                    docs += keys[at + done : at + stop]
                    counts.append(np.diff(bounds[done : stop + 1]) + 1)
                    parts.append(np.insert(ids[bounds[done] : bounds[stop]], bounds[done + 1 : stop + 1] - bounds[done], np.uint32(end_id)))
                    held += len(parts[-1])
                    done = stop
                    if held >= segment_ids:
                        yield close()
        if docs:
            yield close()

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a table of token-id files: ``doc_id, start, n_tokens, ids`` (uint32, little-endian).

    ``start`` counts the ids of all documents before it. Only one row per shard,
    its count of ids, is brought together for it.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    docs = map_text(files.select("shard", "first", "payload"), _documents, "doc_id long, shard int, start long, n_tokens long, ids binary")
    return _with_start(files, docs).select("doc_id", "start", "n_tokens", "ids")


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`read_token_files` with ``ids_crc32`` in place of the ids, taken as each file is decoded."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    docs = map_text(files.select("shard", "first", "payload"), _digests, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")
    return _with_start(files, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def _with_start(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the ids of all shards before to each start.

    The broadcast side has one row of two numbers per shard, and shards are as
    many as the writer was told to cut, whatever the number of documents.
    """
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))
    return docs.join(F.broadcast(offsets), "shard").withColumn("start", F.col("start") + F.col("_before"))


def _opened(batch: pa.RecordBatch):
    for shard, first, payload in zip(*(batch.column(k) for k in range(3))):
        segment = Segment(payload.as_py())
        starts = np.concatenate([[0], np.cumsum(segment.counts)])
        ids = segment.blocks(0, segment.n_blocks).astype("<u4")
        n = len(segment.doc_ids)
        head = [
            pa.array(segment.doc_ids, pa.int64()),
            pa.array(np.full(n, shard.as_py(), np.int32)),
            pa.array(starts[:-1] + first.as_py()),
            pa.array(segment.counts),
        ]
        yield head, ids, starts


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for head, ids, starts in _opened(batch):
            body = pa.array([ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*head, body], ["doc_id", "shard", "start", "n_tokens", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for head, ids, starts in _opened(batch):
            crc = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*head, crc], ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])
