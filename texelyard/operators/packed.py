"""Index of packed metadata files: entry offsets and the winning entry per id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.operators.running import blocked_running_sum
from texelyard.session import ship_package

BLOCK_BITS = 12  # entries per block: 4096
CUT_BYTES = 8 << 20  # of entries in one batch


def aligned(size: Column) -> Column:
    """Size rounded up to the data alignment, as BIGINT."""
    return F.shiftleft(F.shiftright(size.cast("bigint") + 7, 3), 3)


def packed_offsets(entries: DataFrame) -> DataFrame:
    """Add ``start`` to entry rows (f, i, n, sno, size).

    Files start with 8 bytes and 8 per index entry; each entry is aligned and
    preceded by 8 skipped bytes, so offsets are one running sum of sizes.
    """
    summed = blocked_running_sum(
        entries, "f", F.shiftright("i", BLOCK_BITS), ["i"], aligned(F.col("size")), "_before"
    )
    start = 8 + 8 * F.col("n") + 8 * (F.col("i") + 1) + F.col("_before")
    return summed.withColumn("start", start.cast("bigint")).drop("_before")


def last_writer(index: DataFrame) -> DataFrame:
    """One entry per id: the one of the latest file, then the latest position.

    An aggregate combines on the map side, so a hot id costs one row per task.
    """
    newest = F.max(F.struct("f", "i", "start", "size")).alias("e")
    return index.groupBy("sno").agg(newest).select("sno", "e.f", "e.i", "e.start", "e.size")


def packed_index(blobs: DataFrame, key: str = "f", blob: str = "blob") -> DataFrame:
    """Index rows (key, i, n, sno, size, start) of packed files held as BINARY.

    Files with a wrong magic, under 8 bytes, or with an index past their end
    give no rows; an entry whose stored id differs is skipped; an entry past
    the end ends its file. Blobs are read where the scan put them: no shuffle.
    """
    ship_package(blobs.sparkSession)
    return blobs.select(key, blob).mapInArrow(_decode_batches, _index_schema(blobs, key))


def packed_entries(blobs: DataFrame, key: str = "f", blob: str = "blob") -> DataFrame:
    """:func:`packed_index` with the bytes of each entry in ``data``."""
    ship_package(blobs.sparkSession)
    return blobs.select(key, blob).mapInArrow(_cut_batches, _index_schema(blobs, key) + ", data binary")


def _index_schema(blobs: DataFrame, key: str) -> str:
    return f"{key} {dict(blobs.dtypes)[key]}, i bigint, n bigint, sno int, size bigint, start bigint"


def _u32(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian words at byte positions, as int64."""
    word = data[at].astype(np.int64)
    for k in (1, 2, 3):
        word |= data[at + k].astype(np.int64) << (8 * k)
    return word


def _decode_batches(batches):
    for batch in batches:
        index, _, _ = _decode(batch)
        for at in range(0, index.num_rows, 1 << 20):
            yield index.slice(at, 1 << 20)


def _cut_batches(batches):
    for batch in batches:
        index, data, begin = _decode(batch)
        ends = np.cumsum(index.column("size").to_numpy())
        at = 0
        while at < index.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + CUT_BYTES, "right")))
            bounds = np.concatenate([[0], ends[at:stop] - before])
            flat = data[np.repeat(begin[at:stop] - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])]
            cuts = pa.BinaryArray.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*index.slice(at, stop - at).columns, cuts], [*index.schema.names, "data"])
            at = stop


def _decode(batch: pa.RecordBatch):
    """Index rows of all blobs of a batch, without a loop over blobs or entries.

    Also returns the bytes of the batch and where each entry begins in them.
    """
    keys, blobs = batch.column(0), batch.column(1)
    large = pa.types.is_large_binary(blobs.type)
    bounds = np.frombuffer(blobs.buffers()[1], np.int64 if large else np.int32)
    bounds = bounds[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    body = blobs.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    begin, length = bounds[:-1], np.diff(bounds)

    row = np.flatnonzero(length >= 8)
    row = row[_u32(data, begin[row]) == rules.PACKED_MAGIC]
    count = _u32(data, begin[row] + 4)
    fits = 8 + 8 * count <= length[row]
    row, count = row[fits], count[fits]

    owner = np.repeat(row, count)
    first = np.cumsum(count) - count
    i = np.arange(len(owner)) - np.repeat(first, count)
    n = np.repeat(count, count)
    slot = begin[owner] + 8 + 8 * i
    sno = _u32(data, slot).astype(np.uint32).view(np.int32)
    size = _u32(data, slot + 4)
    step = (size + 7) // 8 * 8
    run = np.cumsum(step) - step
    start = 8 + 8 * n + 8 * (i + 1) + run - run[np.repeat(first, count)]

    inside = (start + size <= length[owner]) & (start + 4 <= length[owner])
    owner, i, n, sno, size, start = (a[inside] for a in (owner, i, n, sno, size, start))
    stored = _u32(data, begin[owner] + start).astype(np.uint32).view(np.int32)
    good = stored == sno
    columns = [keys.take(pa.array(owner[good]))] + [pa.array(a[good]) for a in (i, n, sno, size, start)]
    index = pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "i", "n", "sno", "size", "start"])
    return index, data, (begin[owner] + start)[good]
