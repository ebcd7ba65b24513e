"""Packed files read by byte ranges: heads, index, stored ids, and only the slices that win.

No file is ever a value: a file of any size is a path and a length, and tasks read from it what is asked. Ranges are
dealt by file and stretch of the file, so that a task opens a file once and goes through it in order, and one huge file is read by
many tasks. Index entries become rows where their bytes are read, so many at once whatever the number of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from texelyard.functions import rules
from texelyard.functions.binary import header
from texelyard.functions.lookups import as_col
from texelyard.operators.packed import last_writer, packed_offsets
from texelyard.operators.running import ROWS_A_TASK
from texelyard.session import ship_package, stage

STRETCH_BITS = 26
INDEX_ENTRIES = 1 << 16  # of an index read at once, and rows made of them at once
BATCH_BYTES = 4 << 20


def read_ranges(ranges: DataFrame, name: str = "data", tasks: int | None = None) -> DataFrame:
    """``ranges`` (with ``path, start, size``) and the bytes there as ``name``, as many as the file has.

    A file that cannot be opened gives null. Only the rows themselves are shuffled, never bytes; into ``tasks`` tasks, or
    (None) as many as the session makes of them.
    """
    schema = StructType([*ranges.schema.fields, *StructType.fromDDL(f"{name} binary").fields])
    for field in schema:
        field.nullable = True
    return _dealt(ranges, tasks).mapInArrow(_reader(ranges.columns, list(schema.names)), schema)


def _dealt(ranges: DataFrame, tasks: int | None) -> DataFrame:
    ship_package(ranges.sparkSession)
    by = ["path", F.shiftright("start", STRETCH_BITS)]
    dealt = ranges.repartition(*by) if tasks is None else ranges.repartition(tasks, *by)
    return dealt.sortWithinPartitions("path", "start")


def _reader(columns: list[str], names: list[str]):
    spots = [columns.index(c) for c in ("path", "start", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        opened, source = None, None
        for batch in batches:
            first, held, found = 0, 0, []
            for k, (path, start, size) in enumerate(zip(*(batch.column(s).to_pylist() for s in spots))):
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, None
                    try:
                        system, place = pafs.FileSystem.from_uri(path)
                        source = system.open_input_file(place)
                    except OSError:
                        pass
                found.append(None if source is None else source.read_at(size, start) if start < source.size() else b"")
                held += size
                if held >= BATCH_BYTES:
                    yield _joined(batch.slice(first, k + 1 - first), found, names)
                    first, held, found = k + 1, 0, []
            if found:
                yield _joined(batch.slice(first), found, names)

    return run


def _joined(batch: pa.RecordBatch, found: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names)


def _word(data: F.Column, at: int) -> F.Column:
    """Little-endian word at a byte position, as BIGINT."""
    parts = [F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("bigint") * (1 << 8 * k) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def ranged_index(files: DataFrame) -> DataFrame:
    """Index rows ``f, i, n, sno, size, start`` of packed files given as ``path, length``; ``f`` is the path.

    The rules are those of :func:`texelyard.operators.packed.packed_index`. Of a file 8 bytes are read, 8 for each entry,
    and 4 where each entry's id is stored; files of two gigabytes and more are no special case.
    """
    plain = files.select("path", F.col("length").cast("bigint").alias("length"))
    heads = read_ranges(plain.filter("length >= 8").withColumns({"start": F.lit(0).cast("bigint"), "size": F.lit(8)}))
    good = heads.filter(F.length("data") == 8).withColumns({"magic": _word(F.col("data"), 0), "n": _word(F.col("data"), 4)})
    good = stage(good.filter((F.col("magic") == rules.PACKED_MAGIC) & (8 + 8 * F.col("n") <= F.col("length"))).select("path", "length", "n"), "heads")
    chunks = good.filter("n > 0").withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {INDEX_ENTRIES}L)")))
    left = F.least(F.lit(INDEX_ENTRIES).cast("bigint"), F.col("n") - F.col("first"))
    parts = chunks.select("path", "n", "first", (8 + 8 * F.col("first")).alias("start"), (8 * left).cast("int").alias("size"))
    tasks = max(1, -(-(good.agg(F.sum("n")).first()[0] or 0) // ROWS_A_TASK))
    entries = _dealt(parts, tasks).mapInArrow(_index_reader(parts.columns), "f string, i bigint, n bigint, sno int, size bigint")
    placed = packed_offsets(stage(entries, "entries")).join(good.select(F.col("path").alias("f"), "length"), "f")
    inside = placed.filter((F.col("start") + F.col("size") <= F.col("length")) & (F.col("start") + 4 <= F.col("length"))).drop("length")
    told = read_ranges(inside.withColumnsRenamed({"f": "path", "size": "held"}).withColumn("size", F.lit(4)), "stored", tasks)
    same = told.filter(_word(F.col("stored"), 0) == F.col("sno").cast("bigint").bitwiseAND(0xFFFFFFFF))
    return same.select(F.col("path").alias("f"), "i", "n", "sno", F.col("held").alias("size"), "start")


def _index_reader(columns: list[str]):
    read = _reader(columns, [*columns, "data"])
    return lambda batches: _entries(read(batches))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of index parts (``path, n, first`` and ``data``), at most ``INDEX_ENTRIES`` in one batch unless a part has more."""
    for batch in batches:
        data = batch.column("data")
        ends = np.cumsum(np.array([len(c.as_buffer()) // 8 for c in data], np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + INDEX_ENTRIES, "right")))
            yield _rows_of(batch.slice(at, stop - at))
            at = stop


def _rows_of(parts: pa.RecordBatch) -> pa.RecordBatch:
    words = [np.frombuffer(c.as_buffer(), "<u4").reshape(-1, 2) for c in parts.column("data")]
    size = np.array([len(w) for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    flat = np.concatenate(words)
    taken = pa.array(row)
    columns = [
        parts.column("path").take(taken),
        pa.array(parts.column("first").to_numpy()[row] + at),
        parts.column("n").take(taken),
        pa.array(flat[:, 0].astype(np.uint32).view(np.int32)),
        pa.array(flat[:, 1].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["f", "i", "n", "sno", "size"])


def ranged_slices(index: DataFrame, magic, format_hash) -> DataFrame:
    """``sno, data``: each id's winning slice behind its header, read from its file; nothing else is."""
    wanted = last_writer(index).select("sno", F.col("f").alias("path"), "start", F.col("size").cast("int").alias("size"))
    return read_ranges(wanted).select("sno", F.concat(header(magic, as_col(format_hash)), "data").alias("data"))
