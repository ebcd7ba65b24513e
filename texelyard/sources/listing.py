"""Files below a folder, listed on executors level by level.

Spark's own listing keeps a file index on the driver and hides names that begin with ``_`` or ``.``. Here the
folders of one level are a table, dealt to tasks; what they hold is written to the shared folder, and the folders
among it are the next level. The driver sees one number per level.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.session import ship_package, stage

ENTRIES = "path string, is_folder boolean, length bigint, modified timestamp, error string"
_TYPES = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string()]
_NAMES = ["path", "is_folder", "length", "modified", "error"]
ROWS_AT_ONCE = 1 << 14


def list_tree(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Regular files below ``folder`` as ``path, length, modified, error``, hidden names included.

    Paths are addresses with their scheme. Links to files are files, links to folders are not followed. A folder that cannot be read
    is a row with an ``error`` and without a length; a missing ``folder`` raises FileNotFoundError, an empty one gives no rows. There is one
    job per level of the deepest path. One folder is listed by one task, in pieces where the file system is local.
    """
    ship_package(spark)
    root = address(folder)
    if not exists(spark, root):
        raise FileNotFoundError(f"{folder} does not exist")
    found: list[DataFrame] = []
    folders = spark.createDataFrame([(root,)], "path string")
    count = 1
    while count:
        parts = max(1, min(count, spark.sparkContext.defaultParallelism * 8))
        listed = stage(folders.repartition(parts).mapInArrow(_listed, ENTRIES), "listing")
        found.append(listed.filter("NOT is_folder OR error IS NOT NULL").drop("is_folder"))
        folders = listed.filter("is_folder AND error IS NULL").select("path")
        count = folders.count() if recursive else 0
    return reduce(DataFrame.unionAll, found)


def address(folder: str) -> str:
    """A folder with its scheme and without a trailing slash; ``file:`` where none is given."""
    whole = folder if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder) else "file:" + os.path.abspath(folder)
    return re.sub(r"^file:/+", "file:/", whole).rstrip("/")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = []
            try:
                for row in _local(folder) if folder.startswith("file:") else _remote(folder):
                    rows.append(row)
                    if len(rows) == ROWS_AT_ONCE:
                        yield _rows(rows)
                        rows = []
            except OSError as error:
                rows.append((folder, True, None, None, f"{type(error).__name__}: {error.strerror or error}"))
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _local(folder: str) -> Iterator[tuple]:
    with os.scandir(folder.removeprefix("file:")) as entries:
        for entry in entries:
            path = f"{folder}/{entry.name}"
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield path, True, None, None, None
                elif entry.is_file():
                    told = entry.stat()
                    yield path, False, told.st_size, datetime.fromtimestamp(told.st_mtime, timezone.utc), None
            except OSError as error:
                yield path, False, None, None, f"{type(error).__name__}: {error.strerror or error}"


def _remote(folder: str) -> Iterator[tuple]:
    import pyarrow.fs as pafs

    system, root = pafs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    for entry in system.get_file_info(pafs.FileSelector(root)):
        if entry.type == pafs.FileType.Directory:
            yield scheme + entry.path, True, None, None, None
        elif entry.type == pafs.FileType.File:
            yield scheme + entry.path, False, entry.size, entry.mtime, None
