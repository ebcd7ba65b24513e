"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from texelyard.session import ship_package

# Space, tab, line feed, vertical tab, form feed, carriage return: what bytes.split() splits on.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for; the cluster sizes them to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_text(
    rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers and Arrow batches of a few MB.

    Spark fills a batch by rows up to a limit of bytes of the session. Texts vary
    by orders of magnitude, so that limit is lowered to ``BATCH_BYTES`` if it is higher.
    """
    spark = rows.sparkSession
    ship_package(spark)
    limit = spark.conf.get(BATCH_LIMIT).rstrip("b")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(work, schema)


def with_row(rows: DataFrame, columns: str) -> StructType:
    """Schema of ``row`` as ``rows`` has it, whatever its fields are called, and then ``columns``."""
    return StructType([rows.schema["row"], *StructType.fromDDL(columns).fields])


def utf8(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, lengthened until no column of ``taken`` has it (names ignore case)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
