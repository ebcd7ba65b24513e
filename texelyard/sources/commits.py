"""Attempts that become visible at once, by one numbered commit each.

A writer puts its files below names of its own and then publishes an attempt: a small file whose name is the next
number and whose text is the attempt's name. The file is renamed into place, so it is there whole or not at all, and of
two writers that take the same number one is turned away. Files of an attempt without a commit are never read.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.sources.listing import exists

COMMITS = "number bigint, attempt string"


def new_attempt() -> str:
    """Name of an attempt; never one that could be read as a number."""
    return f"a-{uuid.uuid4().hex}"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``number, attempt`` of every commit below ``folder``; one row per attempt, none for a folder that is not there."""
    if not exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.text(f"{folder}/commits").select(
        F.col("_metadata.file_name").cast("bigint").alias("number"), F.col("value").alias("attempt")
    )


def last_number(spark: SparkSession, folder: str) -> int:
    return committed(spark, folder).agg(F.max("number")).first()[0] or 0


def publish(spark: SparkSession, folder: str, attempt: str, number: int) -> bool:
    """Commit ``attempt`` as ``number``; False if that number is taken, and nothing is changed then."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    held, target = hadoop.Path(f"{folder}/commits/.{attempt}"), hadoop.Path(f"{folder}/commits/{number:012d}")
    conf = spark._jsc.hadoopConfiguration()
    system = held.getFileSystem(conf)
    out = system.create(held, True)
    out.write(bytearray(attempt.encode()))
    out.close()
    no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(system.getUri(), conf).rename(held, target, no_overwrite)
    except (Py4JError, PySparkException):
        if not system.exists(target):
            raise
        system.delete(held, False)
        return False
    return True


def publish_next(spark: SparkSession, folder: str, attempt: str) -> int:
    """Commit ``attempt`` behind all others, whoever else commits meanwhile; returns its number."""
    number = last_number(spark, folder) + 1
    while not publish(spark, folder, attempt, number):
        number += 1
    return number
