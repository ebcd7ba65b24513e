"""Recent items per user, kept as a table that new events update without reading old ones.

The table holds at most ``n`` rows a user. A version is written beside the one before and published by one commit, on the
condition that no other update was published meanwhile; an update that comes second starts again from the newer version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from texelyard.functions import rules
from texelyard.operators.report import recent_items
from texelyard.sources.commits import committed, new_attempt, publish

STATE = "user_id bigint, item string, ts timestamp, position int"


def merge_recent(kept: DataFrame, events: DataFrame, n: int = rules.MAX_RECENT) -> DataFrame:
    """The ``n`` most recent items of each user from a table of such and new ``user_id, item, ts``.

    An item that ``kept`` does not hold has ``n`` items before it, and those stay before it, so the result is that of all
    events. Times are reduced by their maximum: late, repeated and reordered events change nothing else.
    """
    return recent_items(kept.select("user_id", "item", "ts").unionByName(events.select("user_id", "item", "ts")), n)


def _version(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    last = committed(spark, folder).orderBy(F.desc("number")).first()
    if last is None:
        return 0, spark.createDataFrame([], STATE)
    return last.number, spark.read.schema(STATE).parquet(f"{folder}/versions/{last.attempt}")


def read_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The published table; empty before the first update."""
    return _version(spark, folder)[1]


def update_recent(events: DataFrame, folder: str, n: int = rules.MAX_RECENT) -> int:
    """Merge ``events`` into the table in ``folder``; returns the number of the version.

    Repeating an update, as after a lost driver, leaves the table as it is.
    """
    spark = events.sparkSession
    while True:
        number, kept = _version(spark, folder)
        attempt = new_attempt()
        merge_recent(kept, events, n).write.parquet(f"{folder}/versions/{attempt}")
        if publish(spark, folder, attempt, number + 1):
            return number + 1


def keep_recent(events: DataFrame, folder: str, checkpoint: str, n: int = rules.MAX_RECENT, **trigger) -> StreamingQuery:
    """Keep the table in ``folder`` up to date from a stream; ``trigger`` as in ``DataStreamWriter.trigger``.

    A batch that Spark hands over twice is merged twice, which changes nothing, so each event counts exactly once.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).foreachBatch(lambda batch, _: update_recent(batch, folder, n) and None).start()
