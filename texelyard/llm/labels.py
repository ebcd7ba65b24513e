"""Bounded samples of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.llm.common import quoted

SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 24 << 20


def held_out(key: Column) -> Column:
    """Rows kept from fitting: crc32 of the id as text divides by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
) -> list[tuple[str, int]]:
    """Texts and labels to fit on, on the driver: at most ``rows`` texts and about ``most_bytes`` bytes.

    The sample is the first ``rows`` fitting ids by a hash of the id, so it does not
    depend on file order or cluster size. Ids with two different labels, null
    labels and held-out ids are not used; of a repeated document the smallest text
    is. Texts are whole, never cut: one of more than a 64th of ``most_bytes`` is left out of
    the fit, and the sample ends before the text that would take it over ``most_bytes``.
    """
    usable = labels.select(quoted(key).cast("long").alias("id"), quoted(label).cast("int").alias("label")).dropna()
    once = usable.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = once.filter(F.col("label") == F.col("_other")).select("id", "label").orderBy(*order).limit(rows)
    # At most ``rows`` pairs of numbers are broadcast.
    texts = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text")).join(F.broadcast(chosen), "id")
    share = most_bytes // 64
    small = texts.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= share)
    out, held = [], 0
    kept = small.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy(*order)
    for row in kept.toLocalIterator():
        held += len(row.text.encode())
        if held > most_bytes:
            break
        out.append((row.text, row.label))
    return out
