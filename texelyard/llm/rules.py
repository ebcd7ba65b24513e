"""Quality rules: fixed limits first, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.llm.boosting import Forest, Growth, fit
from texelyard.llm.common import map_text, quoted, with_row
from texelyard.llm.labels import SAMPLE_ROWS, labelled_sample
from texelyard.llm.stats import BASE, NAMES, text_stats

LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
# A document is rejected only when its score, the chance of good quality, is below this.
KEEP_SCORE = 0.3

FEATURES = {
    # feature: bound (+1 raises the score, -1 lowers it, 0 free)
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "bangs_per_word": -1,
    "upper_share": -1,
    "digit_share": 0,
    "distinct_share": 1,
    "mean_word_chars": 0,
    "words_per_line": 0,
    "stops_per_word": 0,
    "log_words": 0,
}
BOUNDS = np.array(list(FEATURES.values()))


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios of the counts of ``NAMES``, one row per document."""
    s = dict(zip(NAMES, stats.astype(np.float64).T))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack(
        [
            s["n_symbols"] / chars,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_bangs"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_distinct"] / words,
            s["word_chars"] / words,
            s["n_words"] / lines,
            s["n_stops"] / words,
            np.log1p(s["n_words"]),
        ],
        axis=1,
    )


def base_failed(stats: np.ndarray) -> np.ndarray:
    words, repeats = stats[:, NAMES.index("n_words")], stats[:, NAMES.index("n_repeat_words")]
    return (words < LEAST_WORDS) | (100 * repeats > MOST_REPEAT_PERCENT * words)


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, growth: Growth = Growth()) -> Forest:
    """Fit on a bounded sample of labelled documents (see :func:`labelled_sample`)."""
    sample = labelled_sample(docs, labels, rows=sample_rows)
    stats = np.array([text_stats(t) for t, _ in sample], np.int64).reshape(-1, len(NAMES))
    return fit(features(stats), np.array([q for _, q in sample], np.float64), BOUNDS, growth)


STATS_TYPE = "struct<" + ",".join(f"{n}:long" for n in NAMES) + ">"


def judge(docs: DataFrame, forest: Forest, text: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """Every document judged: ``row`` (all columns of ``docs``), ``stats``, ``base_failed``, ``score`` and ``kept``.

    A document is kept unless a fixed limit fails it or its score is below
    ``keep_score``. A null or empty text has no words and fails. The forest, whose size is
    fixed by its growth, travels with the tasks; there is no shuffle, and a
    task holds one Arrow batch of texts.
    """
    given = F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    rows = docs.select(given, quoted(text).alias("text"))
    return map_text(rows, _judge(forest, keep_score), with_row(rows, f"stats {STATS_TYPE}, base_failed boolean, score double, kept boolean"))


def _judge(forest: Forest, keep_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([text_stats(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(NAMES))
            failed = base_failed(stats)
            score = forest.score(features(stats))
            told = pa.StructArray.from_arrays([pa.array(c) for c in stats.T], list(NAMES))
            columns = [batch.column(0), told, pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_score))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "stats", "base_failed", "score", "kept"])

    return run


def rule_digest(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    return judged.select(F.col("row").getField(key).alias(key), *[F.col("stats").getField(n).alias(n) for n in BASE], "base_failed", "kept", "score")


def kept_documents(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The documents that are kept, with their columns as they were."""
    return judge(docs, forest, text).filter("kept").select("row.*")
