"""Byte-level convolutional network for document quality, in numpy.

Filters look at eight bytes at every fourth byte of the whole text. The text is
cut into overlapping chunks, each filter is max-pooled in each chunk, and the
chunks' pools are combined by mean and by maximum into one vector, from which a
small dense layer makes one probability. Bytes are embedded before the filters; for
scoring, embedding and filters are folded into one table per filter position,
so a convolution is eight table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.llm.common import map_text, quoted, utf8, with_row
from texelyard.llm.labels import held_out, labelled_sample

WIDTH, STRIDE = 8, 4
CHUNK, HOP = 128, 112  # positions: chunks of 512 bytes, 64 of them shared with the next
FILTERS, EMBEDDED, HIDDEN = 24, 8, 16
SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 10 << 20
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 10, 700, 32, 0.005, 3e-3
SEED = 7


@dataclass
class Network:
    """Weights; ``folded`` has the table of each filter position."""

    weights: dict[str, np.ndarray]
    folded: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.fold()

    def fold(self) -> None:
        self.folded = np.einsum("be,kef->kbf", self.weights["embed"], self.weights["filters"])

    def responses(self, text: np.ndarray) -> np.ndarray:
        """Response of every filter at every position of a padded text."""
        n = (len(text) - WIDTH) // STRIDE + 1
        total = self.folded[0].take(text[0 : n * STRIDE : STRIDE], axis=0)
        for k in range(1, WIDTH):
            total += self.folded[k].take(text[k : k + n * STRIDE : STRIDE], axis=0)
        return total

    def head(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and probability of pooled vectors."""
        w = self.weights
        hidden = np.tanh(vectors @ w["dense"] + w["dense_bias"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"], -30, 30)))

    def vector(self, text: str | None) -> np.ndarray:
        """Mean and maximum over chunks of the rectified pools of one whole text."""
        got = self.responses(padded(text))
        first = chunk_starts(len(got))
        ends = np.minimum(first + CHUNK, len(got))
        bounds = np.stack([first, ends], axis=1).reshape(-1)[:-1]
        pools = np.maximum.reduceat(got, bounds, axis=0)[::2]
        pools = np.maximum(pools + self.weights["filter_bias"], 0)
        return np.concatenate([pools.mean(axis=0), pools.max(axis=0)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.head(np.stack([self.vector(t) for t in texts]).astype(np.float64))[1]


def padded(text: str | None) -> np.ndarray:
    """Bytes of the text with zeros after it, so that windows cover all of it."""
    raw = np.frombuffer(utf8(text), np.uint8)
    whole = max(WIDTH, -(-len(raw) // STRIDE) * STRIDE + WIDTH - STRIDE)
    return np.concatenate([raw, np.zeros(whole - len(raw), np.uint8)])


def chunk_starts(positions: int) -> np.ndarray:
    return np.arange(0, max(1, positions - (CHUNK - HOP)), HOP)


def fresh(rng: np.random.Generator) -> Network:
    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(
        {
            "embed": drawn(256, EMBEDDED, scale=0.5),
            "filters": drawn(WIDTH, EMBEDDED, FILTERS, scale=0.25),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "dense": drawn(2 * FILTERS, HIDDEN, scale=0.2),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": drawn(HIDDEN, scale=0.3),
            "out_bias": np.zeros((), np.float32),
        }
    )


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit by minibatches with Adam, a small sample more often; the same sample gives the same network.

    Without rows it stays as drawn.
    """
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    texts = [padded(t) for t, _ in sample]
    labels = np.array([q for _, q in sample], np.float64)
    mean = {k: np.zeros_like(w) for k, w in net.weights.items()}
    square = {k: np.zeros_like(w) for k, w in net.weights.items()}
    step = 0
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(len(texts), 1)))
    for epoch in range(epochs if texts else 0):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            for name, slope in _slopes(net, [texts[k] for k in own], labels[own]).items():
                slope = slope + DECAY * net.weights[name]
                mean[name] = 0.9 * mean[name] + 0.1 * slope
                square[name] = 0.999 * square[name] + 0.001 * slope * slope
                move = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
                net.weights[name] = (net.weights[name] - rate * move).astype(np.float32)
            net.fold()
    return net


def _slopes(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean logistic loss of some texts; only pooled positions pass it back."""
    w = net.weights
    kept, vectors = [], []
    for text in texts:
        got = net.responses(text)
        first = chunk_starts(len(got))
        at = np.minimum(first[:, None] + np.arange(CHUNK), len(got) - 1)
        best = got[at].argmax(axis=1)
        place = np.take_along_axis(at, best, axis=1)
        pools = np.maximum(np.take_along_axis(got, place, axis=0) + w["filter_bias"], 0)
        top = pools.argmax(axis=0)
        vectors.append(np.concatenate([pools.mean(axis=0), pools.max(axis=0)]))
        kept.append((text, place, pools, top))
    x = np.stack(vectors).astype(np.float64)
    hidden, p = net.head(x)
    error = (p - labels) / len(labels)
    back = (error[:, None] * w["out"]) * (1 - hidden * hidden)
    to_vector = back @ w["dense"].T
    places, weights = [], []
    filter_bias = np.zeros(FILTERS)
    for (text, place, pools, top), slope in zip(kept, to_vector):
        passed = np.repeat(slope[None, :FILTERS] / len(pools), len(pools), axis=0)
        passed[top, np.arange(FILTERS)] += slope[FILTERS:]
        passed *= pools > 0
        filter_bias += passed.sum(axis=0)
        for k in range(WIDTH):
            places.append(((k * 256 + text[place * STRIDE + k].astype(np.int64)) * FILTERS + np.arange(FILTERS)).reshape(-1))
            weights.append(passed.reshape(-1))
    size = WIDTH * 256 * FILTERS
    folded = np.bincount(np.concatenate(places), np.concatenate(weights), size).reshape(WIDTH, 256, FILTERS)
    return {
        "embed": np.einsum("kbf,kef->be", folded, w["filters"]),
        "filters": np.einsum("kbf,be->kef", folded, w["embed"]),
        "filter_bias": filter_bias,
        "dense": x.T @ back,
        "dense_bias": back.sum(axis=0),
        "out": hidden.T @ error,
        "out_bias": error.sum(),
    }


def fit_network(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on a bounded sample of labelled documents that are not held out (see :func:`labelled_sample`)."""
    return train(labelled_sample(docs, labels, label, rows=sample_rows, most_bytes=sample_bytes))


def score_documents(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``, the probability of label 1, of every document.

    Only the text is scored, the whole of it; a null or empty one is eight zero bytes. The
    network's size is fixed and it travels with the tasks. No shuffle.
    """
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = net.score([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    return map_text(rows, run, with_row(rows, "score double"))


def score_digest(scored: DataFrame, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    own = F.col("row").getField(key)
    return scored.select(own.alias(key), held_out(own).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
