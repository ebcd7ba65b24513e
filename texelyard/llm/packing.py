"""Packing of documents into token sequences by lexical retrieval.

Documents are first brought to related ones: a sample gives centroids of BM25 vectors, and each
document takes its nearest centroid and its heaviest feature as key. The ids of each key are counted over
all documents, and keys in order fill tasks of equal numbers of ids; a key that reaches over several tasks is dealt among them by
hash. A task cuts its rows, ordered by key, into shards of
a bounded number of ids, and each shard has a BM25 inverted index over the token ids of its whole
documents. A seed's query is all of its distinct ids. A sequence begins with a seed document; the index returns its best
unused neighbours, which fill the rest one after another. A document that does not fit is cut,
and what is left of it is the next sequence's seed, so only a shard's last sequence has padding.

A document may also ask further shards, up to all of them, for its best neighbour; documents that are joined by such links are then
packed in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texelyard.llm.common import map_text, quoted
from texelyard.llm.components import connected
from texelyard.llm.tokens import SLICE_BYTES, public_encoder, release_encoders
from texelyard.session import stage

CAPACITY = 2048
SHARD_IDS = 1 << 22
SHARD_DOCS = 1 << 16
K1, B = 1.2, 0.75
# A term that more than one in so many documents hold is a dense row; the rest are postings.
DENSE_IN = 16
BLOCK = 1024  # documents whose dense scores are summed at once
# Placement: features are ids modulo a power of two. Centroids are fitted on about so many whole texts, none longer than the limit.
FEATURES, CENTROIDS, ROUNDS = 1 << 11, 32, 8
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 1 << 16
PLACED_AT_ONCE = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Statistics:
    """Of all documents, where a shard's own would make scores of different shards differ."""

    docs: int
    mean: float
    holders: np.ndarray


class Index:
    """BM25 postings of one shard, document by document and term by term."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, whole: Statistics | None = None) -> None:
        self.docs = len(bounds) - 1
        owner = np.repeat(np.arange(self.docs, dtype=np.uint64), np.diff(bounds))
        if self.docs <= 1 << 16 and (not len(ids) or ids.max() < 1 << 16):
            key, times = np.unique((owner.astype(np.uint32) << np.uint32(16)) | ids.astype(np.uint32), return_counts=True)
            doc, term = key >> np.uint32(16), (key & np.uint32(0xFFFF)).astype(np.uint16)
        else:
            key, times = np.unique((owner << np.uint64(32)) | ids.astype(np.uint64), return_counts=True)
            doc, term = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        doc = doc.astype(np.int64)
        size = np.diff(bounds)
        holders = np.bincount(term, minlength=1)
        mean = size.mean() if self.docs else 1.0
        if whole is None:
            idf = np.log1p((self.docs - holders + 0.5) / (holders + 0.5))
        else:
            held, mean = whole.holders[: len(holders)], whole.mean
            idf = np.log1p((whole.docs - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * size / max(mean, 1.0))
        weight = (idf[term] * times * (K1 + 1) / (times + norm[doc])).astype(np.float32)
        self.term = term
        self.doc_at = np.searchsorted(doc, np.arange(self.docs + 1))
        common = np.flatnonzero(holders * DENSE_IN > self.docs)
        self.row = np.full(len(holders), -1, np.int32)
        self.row[common] = np.arange(len(common))
        row = self.row[term]
        dense = np.zeros((len(common), self.docs), np.float32)
        dense[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self.dense = [np.ascontiguousarray(dense[:, at : at + BLOCK]) for at in range(0, self.docs, BLOCK)]
        self.left = np.arange(self.docs)
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.holder, self.weight = doc[rare], weight[rare]
        self.term_at = np.concatenate([[0], np.cumsum(np.where(self.row < 0, holders, 0))])

    def drop(self, used: np.ndarray) -> None:
        """Leave documents out of the dense rows: scores of the others stay as they are, theirs mean nothing any more."""
        stay, at, dense = ~used[self.left], 0, []
        for block in self.dense:
            dense.append(np.ascontiguousarray(block[:, stay[at : at + block.shape[1]]]))
            at += block.shape[1]
        self.dense, self.left = [block for block in dense if block.shape[1]], self.left[stay]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document of the shard for all distinct ids of the seed."""
        return self.scores_of(self.term[self.doc_at[seed] : self.doc_at[seed + 1]].astype(np.int64))

    def scores_of(self, own: np.ndarray) -> np.ndarray:
        """BM25 score of every document of the shard for a query of distinct ids."""
        own = own[own < len(self.row)]
        row = self.row[own]
        rare, row = own[row < 0], row[row >= 0]
        scores = np.zeros(self.docs)
        scores[self.left] = np.concatenate([np.zeros(0, np.float32), *[np.add.reduce(block.take(row, 0), 0) for block in self.dense]])
        if len(rare):
            cuts = list(zip(self.term_at[rare].tolist(), self.term_at[rare + 1].tolist()))
            holders = np.concatenate([self.holder[p:q] for p, q in cuts])
            scores += np.bincount(holders, np.concatenate([self.weight[p:q] for p, q in cuts]), self.docs)
        return scores


def pack(index: Index, lengths: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard, gapless in each sequence.

    Used documents leave the index whenever they are a quarter of it, so it serves one run only.
    """
    size = lengths.tolist()
    used = np.zeros(index.docs, bool)
    taken = 0
    seed, sequence, room = 0, -1, 0
    rest: tuple[int, int] | None = None
    scores: np.ndarray | None = None
    while True:
        if rest is None:
            k = -1
            if room and scores is not None:
                k = int(scores.argmax())
                if scores[k] <= 0:
                    k = -1
            fresh = k < 0
            if fresh:
                while seed < index.docs and used[seed]:
                    seed += 1
                if seed == index.docs:
                    return
                k = seed
            used[k] = True
            taken += 1
            start = 0
        else:
            (k, start), fresh = rest, True
        if not room:
            sequence, room, fresh = sequence + 1, capacity, True
        length = min(room, size[k] - start)
        yield k, start, length, sequence, capacity - room
        room -= length
        rest = (k, start + length) if start + length < size[k] else None
        if room and fresh:
            if 4 * taken >= len(index.left):
                index.drop(used)
                taken = 0
            scores = index.scores(k)
            scores[used] = 0
        elif room:
            scores[k] = 0
        else:
            scores = None


@dataclass
class Placement:
    """Key of a document, from its ids."""

    idf: np.ndarray
    mean: float
    centroids: np.ndarray

    def keys(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Nearest centroid and heaviest feature of each document as one number below ``CENTROIDS * FEATURES``."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(bounds) - 1, PLACED_AT_ONCE):
            vectors = _vectors(ids, bounds[at : at + PLACED_AT_ONCE + 1], self.idf, self.mean)
            found.append((vectors @ self.centroids.T).argmax(1) * FEATURES + vectors.argmax(1))
        return np.concatenate(found)


def _vectors(ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray | None, mean: float) -> np.ndarray:
    """BM25 weights of each document by feature; numbers of ids without ``idf``."""
    size = np.diff(bounds)
    cell = np.repeat(np.arange(len(size)) * FEATURES, size) + (ids[bounds[0] : bounds[-1]] & (FEATURES - 1))
    times = np.bincount(cell, minlength=len(size) * FEATURES).reshape(-1, FEATURES).astype(np.float32)
    if idf is None:
        return times
    norm = (K1 * (1 - B + B * size / mean)).astype(np.float32)
    return idf * (times * np.float32(K1 + 1) / (times + norm[:, None]))


def fit_placement(ids: np.ndarray, bounds: np.ndarray) -> Placement:
    """Centroids by spherical k-means over a sample in random order."""
    docs = len(bounds) - 1
    mean = max(1.0, len(ids) / max(docs, 1))
    holders = (_vectors(ids, bounds, None, mean) > 0).sum(axis=0)
    idf = np.log1p((docs - holders + 0.5) / (holders + 0.5)).astype(np.float32)
    vectors = _unit(_vectors(ids, bounds, idf, mean))
    centroids = vectors[:CENTROIDS] if docs else np.zeros((1, FEATURES), np.float32)
    for _ in range(ROUNDS if docs else 0):
        nearest = (vectors @ centroids.T).argmax(1)
        sums = [vectors[nearest == k].sum(axis=0) if (nearest == k).any() else c for k, c in enumerate(centroids)]
        centroids = _unit(np.array(sums))
    # Neighbours in number are neighbours in direction: each centroid is followed by the nearest that is left.
    order, left = [0], set(range(1, len(centroids)))
    while left:
        order.append(max(left, key=lambda k: centroids[order[-1]] @ centroids[k]))
        left.remove(order[-1])
    return Placement(idf, mean, centroids[order])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


PLACED = "doc_id long, key long, n_ids long, wide boolean, ids binary"


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1,
    key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS, with_ids: bool = True, ask: int | None = 1,
    remembered: int | None = None, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Pieces of all documents: where each run of a document's ids lies, and (``with_ids``) the ids.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and
    ``ids`` (uint32, little-endian). Every document ends with ``end_id``, so a null or empty
    text is one id; keys may be null or repeated, each row is packed by itself;
    other columns are not read. ``docs`` is read for a sample and for its ids, which are written once, and
    shuffled once, to related ones. A task has about ``shard_ids`` ids and one shard; a shard closes at so many ids or 65,536 documents, and a
    task holds one shard and one Arrow batch. Rows are dealt and ordered by what they hold, so files and their order do not matter
    but for rows alike in id and text. Sequence ids hold the task's partition in the upper half.

    A seed finds neighbours in its own shard. With ``ask`` over 1 every document first asks so many
    shards (None: all, which is exact) for its best neighbour, and documents so linked move to
    one shard; that shuffles all ids ``ask`` times and scores every document against all the shards it asks.

    A worker remembers the ids of ``remembered`` pieces of text (None: 800,000), about 200 bytes each, and
    encodes ``slice_bytes`` of text at a time; less of either takes less memory and more time.
    """
    rows = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"))
    placed = stage(map_text(rows, _place(tokenizer, _placement(rows, tokenizer, remembered, slice_bytes), remembered, slice_bytes), PLACED), "placed-ids")
    dealt, tasks = deal(placed, shard_ids)
    if ask != 1 and tasks > 1:
        dealt = _with_neighbours(dealt, tasks, ask, shard_ids)
    else:
        dealt = dealt.withColumn("near", F.lit(0).cast("long"))
    dealt = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("near", "key", "doc_id", "ids")
    schema = PIECES + (", ids binary" if with_ids else "")
    return map_text(dealt.select(F.spark_partition_id().alias("part"), "doc_id", "wide", "ids"), _pack(capacity, end_id, shard_ids, with_ids), schema)


def deal(placed: DataFrame, shard_ids: int) -> tuple[DataFrame, int]:
    """``placed`` with the ``task`` of each row, and the number of tasks.

    Keys in order fill the tasks; rows of a key that reaches over several go by a hash of id and ids. The
    ids of each of the ``CENTROIDS * FEATURES`` keys are counted over all rows, and that table is broadcast.
    """
    counted = placed.groupBy("key").agg(F.sum(F.col("n_ids") + 1).alias("held"))
    before = F.sum("held").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    keys = stage(counted.select("key", "held", F.coalesce(before, F.lit(0)).alias("before")), "keys")
    total = keys.agg(F.sum("held")).first()[0] or 0
    tasks = max(1, -(-total // shard_ids))
    share = (F.shiftrightunsigned(F.xxhash64("doc_id", "ids"), 11)).cast("double") / float(1 << 53)
    spot = (F.col("before") + F.floor(share * F.col("held"))).cast("double") * tasks / float(max(total, 1))
    return placed.join(F.broadcast(keys), "key").withColumn("task", F.least(F.floor(spot), F.lit(tasks - 1)).cast("int")).drop("held", "before"), tasks


def _placement(rows: DataFrame, tokenizer: str, remembered: int | None = None, slice_bytes: int = SLICE_BYTES) -> Placement:
    """Fitted on whole texts chosen by hash, so the same whatever files they are in."""
    small = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)).between(1, SAMPLE_BYTES)).withColumn("h", F.xxhash64("doc_id", "text"))
    count = small.count()
    chosen = small if count <= SAMPLE_ROWS else small.filter(F.pmod("h", F.lit(1 << 30)) < int(SAMPLE_ROWS / count * (1 << 30)))
    found = map_text(chosen.select("doc_id", "text"), _place(tokenizer, None, remembered, slice_bytes), PLACED)
    drawn = sorted((zlib.crc32(r.ids), r.ids, r.wide) for r in found.select("ids", "wide").collect())
    parts = [np.frombuffer(ids, "<u4" if wide else "<u2") for _, ids, wide in drawn]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return fit_placement(np.concatenate([np.zeros(0, np.uint32), *parts]), bounds)


def _place(tokenizer: str, placement: Placement | None, remembered: int | None = None, slice_bytes: int = SLICE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = public_encoder(tokenizer, remembered)
        for batch in batches:
            for at, ids, bounds in worker.column(batch.column(1), slice_bytes):
                n = len(bounds) - 1
                keys = np.zeros(n, np.int64) if placement is None else placement.keys(ids, bounds)
                wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
                ids = ids.astype("<u4" if wide else "<u2")
                offsets = pa.array(bounds * ids.itemsize, pa.int32())
                column = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
                columns = [batch.column(0).slice(at, n), pa.array(keys, pa.int64()), pa.array(np.diff(bounds)), pa.array([wide] * n), column]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_ids", "wide", "ids"])

    return run


def statistics(placed: DataFrame) -> Statistics:
    """Documents, their mean length and how many hold each id; as many numbers as the vocabulary has ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _ids(batch.column(0), batch.column(1)):
                own = np.unique(ids).astype(np.int64)
                held = np.concatenate([held, np.zeros(max(0, int(own.max(initial=-1)) + 1 - len(held)), np.int64)])
                held[own] += 1
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["id", "n"])

    docs, mean = placed.agg(F.count(F.lit(1)), F.avg("n_ids")).first()
    counts = placed.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    holders = np.zeros(max((r.id for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        holders[r.id] = r.n
    return Statistics(docs, float(mean or 1.0), holders)


def nearest(dealt: DataFrame, tasks: int, ask: int | None, shard_ids: int = SHARD_IDS, k: int = 1) -> DataFrame:
    """``query, found, score``: the ``k`` best neighbours by BM25 over all documents of each row, among the shards it asks.

    ``dealt`` has ``row`` (unique), ``task, wide, ids``. A row asks the ``ask`` tasks around its own in the
    order of keys, all of them if None. A task indexes its shards, then scores one query after another and
    keeps ``k`` a shard; equal scores go by smaller row. Only positive scores are neighbours.
    """
    whole = statistics(dealt)
    asked = tasks if ask is None else min(ask, tasks)
    steps = [(j + 1) // 2 * (1 if j % 2 else -1) for j in range(asked)]
    targets = F.array(*[F.pmod(F.col("task") + step, F.lit(tasks)) for step in steps])
    columns = ["row", "wide", "ids"]
    queries = dealt.select(F.explode(targets).alias("task"), F.lit(1).alias("role"), *columns)
    both = dealt.select("task", F.lit(0).alias("role"), *columns).unionAll(queries)
    sorted_rows = both.repartitionById(tasks, F.col("task")).sortWithinPartitions("role", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[tuple[np.ndarray, Index]] = []
        own: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> None:
            nonlocal held
            held = 0
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
            indexes.append((np.array(own), Index(np.concatenate(parts), bounds, whole)))
            own.clear()
            parts.clear()

        for batch in batches:
            query, found, score = [], [], []
            for role, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _ids(batch.column(2), batch.column(3))):
                if role == 0:
                    if own and (held + len(ids) > shard_ids or len(own) >= SHARD_DOCS):
                        close()
                    held += len(ids)
                    own.append(row)
                    parts.append(ids)
                    continue
                if own:
                    close()
                terms = np.unique(ids).astype(np.int64)
                for rows, index in indexes:
                    scores = index.scores_of(terms)
                    scores[rows == row] = 0
                    best = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
                    best = np.flatnonzero(scores >= max(scores[best].min(), 1e-12))
                    best = best[np.lexsort((rows[best], -scores[best]))][:k]
                    query += [row] * len(best)
                    found += rows[best].tolist()
                    score += scores[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query", "found", "score"])

    scored = map_text(sorted_rows.select("role", *columns), run, "query long, found long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "found")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _with_neighbours(dealt: DataFrame, tasks: int, ask: int | None, shard_ids: int) -> DataFrame:
    """Rows linked by best neighbours in the task of the least of them, but for groups too large for half a shard."""
    numbered = stage(dealt.withColumn("row", F.monotonically_increasing_id()), "dealt-ids")
    links = nearest(numbered, tasks, ask, shard_ids).select("query", "found")
    roots = stage(connected(links).select(F.col("node").alias("row"), F.col("root").alias("near")), "near")
    grouped = numbered.select("row", "task", "n_ids").join(roots, "row")
    groups = grouped.groupBy("near").agg(F.sum(F.col("n_ids") + 1).alias("held"), F.max(F.when(F.col("row") == F.col("near"), F.col("task"))).alias("home"))
    small = groups.filter(F.col("held") <= shard_ids // 2).select("near", "home")
    moved = roots.join(small, "near").select("row", "near", "home")
    joined = numbered.join(moved, "row", "left").withColumn("task", F.coalesce("home", "task"))
    return joined.select("doc_id", "key", "n_ids", "wide", "ids", "task", F.coalesce("near", F.lit(-1)).alias("near"))


def _pack(capacity: int, end_id: int, shard_ids: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()  # a worker that placed documents before needs the room for shards
        part = sequences = held = 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal sequences, held, keys, parts
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
            parts = []
            lengths = np.diff(bounds) + 1
            found = np.array(list(pack(Index(ids, bounds), lengths, capacity)), np.int64).reshape(-1, 5)
            doc, start, length, sequence, offset = found.T
            closed = np.insert(ids.astype("<u4"), bounds[1:], np.uint32(end_id))
            first = (bounds[:-1] + np.arange(len(lengths)))[doc] + start
            cuts = [closed[a : a + n] for a, n in zip(first.tolist(), length.tolist())]
            columns = [
                pa.array(keys, pa.int64()).take(pa.array(doc)),
                *(pa.array(c) for c in (start, length)),
                pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                pa.array(lengths[doc]),
                pa.array(sequence + sequences + (part << 32)),
                pa.array(offset),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
                names.append("ids")
            sequences += int(sequence[-1]) + 1
            keys, held = [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            given = batch.column(1).to_pylist()
            for doc_id, found in zip(given, _ids(batch.column(2), batch.column(3))):
                if keys and (held + len(found) > shard_ids or len(keys) >= SHARD_DOCS):
                    yield close()
                keys.append(doc_id)
                parts.append(found)
                held += len(found)
        if keys:
            yield close()

    return run


def _ids(wide: pa.Array, ids: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each row, two bytes each or four; a copy, as the batch goes."""
    for w, cell in zip(wide.to_pylist(), ids):
        yield np.frombuffer(cell.as_buffer(), "<u4" if w else "<u2").copy()
