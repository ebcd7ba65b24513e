"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased, everything but letters, digits and
characters beyond ASCII is a gap). The benchmark's words are numbered, and the
automaton holds every window of consecutive words of every item as a sequence of
those numbers; a word that no item has is the number 0, which no window holds. One
scan of a document's words finds every occurrence of every window; word positions
lead back to character offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.llm.common import TO_LOWER, map_text, quoted, utf8, with_row

WINDOW = 10
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Lower-cases A-Z and turns every byte outside words to a space.
TO_WORDS = bytes(c if WORD.match(bytes([c])) else 32 for c in TO_LOWER)


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(TO_WORDS).split()


def benchmark_blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items as lists of (id, text), each of about ``block_bytes`` bytes of text.

    The number of blocks follows the measured size of the benchmark, and one block
    at a time is on the driver.
    """
    rows = items.select(F.coalesce(quoted(key).cast("string"), F.lit("")).alias("id"), quoted(text).alias("text")).filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for block in range(n):
        yield [(r.id, r.text) for r in dealt.filter(F.col("block") == block).collect()]


class Automaton:
    """Windows of some items; built once per Python worker from a broadcast block."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            coded = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for at in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(tuple(coded[at : at + window]), set()).add(name)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if owners else None
        for sequence, names in owners.items():
            self.tree.add_word(sequence, (len(sequence), frozenset(names)))
        if self.tree is not None:
            self.tree.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words as (first, last), and the items with a window among them."""
        if self.tree is None or not found:
            return [], set()
        get = self.numbers.get
        coded = tuple([get(w, 0) for w in found])
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        for end, (length, owners) in self.tree.iter(coded):
            hits.append((end - length + 1, end))
            names |= owners
        return merged(hits), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word runs, touching ones joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


_built: dict[str, Automaton] = {}


def _automaton(block: Broadcast, window: int, name: str) -> Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(block.value, window)
    return _built[name]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every document with the benchmark windows that occur in it.

    Returns ``row`` (all columns of ``docs``), ``n_words``, ``words`` (runs of hit
    words, first and last), ``chars`` (the same runs as code-point offsets of the
    original text, end exclusive) and ``items`` (sorted ids of the items found).

    An item with fewer words than a window is one window; one without words, or null, none. An
    item id that is null counts as the empty string; repeated ids are one item. A
    null or empty document has no words. No shuffle: a block of at most about
    ``block_bytes`` of benchmark text is broadcast per pass, and documents go
    through as many passes as the benchmark has blocks.
    """
    spark = docs.sparkSession
    given = F.struct(*[quoted(c) for c in docs.columns]) if docs.columns else F.struct()
    found = docs.select(given.alias("row"), quoted(text).alias("text"))
    state = "n_words long, words array<struct<first:long,last:long>>, items array<string>"
    scanned, told = with_row(found, f"text string, {state}"), with_row(found, f"{state}, chars array<struct<start:long,end:long>>")
    for n, block in enumerate(benchmark_blocks(benchmark, item_key, item_text, block_bytes)):
        shared = spark.sparkContext.broadcast(block)
        found = map_text(found, _scan(shared, window, n == 0), scanned)
    return map_text(found, _with_offsets, told)


RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
OFFSETS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(block: Broadcast, window: int, first_pass: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _automaton(block, window, name)
        for batch in batches:
            counts, runs, items = [], [], []
            for k, text in enumerate(batch.column(1)):
                found = words(text.as_py())
                hits, names = tree.scan(found)
                if not first_pass:
                    hits = merged(hits + [(r["first"], r["last"]) for r in batch.column(3)[k].as_py()])
                    names |= set(batch.column(4)[k].as_py())
                counts.append(len(found))
                runs.append([{"first": a, "last": b} for a, b in hits])
                items.append(sorted(names))
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_words", "words", "items"])

    return run


def _with_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars = [
            offsets(batch.column(1)[k].as_py(), [(r["first"], r["last"]) for r in runs]) if (runs := held.as_py()) else []
            for k, held in enumerate(batch.column(3))
        ]
        columns = [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(chars, OFFSETS)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "words", "items", "chars"])


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code-point offsets of runs of words in the original text."""
    raw = utf8(text)
    spans = [m.span() for m in WORD.finditer(raw.translate(TO_LOWER))]
    # Code points before each byte: every byte that does not continue a character begins one.
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])
    return [{"start": int(before[spans[a][0]]), "end": int(before[spans[b][1]])} for a, b in runs]


def leak_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`find_leaks`: one narrow row per document."""
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        F.col("row").getField(key).alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns as they were."""
    return find_leaks(docs, benchmark, window, text).filter(F.size("words") == 0).select("row.*")

