"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and written in another order.

The cuts are given in units (code points, words or lines). A Fenwick tree over blocks of
a fixed number of bytes holds how many units and code points begin in each block. A
binary-lifting descent finds the block in which the wanted unit begins and adds up the
code points before it; the byte itself is then looked for in that block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.llm.common import ASCII_SPACE, map_text, quoted

BLOCK = 1 << 12
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("code_point", "word", "line")
_SPACE = np.isin(np.arange(256), list(ASCII_SPACE))


class BlockTree:
    """Fenwick tree over the blocks of one UTF-8 text; a node holds units and code points of its blocks."""

    def __init__(self, raw: np.ndarray, unit: str = "code_point", block: int = BLOCK) -> None:
        self.raw, self.unit, self.block = raw, unit, block
        self.blocks = -(-len(raw) // block)
        sums = np.zeros((self.blocks + 1, 2), np.int64)
        if self.blocks:
            at = np.arange(0, len(raw), block)
            for column, starts in enumerate((self._units(0, len(raw)), _code_points(raw))):
                sums[1:, column] = np.cumsum(np.add.reduceat(starts, at, dtype=np.int64))
        self.units, self.code_points = sums[-1].tolist()
        node = np.arange(self.blocks + 1)
        # A node covers as many blocks as its lowest set bit says.
        self.tree = (sums - sums[node & (node - 1)]).tolist()

    def _units(self, start: int, stop: int) -> np.ndarray:
        """Where units begin from byte ``start`` up to ``stop``; a text's first byte begins one."""
        part = self.raw[start:stop]
        if self.unit == "code_point":
            return _code_points(part)
        before = np.concatenate([self.raw[max(start - 1, 0) : start], part])
        if self.unit == "line":
            begins = before[:-1] == 10
        else:
            begins = _SPACE[before[:-1]] & ~_SPACE[before[1:]]
        return begins if start else np.concatenate([[True], begins])

    def cut(self, units: int) -> tuple[int, int]:
        """Byte at which the first ``units`` units end, and the code points up to there."""
        if units >= self.units:
            return len(self.raw), self.code_points
        node = left = chars = 0
        left = units
        for step in (1 << k for k in range(self.blocks.bit_length() - 1, -1, -1)):
            if node + step <= self.blocks and self.tree[node + step][0] <= left:
                node += step
                left -= self.tree[node][0]
                chars += self.tree[node][1]
        start = node * self.block
        spot = int(np.flatnonzero(self._units(start, start + self.block))[left])
        return start + spot, chars + int(np.count_nonzero(_code_points(self.raw[start : start + spot])))


def _code_points(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """A sentinel must be found again whatever text stands around it: its first character is in no other place of any."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError(f"sentinels could overlap with text around them: {sentinels}")
    if any(a.startswith(b) for a in sentinels for b in sentinels if a != b):
        raise ValueError(f"a sentinel begins with another: {sentinels}")


def dice(key: Column, seed: int) -> Column:
    """Four whole numbers of 32 bits from sha256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(
    docs: DataFrame, seed: int = 1, key: str = "doc_id", text: str = "text", unit: str = "code_point",
    plain_percent: int = 10, suffix_first_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK,
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``; no other column is read.

    ``n`` counts the text's units: code points, words (with the ASCII white space after
    them) or lines (with their line feed). A digest of seed and key draws two cuts, the form and the order:
    ``plain`` is the text itself, ``psm`` prefix, suffix, middle and ``spm`` suffix, prefix, middle, each
    part after its own sentinel of ``sentinels`` (for prefix, suffix, middle). A text that is empty, null (as
    empty) or holds a sentinel is plain; its counts of code points are null. Cuts lie between
    units, so parts may be empty. Rows are handled one by one: keys may be null (as the empty key) or repeated. A task
    holds one Arrow batch; a single text is held whole, about four times over.
    """
    check_sentinels(sentinels)
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    rows = docs.select(quoted(key).alias(key), dice(quoted(key), seed).alias("dice"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    schema = rows.select(
        quoted(key), F.lit(0).cast("long").alias("n"), F.lit("").alias("form"), F.lit(0).cast("long").alias("prefix_chars"),
        F.lit(0).cast("long").alias("middle_chars"), F.lit("").alias("output"),
    ).schema
    for field in schema:
        field.nullable = True
    return map_text(rows, _transform(unit, plain_percent, suffix_first_percent, sentinels, block, list(schema.names)), schema)


def _transform(unit: str, plain_percent: int, suffix_first_percent: int, sentinels: tuple[str, str, str], block: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [s.encode() for s in sentinels]
        for batch in batches:
            drawn = batch.column(1).values.to_numpy().reshape(-1, 4).tolist() if batch.num_rows else []
            rows = []
            for cell, (h1, h2, h3, h4) in zip(batch.column(2), drawn):
                raw = cell.as_buffer().to_pybytes()
                tree = BlockTree(np.frombuffer(raw, np.uint8), unit, block)
                n = tree.units
                if not raw or h3 % 100 >= 100 - plain_percent or any(m in raw for m in marks):
                    rows.append((n, "plain", None, None, raw))
                    continue
                (a, before), (b, upto) = (tree.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
                if h4 % 100 < suffix_first_percent:
                    form, parts = "spm", (marks[1], suffix, marks[0], prefix, marks[2], middle)
                else:
                    form, parts = "psm", (marks[0], prefix, marks[1], suffix, marks[2], middle)
                rows.append((n, form, before, upto - before, b"".join(parts)))
            n, form, before, middle, output = zip(*rows) if rows else ((),) * 5
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(before, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text from an output and its form."""
    prefix, suffix, middle = sentinels

    def after(part: Column, mark: str) -> Column:
        return F.substring_index(part, mark, -1)

    def upto(part: Column, mark: str) -> Column:
        return F.substring_index(part, mark, 1)

    psm = F.concat(upto(after(output, prefix), suffix), after(output, middle), upto(after(output, suffix), middle))
    spm = F.concat(upto(after(output, prefix), middle), after(output, middle), upto(after(output, suffix), prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_digest(found: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them, in place of the outputs."""
    output = F.col("output")
    return found.select(
        *[quoted(c) for c in found.columns if c != "output"],
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, F.col("form"), sentinels), 256).alias("restored_sha256"),
    )
