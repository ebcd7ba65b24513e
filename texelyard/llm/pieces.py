"""SentencePiece ids of whole texts, and the texts back from ids.

For vocabularies of merge type. A sequence of pieces is what merging gives if and only if
merging each two neighbours alone gives those two again: a merge across a border would have
shown there as well. So a text is encoded from left to right: an Aho-Corasick automaton names the
longest piece that begins at each place; a piece is taken if it is compatible with the one before it;
if not, the next shorter piece that begins it is tried, and if none is left the place is marked in a bit
field as one where no encoding goes on, and the piece before it is given up. No place fails twice, so
the work grows with the length of the text.

Texts are cut before spaces that no piece can reach over, and the distinct parts of a slice are encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.llm.common import free_name, map_text, quoted
from texelyard.llm.tokens import library_path

SPACE = "▁"  # fixed by the library: how pieces spell a space
UNKNOWN_TEXT = " ⁇ "  # fixed by the library: what the unknown id decodes to
MEMO_ENTRIES = 500_000
PAIR_ENTRIES = 400_000
SLICE_BYTES = 4 << 20


class PieceTexts:
    """What each id of one .model file decodes to."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.kept = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        _check(library, self.kept)
        self.name = [library.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.name[i][3:-1], 16): i for i in range(size) if library.is_byte(i)}
        of_byte = {i: b for b, i in self.byte_id.items()}
        # Bytes of all pieces one after another, spaces as spaces.
        texts = [
            b"" if library.is_control(i)
            else bytes([of_byte[i]]) if i in of_byte
            else UNKNOWN_TEXT.encode() if library.is_unknown(i)
            else n.replace(SPACE, " ").encode()
            for i, n in enumerate(self.name)
        ]
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: pieces joined, the space in front taken off, each byte that is no character replaced."""
        size = (self.text_at[1:] - self.text_at[:-1])[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.texts[np.repeat(self.text_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        # Control ids have no text, but bytes on both sides of one are no character together.
        marks = [0, *(upto[:-1][size == 0].tolist()), len(raw)]
        text = b"".join(_valid(raw[a:b]) for a, b in zip(marks, marks[1:]) if a < b)
        seen = np.flatnonzero(size)
        return text[1:] if len(seen) and self.name[ids[seen[0]]].startswith(SPACE) else text


class PieceVocabulary(PieceTexts):
    """Pieces, scores and the automaton of one .model file of merge type with byte fallback."""

    def __init__(self, path: str, memo: int = MEMO_ENTRIES, pairs: int = PAIR_ENTRIES) -> None:
        import ahocorasick

        super().__init__(path)
        self.id_of = {self.name[i]: i for i in self.kept}
        self.score = {self.name[i]: self.library.get_score(i) for i in self.kept}
        self.memo_entries, self.pair_entries = memo, pairs
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # A piece that merging its own characters does not give can be in no encoding.
        whole = [i for i in self.kept if self.merge(self.name[i]) == [self.name[i]]]
        reached = set(whole)
        self.length = [len(n) for n in self.name]
        self.shorter = [-1] * len(self.name)
        self.automaton = ahocorasick.Automaton()
        for i in whole:
            name = self.name[i]
            self.automaton.add_word(name, i)
            starts = (self.id_of.get(name[:n], -1) for n in range(len(name) - 1, 0, -1))
            self.shorter[i] = next((k for k in starts if k in reached), -1)
        self.automaton.make_automaton()
        self.cuts_at_space = not any(SPACE in self.name[i].lstrip(SPACE) for i in self.kept)

    def merge(self, text: str) -> list[str]:
        """Merge a short text pair by pair: the best score first, of equal ones the leftmost."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            found = [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces gives these two."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.name[left], self.name[right]
            found = self.merge(a + b) == [a, b]
            if len(self.pairs) < self.pair_entries:
                self.pairs[key] = found
        return found

    def encode_part(self, part: str) -> list[int]:
        """Ids of a run of characters, spaces already spelt as pieces spell them."""
        longest = [-1] * len(part)
        length = self.length
        for end, piece in self.automaton.iter(part):
            longest[end + 1 - length[piece]] = piece  # later ends come later, so the longest stays
        out: list[int] = []
        at = 0
        for k in [k for k, piece in enumerate(longest) if piece < 0 and part[k] not in self.id_of]:
            # No piece holds this character: nothing merges over it, and its bytes stand for it.
            out += self._backtrack(longest, at, k)
            out += map(self.byte_id.__getitem__, part[k].encode())
            at = k + 1
        return out + self._backtrack(longest, at, len(part))

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        length, shorter, compatible = self.length, self.shorter, self.compatible
        failed = bytearray((stop - start >> 3) + 1)
        taken: list[int] = []
        at = start
        while at < stop:
            piece = longest[at]
            while True:
                last = taken[-1] if taken else -1
                while piece >= 0:
                    end = at + length[piece] - start
                    if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or compatible(last, piece)):
                        break
                    piece = shorter[piece]
                if piece >= 0:
                    taken.append(piece)
                    at += length[piece]
                    break
                if last < 0:
                    raise ValueError("no encoding: a character of a piece is no piece itself")
                failed[at - start >> 3] |= 1 << (at - start & 7)
                at -= length[last]
                piece = shorter[taken.pop()]
        return taken

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a text column (null: empty): first row, ids, and n + 1 bounds of each text in them."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield (at, *self._slice(texts.slice(at, stop - at)))
            pa.default_memory_pool().release_unused()
            at = stop

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # A text that is not empty gets a space in front; its own characters like the pieces' space are spaces.
        filled = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", pc.replace_substring(texts, SPACE, " "), ""))
        ends = np.frombuffer(filled.buffers()[1], np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
        raw = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        begins = np.zeros(len(raw), bool)
        if self.cuts_at_space:
            begins = raw == 0x20
            begins[1:] &= raw[:-1] != 0x20
        begins[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.concatenate([starts, [len(raw)]]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        stored = self._parts(pc.replace_substring(coded.dictionary, " ", SPACE).to_pylist())
        index = coded.indices.to_numpy().astype(np.int64)
        size = np.array([len(s) // 4 for s in stored], np.int64)
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(stored), np.uint32)
        length = size[index]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat(begin[index] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, ends)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.memo.get, parts))
        fresh = {}
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = fresh[parts[k]] = np.array(self.encode_part(parts[k]), np.uint32).tobytes()
        short = ((p, ids) for p, ids in fresh.items() if len(p) <= 64)
        self.memo.update(islice(short, max(0, self.memo_entries - len(self.memo))))
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of one whole text."""
        return self._slice(pa.array([text or ""], pa.string()))[0].tolist()


def _valid(raw: bytes) -> bytes:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "\ufffd", raw.decode("utf-8", "surrogateescape")).encode()
    return raw


def _check(library, kept: list[int]) -> None:
    """Refuse models whose texts this encoder would not treat as the library does."""
    probe = "a  b\tc é́ﬁ　x "
    if library.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("only models that leave texts as they are, but for a space in front, are supported")
    if any(library.is_unused(i) for i in kept) or not library.is_byte(library.piece_to_id("<0x41>")):
        raise ValueError("only models without unused pieces and with byte fallback are supported")


_loaded: dict[tuple[type, str], PieceTexts] = {}


def _public(kind: type, name: str):
    """This process's ``kind`` of the public file ``name``."""
    if (kind, name) not in _loaded:
        _loaded[kind, name] = kind(library_path(name))
    return _loaded[kind, name]


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids`` of every row of ``docs``: ids as little-endian uint32, the end id last.

    The ids are the library's for the whole text, without sampling; a null text is empty and has the end id
    alone. Rows are handled one by one, whether keys are null or repeated; other columns are not read. A task
    holds one Arrow batch, the ids of a slice of it and bounded tables of parts and pairs; no shuffle.
    """
    rows = docs.select(quoted(key).alias(key), quoted(text).alias("text"))
    names = [key, *(free_name(n, [key]) for n in ("n_tokens", "ids"))]
    schema = rows.select(quoted(key).alias(key), F.lit(0).cast("long").alias(names[1]), F.lit(b"").alias(names[2])).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _public(PieceVocabulary, model)
        for batch in batches:
            for first, ids, bounds in vocabulary.column(batch.column(1)):
                n = len(bounds) - 1
                if end_id is not None:
                    ids, bounds = np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
                ends = pa.py_buffer((4 * bounds).astype(np.int32))
                column = pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(bounds)), column], names)

    return map_text(rows, run, schema)


def decode_pieces(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as a last column, as the library decodes them; null ids give null.

    Control ids give nothing, bytes that are no UTF-8 a replacement character each. An added column
    whose name is taken gets a trailing underscore.
    """
    name = free_name(name, encoded.columns)
    schema = encoded.withColumn(name, F.lit("")).schema
    for field in schema:
        field.nullable = True
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _public(PieceTexts, model)
        for batch in batches:
            held = (None if c is None else vocabulary.decode(np.frombuffer(c, "<u4")) for c in batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.binary()).cast(pa.string())], list(schema.names))

    return map_text(encoded, run, schema)


def piece_digest(encoded: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id") -> DataFrame:
    """Digests of :func:`encode_pieces`, row by row: of the decimal ids joined by a space, and of the text decoded from the ids."""
    rows = encoded.select(quoted(key).alias(key), "n_tokens", "ids")
    schema = rows.select(quoted(key).alias(key), "n_tokens", F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _public(PieceTexts, model)
        for batch in batches:
            told, texts = [], []
            for cell in batch.column(2):
                ids = np.frombuffer(cell.as_buffer(), "<u4")
                told.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
                texts.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string()), pa.array(texts, pa.string())], list(schema.names))

    return map_text(rows, run, schema)
