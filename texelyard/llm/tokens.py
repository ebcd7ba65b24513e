"""Token ids of whole texts with the tokenizers library, bounded in memory.

Byte-level vocabularies that split with their built-in pattern never join a
character that is no white space with the space after it. Cutting a text before
such a space therefore leaves its ids as they are, so each distinct piece of a
batch is encoded once by the library and frequent ones are remembered in a table
of bounded size. Other vocabularies, and texts in which a space follows white
space, are encoded whole.
"""

from __future__ import annotations

import json
import operator
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_ENTRIES = 800_000
PIECES_AT_ONCE = 250
SLICE_BYTES = 8 << 20
HEADS_IN = 8  # of so many remembered pieces one may be without a space before it
# Letters of any Unicode version and what follows them, which begins with none: the built-in pattern cuts there.
WORD_AND_REST = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F].*)", re.DOTALL)
# Fixed by byte-level vocabularies: how they spell the byte 0x20.
SPACE_BYTE = "Ġ"


def library_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class JsonEncoder:
    """Ids of texts by one .json vocabulary; one per Python worker.

    ``entries`` bounds the remembered pieces, about 200 bytes each.
    """

    def __init__(self, path: str, entries: int | None = None) -> None:
        self.entries = MEMO_ENTRIES if entries is None else entries
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as source:
            self.splits_at_space = _splits_at_space(json.load(source))
        if self.splits_at_space:
            strings = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size(with_added_tokens=True)))
            self.opens = np.array([(s or "").startswith(SPACE_BYTE) for s in strings])
        self.memo: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text as uint32, straight from the library."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def column(self, texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a text column (null: empty): first row, ids, and n + 1 bounds of each text in them."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + slice_bytes, "right")))
            part = texts.slice(at, stop - at)
            yield (at, *(self._by_pieces(part) if self.splits_at_space else self._whole(part)))
            pa.default_memory_pool().release_unused()  # else a worker keeps the pieces' buffers
            at = stop

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _joined([self.encode(t.as_py()) for t in texts])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values)
        index = coded.indices.to_numpy().astype(np.int32)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = bounds[:-1]

        # A text's first piece has no space before it and is looked up by itself.
        head, head_of = np.unique(index[first], return_inverse=True)
        tails, missing, ends_bare = self._tails(pieces)
        stored = [*tails, *self._heads([pieces[k] for k in head.tolist()])]
        ragged = np.zeros(len(pieces), bool)  # only new pieces can be: these are never remembered
        ragged[missing] = ends_bare
        loose = ragged[index]
        loose[first] &= np.diff(bounds) > 1
        loose[first] &= np.array([bool(pieces[k]) for k in head.tolist()], bool)[head_of]
        loose[bounds[1:] - 1] = False  # nothing follows a text's last piece
        index[first] = len(pieces) + head_of

        size = np.fromiter(map(len, stored), np.int32, len(stored)) // 4
        begin = np.cumsum(size, dtype=np.int32) - size
        flat = np.frombuffer(b"".join(stored), np.uint32)
        length = size[index]
        ends = np.cumsum(length, dtype=np.int32)  # a slice is 8 MB or one text, below 2 GB
        spot = np.repeat(begin[index] - (ends - length), length)
        spot += np.arange(len(spot), dtype=np.int32)
        ids = flat[spot]
        ends = np.concatenate([np.zeros(1, np.int64), ends])[bounds]
        runs = np.flatnonzero(np.logical_or.reduceat(loose, first))
        if not len(runs):
            return ids, ends
        parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in runs.tolist():
            parts[k] = self.encode(texts[k].as_py())
        return _joined(parts)

    def _tails(self, pieces: list[str]) -> tuple[list[bytes], list[int], np.ndarray]:
        """Ids of each distinct piece with the space before it, which pieces were not remembered, and which of those are ragged."""
        found = list(map(self.memo.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = [pieces[k] for k in missing]
        coded = self._encoded(new)
        for k, ids in zip(missing, coded):
            found[k] = ids
        ragged = _ragged(new)
        room = max(0, self.entries - len(self.memo))
        if room < len(new) or ragged.any():
            clean = np.flatnonzero(~ragged)[:room].tolist()
            self.memo.update((new[k], coded[k]) for k in clean)
        else:
            self.memo.update(zip(new, coded))
        return found, missing, ragged

    def _encoded(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that are not remembered. Where one is a word and something else, both are looked up first."""
        cuts = list(map(WORD_AND_REST.fullmatch, new))
        words = [p if c is None else c[1] for p, c in zip(new, cuts)]
        own = [self.memo.get(w) for w in words]
        asked = list(dict.fromkeys(w for w, ids in zip(words, own) if ids is None))
        fresh = dict(zip(asked, self._many(asked)))
        own = [fresh[w] if ids is None else ids for w, ids in zip(words, own)]
        rests = [k for k, c in enumerate(cuts) if c is not None]
        each = list(dict.fromkeys(cuts[k][2] for k in rests))
        after = dict(zip(each, self._heads(each)))
        for k in rests:
            own[k] += after[cuts[k][2]]
        return own

    def _many(self, new: list[str]) -> list[bytes]:
        """Ids of pieces with the space before them, many at a call of the library; an id that begins with a space opens a piece."""
        coded: list[bytes] = []
        for at in range(0, len(new), PIECES_AT_ONCE):
            part = new[at : at + PIECES_AT_ONCE]
            ids = self.encode(" " + " ".join(part))
            cuts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            flat = ids.tobytes()
            if len(cuts) == len(part) and "" not in part:
                coded += [flat[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)])]
            else:
                coded += [self.encode(" " + p).tobytes() for p in part]
        return coded

    def _heads(self, pieces: list[str]) -> list[bytes]:
        missing = [p for p in pieces if p not in self.heads]
        coded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        fresh = {p: np.array(e.ids, np.uint32).tobytes() for p, e in zip(missing, coded)}
        found = [self.heads.get(p) or fresh.get(p, b"") for p in pieces]
        self.heads.update(islice(fresh.items(), max(0, self.entries // HEADS_IN - len(self.heads))))
        return found


def _splits_at_space(spec: dict) -> bool:
    before = spec.get("pre_tokenizer") or {}
    return (
        before.get("type") == "ByteLevel"
        and bool(before.get("use_regex"))
        and not before.get("add_prefix_space")
        and spec.get("normalizer") is None
        and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    )


def _ragged(pieces: list[str]) -> np.ndarray:
    """Whether a space after each piece would follow white space."""
    return np.fromiter(map(operator.or_, map(operator.not_, pieces), map(operator.ne, pieces, map(str.rstrip, pieces))), bool, len(pieces))


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return np.concatenate([np.zeros(0, np.uint32), *parts]), bounds


_encoders: dict[tuple[str, int | None], JsonEncoder] = {}


def public_encoder(name: str, entries: int | None = None) -> JsonEncoder:
    """This process's encoder for the public vocabulary ``name``."""
    if (name, entries) not in _encoders:
        _encoders[name, entries] = JsonEncoder(library_path(name), entries)
    return _encoders[name, entries]


def release_encoders() -> None:
    """Forget this process's encoders and the pieces they remember."""
    _encoders.clear()
