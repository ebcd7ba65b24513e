"""Secrets in text: fixed patterns, and assignments read as source or configuration syntax.

Three patterns give the base spans. The lexer then goes from one ``=`` or ``:`` to
the next, reads the name before it and the value after it (quoted strings, bare
words, references to names assigned earlier, and ``+`` chains of these), carries
constants forward, and scores the literals that reach a name that sounds secret. A
literal is a finding even when its own name is harmless, if a sensitive name is
assigned from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.llm.common import TO_LOWER, map_text, quoted, utf8, with_row

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

ASSIGN_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
IS_HEX = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))

# Words of a name that sound secret, and pairs that do so together.
SENSITIVE = frozenset(
    "password passwd passphrase passcode pwd pass secret secrets token tokens apikey credential credentials authorization bearer".split()
)
SENSITIVE_PAIRS = frozenset(
    {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"),
     ("auth", "key"), ("client", "key"), ("account", "key"), ("shared", "key"), ("license", "key")}
)
NAME_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"authorization", b"bearer")
PLACEHOLDERS = frozenset(
    "changeme change_me example placeholder none null nil true false undefined redacted string str text password secret token required optional".split()
)
LITERAL_LEAST, SCORE_LEAST = 8, 3
HEAD_CHARS = 24  # of a value, for the words and beginnings that make it a placeholder
# Counts are scaled down beyond, as constants that refer to themselves double at every line.
COUNTS_MOST = 2.0**60
# Classes whose counts give a value's entropy: each printable ASCII character, the other ones of ASCII, and bytes from 0x80 by five bits.
CLASS = np.array([b - 0x20 if 0x20 <= b < 0x7F else 95 if b < 0x80 else 96 + (b & 31) for b in range(256)])

OPERATOR = re.compile(r":=|=>|==|!=|<=|>=|=|:")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
TYPE = re.compile(r"\x20*[A-Za-z_][A-Za-z0-9_.\[\]<>]*\x20*=(?![=>])")
STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|' + r"'((?:[^'\\\n]|\\.)*)'")
BARE = re.compile(r"""[^\s"'`#;,(){}\[\]<>|+]+(?:\+[^\s"'`#;,(){}\[\]<>|+]+)*""")
# A constant by reference, as shells, .env and compose files write it.
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
BARE_REFERENCES = re.compile(rf"""(?:{REFERENCE.pattern}|[^\s"'`#;,(){{}}\[\]<>|+])+""")
SCHEME = re.compile(r"(?:[Bb]earer|[Bb]asic)\x20+")
PLUS = re.compile(r"\x20*\+\x20*")
# Names and values inside an address, where ``&`` and the like end a value.
IN_ADDRESS = re.compile(r"""([A-Za-z0-9_.-]+)[=:]([^\s"'`#;,(){}\[\]<>|+&=:/@?]+)""")
NAME = re.compile(r"\$?[A-Za-z_][A-Za-z0-9_.-]*")
NAME_MOST = 256
BEGINNINGS = ("your", "<", "${", "{{", "%(", "http://", "https://", "xxx", "***")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int  # where the secret itself begins


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns that are long enough, left to right per kind."""
    raw = utf8(text)
    low = raw.translate(TO_LOWER)
    found: list[Span] = []
    if any(s in low for s in ASSIGN_STEMS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(Span("assign", m.start(), m.end(), m.start(2)))
    if "AKIA" in text:
        found += [Span("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(IS_HEX):
        found += [Span("hex", *m.span(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


class Value:
    """What a name is assigned: a literal's span, or values one after another; no text is ever joined.

    Constants share their parts, so a document's values take memory in proportion to the
    document, however often constants are used in one another.
    """

    __slots__ = ("span", "parts", "stats", "told")

    def __init__(self, span: tuple[int, int] | None, parts: tuple[Value, ...] = ()) -> None:
        self.span, self.parts = span, parts
        self.stats: Stats | None = None
        self.told = False


class Stats(NamedTuple):
    """Of the literals of a value, white space at their ends left out; sums of those of its parts."""

    length: float
    counts: np.ndarray  # of the UTF-8 bytes of each ``CLASS``
    kinds: tuple[bool, bool, bool, bool, bool]  # lower, upper, digit, neither letter nor digit, letter
    head: str


NOTHING = Stats(0.0, np.zeros(128, np.float32), (False,) * 5, "")


def literal_stats(literal: str) -> Stats:
    plain = literal.strip()
    if not plain:
        return NOTHING
    counts = np.bincount(CLASS[np.frombuffer(plain.encode(), np.uint8)], minlength=128).astype(np.float32)
    chars = set(plain)
    tests = (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum(), str.isalpha)
    return Stats(float(len(plain)), counts, tuple(any(map(test, chars)) for test in tests), plain[:HEAD_CHARS])


def _added(parts: tuple[Value, ...]) -> Stats:
    length, counts, kinds, head = NOTHING
    counts = counts.copy()
    for part in parts:
        length += part.stats.length
        counts += part.stats.counts
        kinds = tuple(a or b for a, b in zip(kinds, part.stats.kinds))
        head = head if len(head) == HEAD_CHARS else (head + part.stats.head)[:HEAD_CHARS]
        if counts.max() > COUNTS_MOST:
            counts /= np.float32(COUNTS_MOST)
    return Stats(length, counts, kinds, head)


def value_stats(text: str, value: Value) -> Stats:
    """Statistics of a value; each value it is made of is looked at once in a document."""
    todo = [value]
    while todo:
        now = todo[-1]
        if now.stats is None and now.span is not None:
            now.stats = literal_stats(text[slice(*now.span)])
        missing = [p for p in now.parts if p.stats is None] if now.stats is None else []
        if missing:
            todo += missing
            continue
        if now.stats is None:
            now.stats = _added(now.parts)
        todo.pop()
    return value.stats


def new_literals(value: Value) -> Iterator[tuple[int, int]]:
    """Spans of the literals of a value that no value before has told."""
    todo = [value]
    while todo:
        now = todo.pop()
        if now.told:
            continue
        now.told = True
        if now.span is not None:
            yield now.span
        todo += now.parts


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """Name and value of each assignment, in the order of the text.

    A name run ends at the operator before it and a value is passed over once, so the scan is linear in the text.
    """
    constants: dict[str, Value] = {}
    done = floor = 0
    for m in OPERATOR.finditer(text):
        if m.group() in ("==", "!=", "<=", ">=") or m.start() < done:
            continue
        name = _name_before(text, m.start(), floor)
        if name is None:
            continue
        at = m.end()
        if m.group() == ":":
            annotated = TYPE.match(text, at)
            at = annotated.end() if annotated else at
        value, end, word = _value_after(text, at, constants)
        if value is None:
            continue
        constants[name] = value
        yield name, value
        if text.startswith("//", m.end()):
            for inner in IN_ADDRESS.finditer(text, m.end(), end):
                yield inner[1], Value(inner.span(2))
        # A single word may be a name that is assigned in turn.
        done, floor = max(done, end if not word else m.end()), (m.end() if word else end)


def _name_before(text: str, at: int, floor: int) -> str | None:
    end = at
    while end > floor and text[end - 1] == " ":
        end -= 1
    if end > floor and text[end - 1] in "\"'`]":
        end -= 1
        if end > floor and text[end - 1] in "\"'":
            end -= 1
    start = end
    while start > floor and text[start - 1] in NAME_CHARS:
        start -= 1
    return text[start:end] or None


def _value_after(text: str, at: int, constants: dict[str, Value]) -> tuple[Value | None, int, bool]:
    """A literal, a known name, or a chain of these joined by ``+``; where it ends, and whether it is one bare name."""
    while at < len(text) and text[at] in " \t":
        at += 1
    scheme = SCHEME.match(text, at)
    at = scheme.end() if scheme else at
    parts: list[Value] = []
    word = False
    while True:
        quoted_text = STRING.match(text, at)
        bare = None if quoted_text else BARE.match(text, at)
        braced = None if quoted_text else BARE_REFERENCES.match(text, at)
        if quoted_text:
            group = 1 if quoted_text.group(1) is not None else 2
            # Single quotes keep a reference as it is in shells, but not in compose files.
            parts.append(_referenced(text, *quoted_text.span(group), constants) or Value(quoted_text.span(group)))
            at = quoted_text.end()
        elif braced and (value := _referenced(text, *braced.span(), constants)):
            parts.append(value)
            at = braced.end()
        elif bare:
            # A name is short; a long run is a literal and no copy of it is looked up.
            short = bare.end() - bare.start() <= NAME_MOST
            known = constants.get(bare.group().removeprefix("$").rstrip(".")) if short else None
            parts.append(known or Value(bare.span()))
            word = len(parts) == 1 and short and NAME.fullmatch(text, *bare.span()) is not None
            at = bare.end()
        else:
            break
        joined = PLUS.match(text, at)
        if not joined:
            break
        word, at = False, joined.end()
    if not parts:
        return None, at, False
    return (parts[0] if len(parts) == 1 else Value(None, tuple(parts))), at, word and len(parts) == 1


def _referenced(text: str, start: int, end: int, constants: dict[str, Value]) -> Value | None:
    """A stretch of text with its references to known constants as parts; null if it has none."""
    parts: list[Value] = []
    done, resolved = start, False
    for m in REFERENCE.finditer(text, start, end):
        known = constants.get(m[1] or m[2])
        if known is None:
            continue
        if m.start() > done:
            parts.append(Value((done, m.start())))
        parts.append(known)
        done, resolved = m.end(), True
    if not resolved:
        return None
    if end > done:
        parts.append(Value((done, end)))
    return parts[0] if len(parts) == 1 else Value(None, tuple(parts))


def is_sensitive(name: str) -> bool:
    parts = [p.lower() for p in PART.findall(name)]
    return not SENSITIVE.isdisjoint(parts) or any(p in SENSITIVE_PAIRS for p in zip(parts, parts[1:]))


def value_score(stats: Stats) -> int:
    """Points for a value that looks generated; placeholders and templates get none."""
    low = stats.head.lower()
    if stats.length < LITERAL_LEAST or (stats.length <= HEAD_CHARS and low in PLACEHOLDERS) or low.startswith(BEGINNINGS):
        return 0
    share = stats.counts[stats.counts > 0] / stats.counts.sum()
    bits = float(-(share * np.log2(share)).sum())
    lower, upper, digit, other, letter = stats.kinds
    spaced = stats.counts[0] > 0
    return (bits >= 2.5 - 1e-6) + (bits >= 3.5 - 1e-6) + (lower + upper + digit + other >= 2) + (digit and letter) + (stats.length >= 16) - 2 * spaced


def find_spans(text: str | None) -> list[Span]:
    """All spans of one text, by start and then by kind as listed in ``KINDS``.

    The base spans are all there; a literal found by the lexer is added unless a
    base span covers it.
    """
    if not text:
        return []
    found = base_spans(text)
    low = utf8(text).translate(TO_LOWER)
    if (b"=" in low or b":" in low) and any(s in low for s in NAME_STEMS):
        lexed = {
            span
            for name, value in assignments(text)
            if is_sensitive(name) and value_score(value_stats(text, value)) >= SCORE_LEAST
            for span in new_literals(value)
            if span[1] > span[0]
        }
        # Spans of one kind do not overlap: of the base spans up to here, the one that reaches furthest decides.
        base = sorted((s.start, s.end) for s in found)
        reach, k = 0, 0
        for start, end in sorted(lexed):
            while k < len(base) and base[k][0] <= start:
                reach, k = max(reach, base[k][1]), k + 1
            if end > reach:
                found.append(Span("lexed", start, end, start))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with each secret itself replaced, names kept; overlapping ones once."""
    out: list[str] = []
    done = 0
    for start, end in _merged(sorted((s.value, s.end) for s in spans)):
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, end in runs:
        if joined and start < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


# -- tables --------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:long,end:long,value:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))


def scan_secrets(docs: DataFrame, text: str = "text", mark: str | None = "[REDACTED]") -> DataFrame:
    """Every document with its secrets: ``row`` (all columns of ``docs``), ``spans`` and ``clean``.

    Offsets are code points of the text, end exclusive. ``clean`` is the text with
    the secrets replaced by ``mark`` (null where nothing was found, and if ``mark``
    is null). A null or empty text has no spans. No shuffle; a task holds one Arrow
    batch of texts.
    """
    given = F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    rows = docs.select(given, quoted(text).alias("text"))
    return map_text(rows, _scan(mark), with_row(rows, f"spans {SPANS}, clean string"))


def _scan(mark: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for value in batch.column(1):
                text = value.as_py()
                found = find_spans(text)
                spans.append([s._asdict() for s in found])
                clean.append(redacted(text, found, mark) if found and mark is not None else None)
            columns = [batch.column(0), pa.array(spans, SPAN_TYPE), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "spans", "clean"])

    return run


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`scan_secrets`: one narrow row per document."""
    spans = F.col("spans")
    counts = [_of_kind(spans, kind).alias(f"n_{kind}") for kind in KINDS]
    base = _told(F.filter(spans, lambda s: s["kind"] != "lexed"))
    return found.select(
        F.col("row").getField(key).alias(key), *counts[:3], F.sha2(base, 256).alias("base_sha256"), _told(spans).alias("spans"), counts[3]
    )


def without_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with secrets replaced in ``text``, and ``length`` counted anew where that changed it."""
    found = scan_secrets(docs.select(*[quoted(c) for c in docs.columns]), text)
    new = F.col("clean")
    changed = {text: F.coalesce(new, F.col("row").getField(text))}
    if length in docs.columns:
        kind = docs.schema[length].dataType
        changed[length] = F.when(new.isNotNull(), F.length(new).cast(kind)).otherwise(F.col("row").getField(length))
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
