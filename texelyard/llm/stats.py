"""Word, line and symbol statistics of whole texts."""

from __future__ import annotations

from collections import Counter

import numpy as np

from texelyard.llm.common import ASCII_SPACE, utf8

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SENTENCE = b".!?"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct", "n_stops", "n_chars")
NAMES = BASE + MORE


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of ``NAMES`` of one whole text; null has zero of each.

    Words are runs between ASCII white space. Lines count when they have a word;
    a repeated one counts from its second time on. A word counts as repeated when a
    window of three words that holds it is found twice or more in the text.
    """
    raw = utf8(text)
    found = raw.split()
    n_chars = len(text or "")
    lines = Counter(line for line in raw.split(b"\n") if line.strip(ASCII_SPACE))
    n_lines = sum(lines.values())
    distinct = dict(zip(dict.fromkeys(found), range(len(found))))
    return (
        len(found),
        n_chars - (len(raw) - len(raw.translate(None, ASCII_SPACE))),
        _count(raw, SYMBOLS),
        n_lines - len(lines),
        _repeat_words(found, distinct),
        n_lines,
        _count(raw, UPPER),
        _count(raw, DIGITS),
        _count(raw, b"!"),
        len(distinct),
        _count(raw, SENTENCE),
        n_chars,
    )


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def _repeat_words(found: list[bytes], numbers: dict[bytes, int]) -> int:
    n = len(found)
    if n < 4:
        return 0
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, n)
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, at, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.zeros(n, bool)
    start = np.flatnonzero(times[at] > 1)
    for k in range(3):
        twice[start + k] = True
    return int(twice.sum())
