"""Counts that describe the form of one text.

Words are ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` gives on UTF-8.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:"

#: What `count_text` returns, in order.
COUNTS = (
    "n_chars n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_same_next "
    "n_distinct n_upper n_digits n_marks n_stops n_pipes n_wide"
).split()

#: What `ratios` returns, in order.
RATIOS = (
    "word_length symbols dup_lines repeat_words same_next distinct upper digits marks stops pipes wide line_words"
).split()


def count_repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    starts = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(starts)] |= starts
    return int(covered.sum())


def count_text(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n_bytes, n_chars = len(raw), len(text)
    blanks = n_bytes - len(raw.translate(None, _BLANK))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        n_chars,
        len(words),
        n_chars - blanks,
        n_bytes - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        count_repeat_words(words),
        sum(map(eq, words, words[1:])),
        len(set(words)),
        n_bytes - len(raw.translate(None, _UPPER)),
        n_bytes - len(raw.translate(None, _DIGITS)),
        raw.count(b"!") + raw.count(b"?"),
        n_bytes - len(raw.translate(None, _STOPS)),
        words.count(b"|"),
        n_bytes - n_chars,
    )


def ratios(counts: np.ndarray) -> np.ndarray:
    """Counts (rows by `COUNTS`) as size-free figures (rows by `RATIOS`)."""
    c = dict(zip(COUNTS, counts.astype(float).T))
    chars, words, lines = (np.maximum(c[k], 1) for k in ("word_chars", "n_words", "n_lines"))
    return np.column_stack([
        c["word_chars"] / words,
        c["n_symbols"] / chars,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["n_same_next"] / words,
        # distinct words fall with the length of any text; the root makes up for most of it
        c["n_distinct"] / words**0.9,
        c["n_upper"] / chars,
        c["n_digits"] / chars,
        c["n_marks"] / words,
        c["n_stops"] / words,
        c["n_pipes"] / words,
        c["n_wide"] / chars,
        np.minimum(c["n_words"] / lines, 200) / 200,
    ])
