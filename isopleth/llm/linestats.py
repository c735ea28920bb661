"""Counts of character kinds per line of a text, in whole-array steps."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Kinds of characters. Blank is ASCII white space but for the line feed, which is its own kind.
OTHER, BLANK, BREAK, LOWER, UPPER, DIGIT, PUNCT, SYMBOL, PIPE, SHOUT = range(10)
KINDS = 10
#: The symbols that the rules count.
SYMBOLS = "#*$%&|<>"


def _table() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        category = unicodedata.category(c)
        table[cp] = UPPER if category == "Lu" else DIGIT if category[0] == "N" else LOWER if category[0] == "L" else PUNCT if category[0] == "P" else OTHER
    for c in "\x20\x09\x0b\x0c\x0d":
        table[ord(c)] = BLANK
    table[10] = BREAK
    for c in SYMBOLS:
        table[ord(c)] = SYMBOL
    table[ord("|")], table[ord("!")] = PIPE, SHOUT
    return table


_TABLE = _table()


def line_stats(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of kinds per line, words per line, last kind but blanks per line); lines are split at line feeds alone."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    kinds = np.where(points >= len(_TABLE), LOWER, kinds).astype(np.intp) if len(points) and points.max() >= len(_TABLE) else kinds.astype(np.intp)
    breaks = kinds == BREAK
    line = np.cumsum(breaks) - breaks
    n = int(line[-1]) + 1 + int(breaks[-1]) if len(points) else 1
    counts = np.bincount(line * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    blank = (kinds == BLANK) | breaks
    start = ~blank
    start[1:] &= blank[:-1]
    words = np.bincount(line[start], minlength=n)
    solid = np.flatnonzero(~blank)
    last = np.zeros(n, np.intp)
    last[line[solid]] = kinds[solid]
    return counts, words, last


def repeated_lines(lines: list[str]) -> np.ndarray:
    """For each line whether it has a word and equals an earlier line."""
    seen, out = set(), np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if line in seen:
            out[i] = True
        elif line.strip("\x20\x09\x0b\x0c\x0d"):
            seen.add(line)
    return out


#: What each line is described by, each value from 0 to about 1.
FEATURES = ("bias", "symbols", "pipes", "shouts", "capitals", "digits", "punctuation", "other", "few_words", "log_words", "word_length", "repeated", "open_end", "first", "last")


def line_features(counts: np.ndarray, words: np.ndarray, last: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    n = len(words)
    solid = counts.sum(1) - counts[:, BLANK] - counts[:, BREAK]
    per = 1.0 / np.maximum(solid, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = 1
    x[:, 1] = np.minimum(1, 4 * counts[:, SYMBOL] * per)
    x[:, 2] = np.minimum(1, 8 * counts[:, PIPE] * per)
    x[:, 3] = np.minimum(1, 8 * counts[:, SHOUT] * per)
    x[:, 4] = np.maximum(0, counts[:, UPPER] / letters - 0.1)
    x[:, 5] = counts[:, DIGIT] * per
    x[:, 6] = np.minimum(1, 4 * counts[:, PUNCT] * per)
    x[:, 7] = counts[:, OTHER] * per
    x[:, 8] = words < 4
    x[:, 9] = np.minimum(1, np.log1p(words) / 5)
    x[:, 10] = np.minimum(2, solid / np.maximum(words, 1) / 12)
    x[:, 11] = repeated
    x[:, 12] = (last != PUNCT) & (last != SHOUT)
    x[0, 13] = x[-1, 14] = 1
    return x
