"""Vectorised word and shingle hashing shared by the text operators.

All hashes are 64-bit, depend on content alone and so agree between tasks,
executors and runs.
"""

from __future__ import annotations

import re

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_PIECE = 1 << 20

#: ASCII white space: the space and \x09 to \x0d.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix64 = _mix

_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_MULTIPLIER, n), _powers(pow(_MULTIPLIER, -1, 1 << 64), n)
        return self.up, self.down


_POWERS = _Powers()


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


SPACE_TABLE = separator_table(SPACES)


def _spans(separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.empty(len(separator) + 2, dtype=np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~separator
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes, separators: np.ndarray = SPACE_TABLE) -> np.ndarray:
    """One 64-bit hash for each maximal run of bytes that are no separators.

    A polynomial over per-byte random values, taken from prefix sums modulo
    2**64 and shifted back to the word's start, so a word hashes alike
    wherever it stands. Texts above a megabyte go in pieces cut at separators.
    """
    if len(data) > 2 * _PIECE:
        parts, at, stop = [], 0, re.compile(b"[" + re.escape(bytes(np.flatnonzero(separators).astype(np.uint8))) + b"]")
        while at < len(data):
            cut = stop.search(data, at + _PIECE)
            end = cut.end() if cut else len(data)
            parts.append(_word_hashes(data[at:end], separators))
            at = end
        return np.concatenate(parts)
    return _word_hashes(data, separators)


def _word_hashes(data: bytes, separators: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    return spans_and_hashes(raw, separators[raw])[2]


def spans_and_hashes(raw: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of bytes between separators."""
    start, end = _spans(separator)
    if not len(start):
        return start, end, np.empty(0, dtype=np.uint64)
    up, down = _POWERS.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return start, end, _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (none if fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_MULTIPLIER)
        out += words[k : k + n]
    return _mix(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        # the length keeps a short sequence apart from full shingles
        return window_hashes(words, len(words)) ^ np.uint64(0xA5A5A5A5 + len(words))
    return np.unique(window_hashes(words, width))


def covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n places covered by windows of ``width`` that start where hit."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, np.minimum(hit + width, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true places."""
    return _spans(~mask)
