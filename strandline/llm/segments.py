"""Encoding by words that recur.

The split pattern of the byte-level tokenizers here begins a match at every
space between two characters that are no white space, so the words of a text
between single spaces are encoded apart from each other. A table keeps what
words encode to; the words of a group of texts are hashed and looked up as
arrays, and only new ones are encoded. Texts with other white space before a
space, or a space at the end, are encoded whole.

A word is known by a 64-bit hash, its length and its first eight bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandline.llm.textkit import spans_and_hashes

#: Words that a table holds before it starts anew, some 40 bytes each.
LIMIT = 700_000
#: Words added before they are merged into the sorted table.
_RECENT = 100_000
#: Longer texts are encoded whole, to bound the arrays of a group.
_LONGEST = 4 << 20
_SPACE = 0x20
_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: White space beyond ASCII (fixed values): leading bytes and the last ones.
_WIDE = {(0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
_LAST = {lead: np.isin(np.arange(256), last) for lead, last in _WIDE.items()}
_ANY_LAST = np.logical_or.reduce(list(_LAST.values()))


def after_white_space(raw: np.ndarray, at: np.ndarray) -> bool:
    """Whether white space stands before any of these places (none is 0)."""
    one = raw[at - 1]
    if _ASCII[one].any():
        return True
    far = np.flatnonzero(_ANY_LAST[one])
    if not len(far):
        return False
    x, y, z = one[far], raw[at[far] - 2], raw[np.maximum(at[far] - 3, 0)]
    return any((last[x] & (y == lead[-1]) & ((z == lead[0]) if len(lead) == 2 else True)).any() for lead, last in _LAST.items())


class _Words:
    """Sorted keys with the slots of their ids."""

    def __init__(self) -> None:
        self.keys, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 where missing."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]


class SegmentTable:
    """``encode`` over ``encode_many``, which gives the bytes of ids of whole
    strings, and ``encode_words``, which does so for words after a space."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]], kind: np.dtype, limit: int = LIMIT) -> None:
        self.encode_many, self.encode_words, self.kind, self.limit = encode_many, encode_words, np.dtype(kind), limit
        self._clear()

    def _clear(self) -> None:
        self.main, self.recent = _Words(), _Words()
        self.count = 0
        self.marks = np.zeros(1024, dtype=np.uint64)
        self.ends = np.zeros(1024, dtype=np.int64)  # of the ids of each slot in the pool
        self.pool = np.zeros(4096, dtype=self.kind)

    def _add(self, keys: np.ndarray, marks: np.ndarray, words: list[str]) -> None:
        ids = self.encode_words(words)
        sizes = np.array([len(x) for x in ids]) // self.kind.itemsize
        start = int(self.ends[self.count - 1]) if self.count else 0
        slots = np.arange(self.count, self.count + len(words))
        while len(self.marks) < self.count + len(words):
            self.marks, self.ends = np.concatenate([self.marks, np.zeros_like(self.marks)]), np.concatenate([self.ends, np.zeros_like(self.ends)])
        stop = start + int(sizes.sum())
        while len(self.pool) < stop:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[start:stop] = np.frombuffer(b"".join(ids), dtype=self.kind)
        self.marks[slots], self.ends[slots] = marks, start + np.cumsum(sizes)
        self.count += len(words)
        self.recent.add(keys, slots)
        if len(self.recent.keys) > _RECENT:
            self.main.add(self.recent.keys, self.recent.slots)
            self.recent = _Words()

    def _slots(self, data: bytes, words: int) -> np.ndarray | None:
        """Slot of each word of ``data``; None if hashes do not tell its words."""
        raw = np.frombuffer(data, dtype=np.uint8)
        start, end, hashes = spans_and_hashes(raw, raw == _SPACE)
        if len(start) != words:
            return None
        padded = np.concatenate([raw, np.full(8, _SPACE, dtype=np.uint8)])
        mark = (end - start).astype(np.uint64)
        for k in range(8):
            byte = padded[start + k]
            mark = mark * np.uint64(257) + np.where(start + k < end, byte, 0)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if (mark != mark[first][inverse]).any():
            return None
        slots = self.main.find(keys)
        missing = slots < 0
        slots[missing] = self.recent.find(keys[missing])
        known = slots >= 0
        if (self.marks[slots[known]] != mark[first][known]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            at = first[new]
            begin = self.count
            self._add(keys[new], mark[at], [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())])
            slots[new] = np.arange(begin, self.count)
        return slots[inverse]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Bytes of ids of each text."""
        if self.count > self.limit:
            self._clear()
        out: list[bytes | None] = [None] * len(texts)
        whole, rests, who, counts = {}, [], [], []
        for k, data in enumerate(texts):
            head, space, rest = data.partition(b" ")
            if not space:
                whole[data] = None
                continue
            raw = np.frombuffer(data, dtype=np.uint8)
            at = np.flatnonzero(raw == _SPACE)
            if not at[0] or at[-1] == len(raw) - 1 or len(raw) > _LONGEST or after_white_space(raw, at):
                whole[data] = None
                continue
            whole[head] = None
            rests.append(rest)
            who.append(k)
            counts.append(len(at))
        slots = self._slots(b" ".join(rests), sum(counts)) if rests else None
        if rests and slots is None:  # two words of one hash: without the table
            whole.update((texts[k], None) for k in who)
        strings = dict(zip(whole, self.encode_many([s.decode() for s in whole])))
        if slots is not None:
            stop = self.ends[slots]
            begin = np.where(slots > 0, self.ends[np.maximum(slots - 1, 0)], 0)
            sizes = stop - begin
            upto = np.cumsum(sizes)
            ids = self.pool[np.arange(int(upto[-1])) + np.repeat(begin - (upto - sizes), sizes)].tobytes()
            cuts = [0, *(upto[np.cumsum(counts) - 1] * self.kind.itemsize).tolist()]
            for k, a, b in zip(who, cuts, cuts[1:]):
                out[k] = strings[texts[k].partition(b" ")[0]] + ids[a:b]
        return [strings[data] if ids is None else ids for data, ids in zip(texts, out)]
