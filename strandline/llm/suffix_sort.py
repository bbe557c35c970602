"""Blockwise suffix sorting with a difference cover.

Suffixes are sorted one bucket at a time, by their first bytes. Those that
tie over a whole period of the cover are told apart by ranks computed before
for a sample of positions: for any two positions there is a shift below the
period that brings both into the sample. Memory is the sample's ranks and one
bucket, however long the ties are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A perfect difference set: its differences are all residues of the period.
PERIOD = 73
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)
#: Suffixes in a bucket.
BUCKET = 1 << 19
_WORDS = -(-PERIOD // 8)

_IN_COVER = np.zeros(PERIOD, dtype=bool)
_IN_COVER[list(COVER)] = True
#: Least shift that brings two residues into the cover.
SHIFT = np.empty((PERIOD, PERIOD), dtype=np.int64)
for _shift in range(PERIOD - 1, -1, -1):
    _there = np.roll(_IN_COVER, -_shift)
    SHIFT[np.outer(_there, _there)] = _shift


def words_at(text: np.ndarray, margin: int) -> np.ndarray:
    """The eight bytes from each place as a number, zeros past the end."""
    padded = np.concatenate([text, np.zeros(margin + 8, dtype=np.uint8)])
    out = np.zeros(len(text) + margin, dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def _refined(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of each group sorted by key; groups split where keys differ."""
    by = np.lexsort((key, group))
    order, group, key = order[by], group[by], key[by]
    new = np.empty(len(order), dtype=bool)
    new[:1] = True
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return order, np.cumsum(new) - 1


def _tied(group: np.ndarray) -> np.ndarray:
    return np.bincount(group)[group] > 1


def _by_words(places: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their first bytes, a whole period or more, and groups
    of those that tie."""
    order, group = _refined(places, np.zeros(len(places), dtype=np.int64), words[places])
    for k in range(1, _WORDS):
        tied = np.flatnonzero(_tied(group))
        if not len(tied):
            break
        sub, inner = _refined(order[tied], group[tied], words[order[tied] + 8 * k])
        order[tied] = sub
        # number the groups anew: a tied place starts one where its own does
        start = np.ones(len(order), dtype=bool)
        start[1:] = group[1:] != group[:-1]
        start[tied[1:]] |= inner[1:] != inner[:-1]
        group = np.cumsum(start) - 1
    return order, group


class Sorter:
    """Ranks of the cover sample of a text, exact to ``depth`` bytes or more."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.size = len(text)
        self.words = words_at(text, depth + 8 * _WORDS + 8)
        places = np.flatnonzero(_IN_COVER[np.arange(self.size) % PERIOD])
        order, group = _by_words(places, self.words)
        rank = np.full(self.size + depth + 2 * PERIOD, -1, dtype=np.int64)
        rank[order] = group
        known = PERIOD
        while known < depth and len(group) and group[-1] + 1 < len(group):
            nxt = np.where(places + known < len(rank), rank[np.minimum(places + known, len(rank) - 1)], -1)
            order, group = _refined(places, rank[places], nxt)
            rank[order] = group
            known *= 2
        self.rank = rank

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = SHIFT[a % PERIOD, b % PERIOD]
        return np.sign(self.rank[a + shift] - self.rank[b + shift])

    def _resolved(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Groups that tie over a period, sorted by ranks of the sample:
        three-way quicksort of all groups at once."""
        open_ = np.flatnonzero(_tied(group))
        while len(open_):
            own, members = group[open_], order[open_]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            number = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            sizes = np.diff([*starts, len(own)])
            pivot = members[starts + sizes // 2][number]
            side = self._compare(members, pivot)
            by = np.lexsort((side, number))
            order[open_] = members[by]
            number, side = number[by], side[by]
            split = np.concatenate([[True], (number[1:] != number[:-1]) | (side[1:] != side[:-1])])
            part = np.cumsum(split) - 1
            more = (side != 0) & (np.bincount(part)[part] > 1)
            group = np.zeros(len(order), dtype=np.int64)
            group[open_] = part
            open_ = open_[more]
        return order

    def buckets(self, places: np.ndarray, size: int = BUCKET) -> Iterator[np.ndarray]:
        """The suffixes at ``places`` in order, one sorted bucket at a time.

        Suffixes equal to the depth may stand in any order. A bucket takes
        whole groups of equal first words.
        """
        first = self.words[places]
        cuts = np.unique(np.sort(first)[::size]) if len(places) > size else first[:0]
        number = np.searchsorted(cuts, first, side="right")
        for k in range(len(cuts) + 1):
            own = places[number == k]
            if len(own):
                yield self._resolved(*_by_words(own, self.words))

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from each two places are the same."""
        left = np.arange(len(a))
        for k in range(0, length - 7, 8):
            left = left[self.words[a[left] + k] == self.words[b[left] + k]]
        if rest := length % 8:
            drop = np.uint64(8 * (8 - rest))
            at = length - rest
            left = left[self.words[a[left] + at] >> drop == self.words[b[left] + at] >> drop]
        out = np.zeros(len(a), dtype=bool)
        out[left] = True
        return out


def repeated(text: np.ndarray, places: np.ndarray, length: int, bucket: int = BUCKET) -> np.ndarray:
    """Sorted places whose ``length`` bytes also start at another place given.

    All strings lie inside ``text``.
    """
    sorter, found, last = Sorter(text, length), [], np.zeros(0, dtype=np.int64)
    for own in sorter.buckets(places, bucket):
        own = np.concatenate([last, own])
        same = sorter.equal(own[:-1], own[1:], length)
        found += [own[:-1][same], own[1:][same]]
        last = own[-1:]
    return np.unique(np.concatenate(found)) if found else places[:0]
