"""Byte-level BPE encoding and decoding.

A text is cut by the split pattern; each match is merged on its own. Merging
keeps a doubly linked list of the tokens so far and a queue of the adjacent
pairs by merge rank. The queue has a bucket for each rank with the places of
its pairs, and two levels of bitmaps over the buckets: find-first-set in the
root gives a word, find-first-set in the word a rank, whatever the number of
pairs. Merges change pairs without looking their old entries up: an entry
whose pair has since changed is stale and skipped when it surfaces. The cost
of a merge does not depend on the length of the match, which very long
matches (base64, runs of letters) need.

Of equal ranks the leftmost pair goes first, as a bucket is a heap of places.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.llm.batches import map_texts, tidy
from strandline.llm.segments import LIMIT, SegmentTable

#: Bits of a bitmap word.
_SHIFT = 8
_WIDTH, _MASK = 1 << _SHIFT, (1 << _SHIFT) - 1
_BITS = [1 << k for k in range(_WIDTH)]
#: Bytes of text encoded together.
GROUP = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space, its rank; by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Storage of the queue: a bucket of places for each rank, and the bitmap
    words over them. The root, one bit for each word, is a local of the loop
    that uses the queue, which leaves it empty."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * (ranks // _WIDTH + 1)


class Encoder:
    """Encodes and decodes by a table of ranks that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = LIMIT) -> None:
        self.ranks = ranks
        self.top = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern)
        self.queue = RankQueue(self.top)
        self.matches: dict[str, bytes] = {}
        self.table = SegmentTable(self._segments, lambda words: self._segments([" " + w for w in words]), np.dtype("<u4"), cache)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the token that starts at a place
        before = list(range(-1, n - 1))  # start of the token before it
        pair = [-1] * n  # rank of the pair that starts at a place
        get, buckets, words, bit, root = ranks.get, self.queue.buckets, self.queue.words, _BITS, 0
        # pairs that appear: (place, rank or None), put into the queue in order
        fresh = [(i, get(piece[i : i + 2])) for i in range(n - 1)]
        while True:
            for i, rank in fresh:
                if rank is None:
                    pair[i] = -1
                    continue
                pair[i] = rank
                bucket = buckets[rank]
                if bucket:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    word = rank >> _SHIFT
                    if not words[word]:
                        root |= bit[word]
                    words[word] |= bit[rank & _MASK]
            if not root:
                break
            # find-first-set in the root, then in its word
            word = (root & -root).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = (word << _SHIFT) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[word] = bits = bits ^ low
                if not bits:
                    root &= root - 1
            if pair[i] != rank:
                fresh = ()
                continue  # stale
            middle = end[i]
            end[i] = stop = end[middle]
            pair[middle] = -1
            left = before[i]
            if stop < n:
                before[stop] = i
                after = get(piece[i : end[stop]])
            else:
                after = None
            fresh = ((i, after),) if left < 0 else ((i, after), (left, get(piece[left:stop])))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _match(self, text: str) -> bytes:
        if (known := self.matches.get(text)) is None:
            known = array("I", self.merge(text.encode())).tobytes()
            if len(text) <= 8:
                # short matches recur among new words; longer ones as words
                if len(self.matches) >= 50_000:
                    self.matches.clear()
                self.matches[text] = known
        return known

    def _segments(self, texts: list[str]) -> list[bytes]:
        split, match = self.split.findall, self._match
        return [b"".join(map(match, split(text))) for text in texts]

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers (little-endian, as all platforms of
        Spark are)."""
        return self.table.encode([text.encode()])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The same for many texts in UTF-8."""
        return self.table.encode(texts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; made once, kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, keys: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """Per document its keys, ``ids`` (array of int), and what
    ``digest_documents`` gives.

    Null texts are empty: no ids. Special tokens' strings are plain text.
    """
    return _encoded(docs, keys, path, pattern, text, True)


def digest_documents(docs: DataFrame, keys: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """Per document its keys, n_tokens, and sha256 of the ids and of the bytes
    they decode to.

    Ids are hashed as little-endian unsigned 32-bit integers.
    """
    return _encoded(docs, keys, path, pattern, text, False)


def _encoded(docs: DataFrame, keys: list[str], path: str, pattern: str, text: str, with_ids: bool) -> DataFrame:
    def make() -> Callable[[list[bytes]], list[tuple]]:
        own = encoder(path, pattern)

        def one(ids: bytes) -> tuple:
            back = own.decode(array("I", ids))
            digest = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
            return (np.frombuffer(ids, dtype="<i4"), *digest) if with_ids else digest

        return lambda texts: [one(ids) for ids in own.encode_all(texts)]

    fields = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return map_texts(docs, keys, text, make, [("ids", pa.list_(pa.int32()), "array<int>")] * with_ids + fields, GROUP)


def decode_documents(rows: DataFrame, keys: list[str], path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Per row its keys and ``text``, what its ids decode to; null stays null.

    Ids that are no whole characters become replacement characters.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = [own.decode(x.values.to_numpy()).decode(errors="replace") if x.is_valid else None for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string())], names=[*keys, "text"])

    return rows.select(*keys, ids).mapInArrow(tidy(run), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string"]))
