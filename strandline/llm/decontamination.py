"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards and builds a suffix array over the
words of a shard. Every test suffix is searched in it by its opening window
(ten words, or all of a shorter item; equal ones once) by binary search, which
gives all places of the shard where it stands. Places that follow each other
in document and item alike make one verbatim match, so each document has its
matches whole, of any length and with their locations; a document with one is
affected. ``longest_matches`` turns the view around: for every test suffix its
longest match over all documents and where it lies.

The arrays are sparse: a training suffix whose opening words open no test
suffix cannot match, so it is left out before sorting; what is left is sorted
to the length of the window (to ``DEPTH`` words for longest matches, which
compare words beyond). Words are compared by 64-bit hash.

The test items travel to the tasks in blocks of at most ``BLOCK_BYTES``, one
pass over the rows for each block, so a broadcast never exceeds a block
however large the benchmark is. A worker prepares a block once and keeps the
last one for its later tasks. Nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.batches import encoded, small_batches, tidy
from strandline.llm.shared import stored
from strandline.llm.textkit import runs, separator_table, word_hashes

WINDOW = 10
#: Words to which suffixes are ordered; beyond, longest matches compare words.
DEPTH = 64
#: UTF-8 bytes of items in one broadcast; prepared, they take some 50 times that.
BLOCK_BYTES = 2 << 20
#: Blocks applied in one plan before its result is written down.
BLOCKS_PER_PLAN = 4
#: A shard ends at so many words, or so many suffixes left to sort.
SHARD_WORDS, SHARD_SUFFIXES = 4_000_000, 100_000
_OPENING = 4
SEPARATORS = separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words_of(data: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased."""
    return word_hashes(data.lower(), SEPARATORS)


def _filter(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, dtype=bool)
    table[keys >> np.uint64(44)] = True
    return table


def _spread(x: np.ndarray) -> np.ndarray:
    return x * np.uint64(0x9E3779B97F4A7C15)


class _Lookup:
    """Place of a key in a sorted array, from 1; 0 where it is missing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.table = _filter(_spread(self.keys))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        maybe = np.flatnonzero(self.table[_spread(x) >> np.uint64(44)])
        at = np.searchsorted(self.keys, x[maybe])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == x[maybe]
        out[maybe[same]] = at[same] + 1
        return out


class TestItems:
    """One block of test items, ready for search."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int, depth: int = DEPTH) -> None:
        hashed = [(name, words) for name, text in items if len(words := words_of(text))]
        self.any = bool(hashed)
        if not self.any:
            return
        self.vocabulary = _Lookup(np.concatenate([w for _, w in hashed]))
        self.kind = np.dtype(">u2") if len(self.vocabulary.keys) < 0xFFFF else np.dtype(">u4")
        self.names = [name for name, _ in hashed]
        ids = self.ids = [self.vocabulary(w) for _, w in hashed]
        self.depth = min(depth, max(window, max(map(len, ids))))
        # distinct windows, the items that hold them, and the window of each suffix
        found: dict[bytes, int] = {}
        self.windows, self.holders, self.window_of = [], [], []
        for i, x in enumerate(ids):
            width = min(window, len(x))
            own = []
            for k in range(len(x) - width + 1):
                own.append(found.setdefault(x[k : k + width].tobytes(), len(found)))
                if own[-1] == len(self.windows):
                    self.windows.append(x[k : k + width])
                    self.holders.append(set())
                self.holders[own[-1]].add(i)
            self.window_of.append(own)
        self.low, self.high = self._rows(self.windows, 0), self._rows(self.windows, np.iinfo(self.kind).max)
        # what a suffix must open with to be worth sorting
        self.openings = {}
        for n in range(1, _OPENING + 1):
            opening = [x[k : k + n] for x in ids for k in range(len(x) - n + 1)] if n == _OPENING else [w for w in self.windows if len(w) == n]
            if opening:
                self.openings[n] = _Lookup(self._packed(np.array(opening)))

    def suffix_keys(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(item, word) of every test suffix, and its first words."""
        if not hasattr(self, "_suffixes"):
            places = [(i, k) for i, x in enumerate(self.ids) for k in range(len(x))]
            self._suffixes = places, self._rows([self.ids[i][k : k + self.depth] for i, k in places], 0)
        return self._suffixes

    def _rows(self, words: list[np.ndarray], fill: int) -> np.ndarray:
        out = np.full((len(words), self.depth), fill, dtype=self.kind)
        for row, w in zip(out, words):
            row[: len(w)] = w
        return out.view(f"S{self.depth * self.kind.itemsize}").ravel()

    @staticmethod
    def _packed(words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        for column in words.T:
            out = out * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64)
        return out

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Places of the suffixes of one document that may match."""
        found = np.zeros(len(ids), dtype=bool)
        for n, lookup in self.openings.items():
            count = len(ids) - n + 1
            if count <= 0:
                continue
            known = np.ones(count, dtype=bool)
            for k in range(n):
                known &= ids[k : k + count] > 0
            at = np.flatnonzero(known)
            if len(at):
                found[at[lookup(self._packed(ids[at[:, None] + np.arange(n)])) > 0]] = True
        return np.flatnonzero(found)


class Shard:
    """Suffix array over the documents gathered so far."""

    def __init__(self, items: TestItems) -> None:
        self.items, self.ids, self.places, self.starts, self.size, self.count = items, [], [], [], 0, 0

    def add(self, words: np.ndarray) -> None:
        self.starts.append(self.size)
        if self.items.any and len(words):
            ids = self.items.vocabulary(words)
            at = self.items.candidates(ids)
            if len(at):
                self.places.append(at + self.size)
                self.count += len(at)
            self.ids.append(ids)
        else:
            self.ids.append(np.zeros(len(words), dtype=np.int32))
        self.ids.append(np.zeros(1, dtype=np.int32))  # no match runs into the next document
        self.size += len(words) + 1

    @property
    def full(self) -> bool:
        return self.size >= SHARD_WORDS or self.count >= SHARD_SUFFIXES

    def build(self) -> None:
        depth, kind = self.items.depth, self.items.kind
        ids = np.concatenate([*self.ids, np.zeros(depth, dtype=np.int32)])
        places = np.concatenate(self.places)
        rows = np.empty((len(places), depth), dtype=kind)
        alive = np.ones(len(places), dtype=bool)
        for k in range(depth):
            column = ids[places + k]
            alive &= column > 0
            rows[:, k] = np.where(alive, column, 0)
        keys = rows.view(f"S{depth * kind.itemsize}").ravel()
        order = np.argsort(keys, kind="stable")
        self.array, self.keys, self.words = places[order], keys[order], ids

    def occurrences(self) -> Iterator[tuple[int, np.ndarray]]:
        """(window, places) of the windows that occur."""
        low = np.searchsorted(self.keys, self.items.low, side="left")
        high = np.searchsorted(self.keys, self.items.high, side="right")
        for w in np.flatnonzero(high > low):
            yield w, self.array[low[w] : high[w]]

    def longest(self, least: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
        """(test suffix, words, places) of the longest match, of ``least``
        words or more, of each suffix; all the places of that length."""
        kind, depth = self.items.kind, self.items.depth
        suffixes, keys = self.items.suffix_keys()
        at = np.searchsorted(self.keys, keys)
        own = keys.view(kind).reshape(-1, depth)
        best = np.zeros(len(own), dtype=np.int64)
        for side in (np.maximum(at - 1, 0), np.minimum(at, len(self.keys) - 1)):
            same = (self.keys[side].view(kind).reshape(-1, depth) == own) & (own > 0)
            best = np.maximum(best, np.logical_and.accumulate(same, axis=1).sum(axis=1))
        for s in np.flatnonzero(best >= max(least, 1)):
            n = int(best[s])
            prefix = [own[s, :n].astype(np.int32)]
            low = np.searchsorted(self.keys, self.items._rows(prefix, 0)[0], side="left")
            high = np.searchsorted(self.keys, self.items._rows(prefix, np.iinfo(kind).max)[0], side="right")
            places = self.array[low:high]
            if n == depth:
                i, k = suffixes[s]
                n, places = self._extended(self.items.ids[i][k:], n, places)
            yield int(s), n, places

    def _extended(self, suffix: np.ndarray, n: int, places: np.ndarray) -> tuple[int, np.ndarray]:
        """Matches of the first ``n`` words, gone on word by word: the most
        words that match and the places where they do."""
        while n < len(suffix):
            on = places[self.words[places + n] == suffix[n]]  # 0, the end of a document, is no word
            if not len(on):
                break
            n, places = n + 1, on
        return n, places


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks; null ids are named '', null texts have no words."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        data = row[1].encode()
        if block and size + len(data) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], data))
        size += len(data)
    if block:
        yield block


#: The block a worker prepared last.
_PREPARED: dict[tuple, TestItems] = {}


def _prepared(name: str, block: list[tuple[str, bytes]], window: int, depth: int) -> TestItems:
    if (name, window, depth) not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name, window, depth] = TestItems(block, window, depth)
    return _PREPARED[name, window, depth]


def _matches(windows: list[int], width: int, places: dict[int, np.ndarray]) -> np.ndarray:
    """Maximal matches of one item: rows (words, place, word of the item).

    ``windows`` of its suffixes in order, and where each stands in the shard,
    ascending. A place continues a match that stood one place before at the
    suffix before, so only two suffixes' places are held at a time.
    """
    none = np.empty(0, dtype=np.int64)
    before, length, out = none, none, []
    for k in range(len(windows) + 1):
        now = places.get(windows[k], none) if k < len(windows) else none
        at = np.searchsorted(before, now - 1)
        goes_on = np.zeros(len(now), dtype=bool)
        inside = at < len(before)
        goes_on[inside] = before[at[inside]] == now[inside] - 1
        ended = np.ones(len(before), dtype=bool)
        ended[at[goes_on]] = False
        if ended.any():
            n = length[ended]
            out.append(np.column_stack([n + width - 1, before[ended] - n + 1, k - n]))
        new = np.ones(len(now), dtype=np.int64)
        new[goes_on] = length[at[goes_on]] + 1
        before, length = now, new
    return np.concatenate(out)


def _apply(rows: DataFrame, spark: SparkSession, block: list[tuple[str, bytes]], text: str, window: int) -> DataFrame:
    shipped, block_name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
    names = rows.columns
    at, kept = names.index(text), {n: names.index(n) for n in ("__from", "__to", "__items", "__longest")}
    longest_type = pa.struct([("n_words", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _prepared(block_name, shipped.value, window, window)

        def flush(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits: dict[int, list] = {}
            names_of: dict[int, set[str]] = {}
            longest: dict[int, tuple] = {}
            if shard.places:
                shard.build()
                starts = np.array(shard.starts)
                where = {w: np.sort(places) for w, places in shard.occurrences()}
                for w, places in where.items():
                    width = len(items.windows[w])
                    docs = np.searchsorted(starts, places, side="right") - 1
                    holders = {items.names[i] for i in items.holders[w]}
                    for d, p in zip(docs.tolist(), (places - starts[docs]).tolist()):
                        hits.setdefault(d, []).append((p, p + width))
                        names_of.setdefault(d, set()).update(holders)
                for i in set().union(*[items.holders[w] for w in where]):
                    found = _matches(items.window_of[i], min(window, len(items.ids[i])), where)
                    docs = np.searchsorted(starts, found[:, 1], side="right") - 1
                    order = np.lexsort((found[:, 2], found[:, 1], -found[:, 0], docs))
                    best = order[np.concatenate([[True], np.diff(docs[order]) > 0])]
                    for d, (n, p, k) in zip(docs[best].tolist(), found[best].tolist()):
                        match = (-n, items.names[i], p - int(starts[d]), k)
                        longest[d] = min(match, longest.get(d, match))
            ends = np.diff([*shard.starts, shard.size]) - 1
            first = 0
            for batch in held:
                columns = [batch.column(i).to_pylist() for i in kept.values()]
                total = batch.column(names.index("__words")).to_pylist()
                for d in range(batch.num_rows):
                    total[d] = int(ends[first + d])
                    if first + d in hits:
                        mask = np.zeros(total[d], dtype=bool)
                        for a, b in [*zip(columns[0][d], columns[1][d]), *hits[first + d]]:
                            mask[a:b] = True
                        start, end = runs(mask)
                        columns[0][d], columns[1][d] = start.tolist(), end.tolist()
                        columns[2][d] = sorted(set(columns[2][d]) | names_of[first + d])
                        match, old = longest[first + d], columns[3][d]
                        if old is None or match < (-old["n_words"], old["item_id"], old["doc_word"], old["item_word"]):
                            columns[3][d] = {"n_words": -match[0], "item_id": match[1], "item_word": match[3], "doc_word": match[2]}
                first += batch.num_rows
                made = dict(zip([*kept.values(), names.index("__words")], [pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], longest_type), pa.array(total, pa.int64())]))
                yield pa.RecordBatch.from_arrays([made.get(i, batch.column(i)) for i in range(len(names))], names=names)

        shard, held = Shard(items), []
        for batch in batches:
            from_row = 0
            for d, data in enumerate(encoded(batch.column(at))):
                shard.add(words_of(data))
                if shard.full:
                    yield from flush(shard, [*held, batch.slice(from_row, d + 1 - from_row)])
                    shard, held, from_row = Shard(items), [], d + 1
            if from_row < batch.num_rows:
                held.append(batch.slice(from_row))
        if held:
            yield from flush(shard, held)

    return rows.mapInArrow(tidy(run), rows.schema)


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``__words`` (their number), ``__from`` and ``__to`` (runs
    of words hit, in order, apart), ``__items`` (ids of the items matched) and
    ``__longest`` (the longest match: words, item, place in both; else null).

    Rows keep all their columns; null and empty texts have no words. Texts may
    have any length, and rows may repeat. Without items, or with items that
    have no words, nothing is hit. Items with equal ids count as one. Columns
    of ``docs`` with these names are replaced.
    """
    none = F.array().cast("array<int>")
    rows = small_batches(docs).withColumns({"__words": F.lit(0).cast("long"), "__from": none, "__to": none, "__items": F.array().cast("array<string>"), "__longest": F.lit(None).cast("struct<n_words:bigint,item_id:string,item_word:bigint,doc_word:bigint>")})
    blocks = 0
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        if blocks and blocks % BLOCKS_PER_PLAN == 0:
            rows = stored(rows, "decontamination")
        rows, blocks = _apply(rows, docs.sparkSession, block, text, window), blocks + 1
    return rows if blocks else _apply(rows, docs.sparkSession, [], text, window)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no window of an item occurs in, with all
    their columns, whatever their names."""
    rows = docs.toDF(*[c if c == text else f"c{i}" if f"c{i}" != text else f"d{i}" for i, c in enumerate(docs.columns)])
    return matched(rows, benchmark, text=text, **options).filter(F.size("__from") == 0).select(*rows.columns).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, keys: list[str], **options) -> DataFrame:
    """Digest of each document: words, words hit, items and their sha256, and
    its longest verbatim match (words, item, first word in item and document;
    0 and nulls without one)."""
    rows = matched(docs, benchmark, **options)
    hit = F.aggregate(F.zip_with("__from", "__to", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select(
        *keys, F.col("__words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce("__longest.n_words", F.lit(0).cast("long")).alias("longest_words"), F.col("__longest.item_id").alias("longest_item"),
        F.col("__longest.item_word").alias("longest_item_word"), F.col("__longest.doc_word").alias("longest_doc_word"),
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = _OPENING, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): for every test suffix
    its longest verbatim match of ``least`` words or more in all documents.

    Of equally long matches the one with the smallest document id and place.
    """
    kinds, spark, found = dict(docs.dtypes), docs.sparkSession, None
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            items = _prepared(name, shipped.value, WINDOW, DEPTH)

            def flush(shard: Shard, ids: list) -> Iterator[pa.RecordBatch]:
                if not shard.places:
                    return
                shard.build()
                starts, rows = np.array(shard.starts), []
                for s, n, places in shard.longest(least):
                    at = np.searchsorted(starts, places, side="right") - 1
                    d, word = min(zip(at.tolist(), (places - starts[at]).tolist()), key=lambda x: (ids[x[0]] is not None, ids[x[0]], x[1]))
                    item, k = items.suffix_keys()[0][s]
                    rows.append((items.names[item], k, n, ids[d], word))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])

            shard, ids = Shard(items), []
            for batch in batches:
                for key, data in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                    shard.add(words_of(data))
                    ids.append(key)
                    if shard.full:
                        yield from flush(shard, ids)
                        shard, ids = Shard(items), []
            yield from flush(shard, ids)

        part = docs.select(doc_id, text).mapInArrow(tidy(run), f"item_id string, item_word bigint, n_words bigint, doc_id {kinds[doc_id]}, doc_word bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id string, item_word bigint, n_words bigint, doc_id {kinds[doc_id]}, doc_word bigint")
    best = F.min(F.struct((-F.col("n_words")).alias("o"), "doc_id", "doc_word", "n_words")).alias("b")
    return found.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "b.n_words", "b.doc_id", "b.doc_word")
