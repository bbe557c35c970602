"""Exact substring deduplication: bytes in strings of 200 that occur again.

Sorting all suffixes of a corpus would move each byte many times, so those
that cannot repeat are left out first, without loss:

1. Each string of ``length`` bytes is named by its anchor: the leftmost of
   its k-mers whose hash is least. Equal strings have equal anchors at equal
   places, and neighbouring strings share theirs, so a text has about one
   anchor in 60 bytes. Strings whose anchor's k-mer occurs once are unique.
2. All strings that share one occurrence of an anchor form its context.
   Contexts equal as a whole are one class; a class of two or more repeats
   all its strings. Only where an anchor's k-mer has contexts that differ
   (the rims of repeated passages) must strings be compared.
3. There one context of each class goes to the bucket of its anchor. A task
   puts buckets together up to ``BLOCK`` bytes and sorts their suffixes by
   the blockwise difference-cover construction of ``suffix_sort``; strings
   whose neighbours in that order agree on all bytes are repeated. An anchor
   with more than ``HOT`` classes has its strings dealt out one by one, by
   their own hash, so that no task holds all of it.

Whole contexts are compared by 128-bit digests, strings in step 3 as bytes; a
collision of k-mers, which have 64 bits, brings more contexts together and
changes nothing. Rows are told apart by their place in the files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import suffix_sort
from strandline.llm.batches import encoded, small_batches, tidy
from strandline.llm.shared import named_rows, stored
from strandline.llm.textkit import mix64

LENGTH = 200
#: Bytes of the k-mers that anchor strings: longer ones are seldom shared by
#: strings that differ, shorter ones give fewer anchors.
KMER = 80
#: Bytes of contexts sorted at once.
BLOCK = 4 << 20
#: Classes of an anchor that go to one task.
HOT = 20_000
_PIECE = (1 << 20) - 4096
_LOW = np.uint64((1 << 20) - 1)
_BYTE = mix64(np.arange(7001, 7257, dtype=np.uint64))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _kmers(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place."""
    powers, have = [_BYTE[raw]], 1
    while 2 * have <= k:
        h = powers[-1]
        powers.append(h[:-have] * _ODD[len(powers) % 6] + h[have:])
        have *= 2
    out, at, count = None, 0, len(raw) - k + 1
    for bit in range(len(powers) - 1, -1, -1):
        if k >> bit & 1:
            part = powers[bit][at : at + count]
            out = part if out is None else out * _ODD[5] + part
            at += 1 << bit
    return mix64(out)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): each anchor and the range of the starts of
    the strings it stands for."""
    n = len(data) - length + 1
    parts = []
    for s in range(0, max(n, 0), _PIECE):
        raw = np.frombuffer(data, dtype=np.uint8, count=min(_PIECE, n - s) + length - 1, offset=s)
        h = _kmers(raw, kmer)
        # the upper bits rank the hash, the lower ones hold the place: leftmost wins
        least = _sliding_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - kmer + 1)
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        parts.append((h[at[first]], at[first] + s, first + s, last + s))
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchor_rows(docs: DataFrame, length: int, kmer: int, located: bool) -> DataFrame:
    """(hash, context) of every anchor; with its document and place if asked."""
    names = ["hash", "context", "context2"] + (["__file", "__row", "first", "span", "offset"] if located else [])
    kinds = dict(hash="bigint", context="bigint", context2="bigint", __file="bigint", __row="bigint", first="int", span="smallint", offset="smallint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, contexts, counts, first, span, offset = [], [], [], [], [], []
            for data in encoded(batch.column(batch.num_columns - 1)):
                h, place, a, b = anchors(data, length, kmer)
                counts.append(len(h))
                if len(h):
                    hashes.append(h)
                    whole = np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(a.tolist(), (b + length).tolist())]), dtype="<u8").reshape(-1, 2)
                    contexts.append(whole ^ mix64((place - a).astype(np.uint64))[:, None])
                    first.append(a)
                    span.append(b - a)
                    offset.append(place - a)
            if not hashes:
                continue
            both = np.concatenate(contexts).view(np.int64)
            made = [pa.array(c) for c in (np.concatenate(hashes).view(np.int64), both[:, 0], both[:, 1])]
            if located:
                at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                made += [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(first), pa.int32()), pa.array(np.concatenate(span), pa.int16()), pa.array(np.concatenate(offset), pa.int16())]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return docs.select(*["__file", "__row"] * located, "__data").mapInArrow(tidy(run), ", ".join(f"`{n}` {kinds[n]}" for n in names))


_CONTEXT = "bucket bigint, hash bigint, data binary, offset smallint, single boolean, __file bigint, __row bigint, first int"


def _contexts(rows: DataFrame, length: int, hot: int) -> DataFrame:
    """Bytes of the contexts that documents hold for their classes.

    rows: (__file, __row, __data, wanted: array of first, span, offset, hash,
    single, classes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, wanted in enumerate(batch.column(3)):
                if not wanted.is_valid:
                    continue
                data = batch.column(2)[k].as_buffer().to_pybytes()
                who = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for w in wanted.as_py():
                    a, z = w["first"], w["first"] + w["span"] + length
                    if w["classes"] <= hot:
                        out.append((w["hash"], w["hash"], data[a:z], w["offset"], w["single"], *who, a))
                    else:
                        for s in range(w["span"] + 1):
                            part = data[a + s : a + s + length]
                            out.append((xxhash.xxh3_64_intdigest(part) - (1 << 63), w["hash"], part, w["offset"] - s, w["single"], *who, a + s))
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int16(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "hash", "data", "offset", "single", "__file", "__row", "first"])

    return rows.mapInArrow(tidy(run), _CONTEXT)


def _sorted_blocks(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """(__file, __row, start, stop): runs of bytes of single contexts that
    occur in another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            data = [h[1] for h in held]
            begin = np.concatenate([[0], np.cumsum([len(d) for d in data])])
            counts = np.array([len(d) - length + 1 for d in data])
            places = np.concatenate([np.arange(a, a + n) for a, n in zip(begin.tolist(), counts.tolist())])
            again = suffix_sort.repeated(np.frombuffer(b"".join(data), dtype=np.uint8), places, length)
            own = np.searchsorted(begin, again, side="right") - 1
            single = np.array([h[2] for h in held])[own]
            again, own = again[single], own[single]
            if len(again):
                new = np.concatenate([[True], (again[1:] != again[:-1] + 1) | (own[1:] != own[:-1])])
                a = np.flatnonzero(new)
                z = np.concatenate([a[1:], [len(again)]]) - 1
                who = own[a]
                base = np.array([h[5] for h in held])[who] - begin[who]
                yield pa.RecordBatch.from_arrays([pa.array([held[k][3] for k in who], pa.int64()), pa.array([held[k][4] for k in who], pa.int64()), pa.array(again[a] + base, pa.int32()), pa.array(again[z] + base + length, pa.int32())], names=["__file", "__row", "start", "stop"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= block and row[0] != bucket:
                    yield from flush()
                    held, size = [], 0
                bucket = row[0]
                held.append(row)
                size += len(row[1])
        if held:
            yield from flush()

    rows = contexts.select("bucket", "data", "single", "__file", "__row", "first")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "__file bigint, __row bigint, start int, stop int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(__file, __row, start, stop): spans of repeated bytes, overlapping.

    ``docs``: (__file, __row, __data).
    """
    ends = [f(c).alias(n) for c in ("context", "context2") for f, n in ((F.min, f"low_{c}"), (F.max, f"high_{c}"))]
    again = _anchor_rows(docs, length, kmer, False).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1")
    # written down, so that the joins below shuffle both sides and Spark can
    # split the rows of a k-mer that very many documents share
    mixed = (F.col("low_context") != F.col("high_context")) | (F.col("low_context2") != F.col("high_context2"))
    again = stored(again.select("hash", mixed.alias("mixed")), "suffix-repeated")
    found = stored(_anchor_rows(docs, length, kmer, True).join(again.hint("shuffle_hash"), "hash"), "suffix-anchors")
    span = [F.col("first").alias("start"), (F.col("first") + F.col("span") + length).alias("stop")]
    whole = found.filter("not mixed").select("__file", "__row", *span)
    mixed = found.filter("mixed").drop("mixed").withColumn("name", F.xxhash64("__file", "__row"))
    kinds = stored(mixed.groupBy("hash", "context", "context2").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("owner")), "suffix-kinds")
    many = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("classes"))
    kinds = stored(kinds.join(many, "hash"), "suffix-classes")
    mixed = mixed.join(kinds, ["hash", "context", "context2"])
    known = mixed.filter("n > 1").select("__file", "__row", *span)
    wanted = F.struct("first", "span", "offset", "hash", (F.col("n") == 1).alias("single"), "classes")
    owners = mixed.filter(F.col("name") == F.col("owner")).groupBy("__file", "__row").agg(F.collect_list(wanted).alias("wanted"))
    rows = docs.join(owners.hint("shuffle_hash"), ["__file", "__row"], "left").select("__file", "__row", "__data", "wanted")
    return whole.union(known).union(_sorted_blocks(_contexts(rows, length, hot), length, block))


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    kept, at, removed, count = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            count += 1
            kept.append(data[at:a])
        if b > end:
            removed += b - max(a, end)
            end = at = b
    kept.append(data[at:])
    return kept, removed, count


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = False, **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), and ``kept`` (the bytes
    left) if asked.

    Every occurrence goes, the first too. Null texts are empty. Texts below
    ``length`` bytes lose nothing; longer ones may be of any length. Every
    row is a document of its own, with equal or null ids too, and equal rows
    repeat each other. Other columns of ``docs`` are not looked at, whatever
    their names. An empty table stays empty.
    """
    rows = named_rows(small_batches(docs), __key=F.col(key).cast("long"), __data=F.col(text))
    spans = repeated_spans(rows, **options)
    lists = spans.groupBy("__file", "__row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    met = rows.join(lists.hint("shuffle_hash"), ["__file", "__row"], "left").select("__key", "__data", "spans")
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data, found in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2)):
                left, removed, count = [data], 0, 0
                if found.is_valid:
                    both = found.values.flatten()
                    left, removed, count = _kept(data, list(zip(both[0].to_pylist(), both[1].to_pylist())))
                whole = b"".join(left)
                out.append((name, len(data), removed, count, hashlib.sha256(whole).hexdigest(), whole)[: len(names)])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)

    schema = f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept
    return met.mapInArrow(tidy(run), schema)
