"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text and depends on the last 16 of
them; a chunk ends where its upper bits are zero, so an insertion moves the
ends near it only and equal passages fall into equal chunks wherever they
stand. Chunks go by a 128-bit digest: of those found more than once, the
first stays (smallest document id, then place), the others are removed. Rows
are told apart by their place in the files, not by their ids.

Repeated chunks that follow each other form a run. Every run goes, however
short; ``min_run`` spares shorter ones where a caller asks for it.

Digests are counted with partial sums before they are shuffled, so one that
a third of all documents share is one row of each task; rows that look their
digest up are joined, where Spark splits large keys. The text itself is
shuffled once, to meet what is removed from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import encoded, small_batches, tidy
from strandline.llm.shared import named_rows, stored
from strandline.llm.textkit import mix64, runs

#: Bytes of a chunk: least, most; ends one in 2**END_BITS after the least.
MIN_CHUNK, MAX_CHUNK, END_BITS = 24, 256, 5
#: Least bytes of a run that is removed.
MIN_RUN = 1
_GEAR = (mix64(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte, of the 16 bytes that end there."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last at its end; never in a character."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, dtype=np.uint8)
    found = (gear(raw)[:-1] >> np.uint16(16 - END_BITS)) == 0
    found &= (raw[1:] & 0xC0) != 0x80
    ends, last = [], 0
    for end in (np.flatnonzero(found) + 1).tolist():
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last += 1
            ends.append(last)
        if end - last >= MIN_CHUNK:
            ends.append(end)
            last = end
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        while last < n and data[last] & 0xC0 == 0x80:
            last += 1
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _digests(data: bytes, ends: list[int]) -> list[bytes]:
    start, out = 0, []
    for end in ends:
        out.append(xxhash.xxh3_128_digest(data[start:end]))
        start = end
    return out


def chunks(rows: DataFrame) -> DataFrame:
    """(__file, __row, __id, place, high, low): the chunks of each document, a
    digest once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places, digests = [], [], []
            for data in encoded(batch.column(3)):
                first: dict[bytes, int] = {}
                for k, d in enumerate(_digests(data, chunk_ends(data))):
                    first.setdefault(d, k)
                counts.append(len(first))
                places.extend(first.values())
                digests.extend(first)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["__file", "__row", "__id", "place", "high", "low"])

    return rows.select("__file", "__row", "__id", "__data").mapInArrow(tidy(run), "__file bigint, __row bigint, __id bigint, place int, high bigint, low bigint")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(key, text, n_bytes, n_chunks, n_repeated, n_removed, n_spans).

    ``text``: what is left. ``n_repeated``: bytes in runs of repeated chunks,
    those that stay as the first included. Null texts are empty. Every row is
    a document of its own, also where ids are equal or null: of rows with one
    id, null being before all others, one keeps a chunk. Texts may be of any
    length. Other columns of ``docs`` are not looked at, whatever their
    names. An empty table stays empty.
    """
    rows = named_rows(small_batches(docs), __id=F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), __key=F.col(key), __data=F.col(text))
    found = chunks(rows).withColumn("name", F.xxhash64("__file", "__row"))
    repeated = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "__id").alias("first")).filter("n > 1").drop("n")
    # written down: a join of two shuffled tables, whose very large keys Spark splits
    repeated = stored(repeated, "chunk-repeated")
    places = found.join(repeated, ["high", "low"]).select("__file", "__row", F.when(F.col("name") == F.col("first"), -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    lists = places.groupBy("__file", "__row").agg(F.collect_list("place").alias("places"))
    met = rows.join(lists.hint("shuffle_hash"), ["__file", "__row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, marks in zip(encoded(batch.column(1)), batch.column(2)):
                out.append(_remove(data, marks.values.to_numpy() if marks.is_valid else np.empty(0, dtype=np.int32), min_run))
            made = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made[0], pa.string()), *[pa.array(x, pa.int64()) for x in made[1:]]], names=[key, text, "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans"])

    kind = dict(docs.dtypes)[key]
    return met.select("__key", "__data", "places").mapInArrow(tidy(run), f"`{key}` {kind}, `{text}` string, n_bytes bigint, n_chunks bigint, n_repeated bigint, n_removed bigint, n_spans bigint")


def _long_runs(marked: np.ndarray, ends: np.ndarray, min_run: int) -> list[tuple[int, int]]:
    starts = np.concatenate([[0], ends[:-1]])
    first, last = runs(marked)
    return [(a, b) for a, b in zip(starts[first].tolist(), ends[last - 1].tolist()) if b - a >= min_run]


def _remove(data: bytes, places: np.ndarray, min_run: int) -> tuple:
    ends = chunk_ends(data)
    seen: dict[bytes, int] = {}
    away, again = np.zeros(len(ends), dtype=bool), np.zeros(len(ends), dtype=bool)
    digests = _digests(data, ends)
    elsewhere = {digests[k if k >= 0 else -1 - k]: k >= 0 for k in places.tolist()}
    for k, d in enumerate(digests):
        if d in seen:
            away[k] = again[k] = again[seen[d]] = True
        else:
            seen[d] = k
        if (own := elsewhere.get(d)) is not None:
            again[k] = True
            away[k] |= own
    if not again.any():
        return data.decode(), len(data), len(ends), 0, 0, 0
    stops = np.array(ends, dtype=np.int64)
    spans = _long_runs(away, stops, min_run)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept).decode(), len(data), len(ends), sum(b - a for a, b in _long_runs(again, stops, min_run)), sum(b - a for a, b in spans), len(spans)
