"""Token ids in binary shards with constant-time access by document key.

A shard file holds, little-endian:

    header     8 bytes magic, then unsigned 64-bit: ids, documents, bytes of
               an id, levels of the index, seed of the index
    levels     uint64 count of bits of each level, a multiple of BLOCK
    ids        of all documents of the shard, one after another
    keys       per document in order: int64 key, int64 occurrence, uint8 null
    bits       of each level, least bit first
    ranks      uint64 for each BLOCK bits of all levels: set bits before it
    slots      per slot uint32 fingerprint, uint64 start, uint32 length

The levels are a minimal perfect hash: each key is placed alone in a bit of
the first level where no other key of the level meets it; keys that meet go
on to the next level. The rank of a key's bit is its slot, so n keys fill
slots 0 to n - 1, at about three bits a key. A fingerprint of 32 bits in the
slot tells keys that are not in the shard, but for one in four billion. A
lookup reads the header, and for each level it passes one bit; then a rank, a
block of bits and a slot, wherever in the file they lie: its cost does not
grow with the shard.

Documents go to shards by ranges of the key and stand in its order, null keys
first. The manifest, a table of a row for each shard, has its range of keys,
so a key is looked up in the shards that may hold it. Rows with equal keys
are told apart by their occurrence, counted on from shard to shard. Files are
written under another name and moved into place, so a task that is run again
or twice leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.batches import encoded, small_batches, tidy
from strandline.llm.segments import LIMIT, SegmentTable
from strandline.llm.shared import stored
from strandline.llm.textkit import mix64

MAGIC = b"STRNDTK2"
#: Bits between two stored ranks.
BLOCK = 512
SHARD_BYTES = 64 << 20
#: Texts are encoded in groups of about so many bytes.
GROUP = 1 << 20
_HEADER = struct.Struct("<8s5Q")
_SLOT = np.dtype([("fingerprint", "<u4"), ("start", "<u8"), ("length", "<u4")])
#: Shards whose ids are summed in one group before groups are summed.
_MANIFEST_GROUP = 1024


# -- the index -----------------------------------------------------------------


def key_hashes(keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    x = mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    x ^= mix64(occurrence.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + null.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return x


def _at(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)).astype(np.int64)


def build_levels(hashes: np.ndarray, spread: float = 2.0) -> list[np.ndarray] | None:
    """Bit arrays of the levels; None if keys cannot be told apart."""
    levels, left = [], hashes
    while len(left):
        if len(levels) > 60:
            return None
        bits = -(-max(64, int(spread * len(left))) // BLOCK) * BLOCK
        at = _at(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots(hashes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each key; -1 where no level takes it."""
    out, left, before = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes)), 0
    for k, bits in enumerate(levels):
        at = _at(hashes[left], k, len(bits))
        took = bits[at]
        out[left[took]] = before + (np.cumsum(bits) - 1)[at[took]]
        left, before = left[~took], before + int(bits.sum())
    return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


# -- shard files -----------------------------------------------------------------


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), os.path.abspath(uri))


def write_shard(uri: str, ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, null: np.ndarray) -> None:
    order = np.lexsort((np.arange(len(keys)), keys, ~null))
    same = np.zeros(len(keys), dtype=np.int64)
    k, z = keys[order], null[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (z[1:] != z[:-1])]) if len(keys) else np.zeros(0, dtype=bool)
    where = np.arange(len(keys))
    same[order] = where - np.maximum.accumulate(np.where(new, where, 0)) if len(keys) else same
    for seed in range(1, 100):
        hashes = key_hashes(keys, same, null, seed)
        if (levels := build_levels(hashes)) is not None:
            break
    else:
        raise ValueError("keys of a shard cannot be told apart")
    slot = slots(hashes, levels)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0)
    table = np.empty(len(keys), dtype=_SLOT)
    for column, value in zip(_SLOT.names, (fingerprints(hashes), start, lengths)):
        table[column][slot] = value
    bits = np.concatenate([*levels, np.zeros(0, dtype=bool)])
    ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1))[:-1]]) if len(bits) else np.zeros(0)
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(_HEADER.pack(MAGIC, len(ids), len(keys), ids.dtype.itemsize, len(levels), seed))
        f.write(np.array([len(x) for x in levels], dtype="<u8").tobytes())
        for column in (ids, keys.astype("<i8"), same.astype("<i8"), null.astype("u1"), np.packbits(bits, bitorder="little"), ranks.astype("<u8"), table):
            f.write(column.tobytes())
    fs.move(draft, path)


class Shard:
    """A shard file; what a lookup or a scan needs is read from its place."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        magic, ids, self.docs, width, levels, self.seed = _HEADER.unpack(self._bytes(0, _HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard file")
        at = _HEADER.size
        self.level_bits = np.frombuffer(self._bytes(at, 8 * levels), dtype="<u8").astype(np.int64)
        self.kind, self.count = np.dtype(f"<u{width}"), ids
        total, self.offset = int(self.level_bits.sum()), {}
        sizes = {"levels": 8 * levels, "ids": ids * width, "keys": 8 * self.docs, "occurrence": 8 * self.docs, "null": self.docs, "bits": total // 8, "ranks": total // BLOCK * 8, "slots": self.docs * _SLOT.itemsize}
        for name, size in sizes.items():
            self.offset[name], at = at, at + size

    def _bytes(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _array(self, name: str, kind: str | np.dtype, first: int, count: int) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self._bytes(self.offset[name] + first * kind.itemsize, count * kind.itemsize), dtype=kind)

    def ids(self, start: int, length: int) -> np.ndarray:
        return self._array("ids", self.kind, start, length)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, occurrence and whether null, of all documents in order."""
        return self._array("keys", "<i8", 0, self.docs), self._array("occurrence", "<i8", 0, self.docs), self._array("null", "u1", 0, self.docs).astype(bool)

    def _slot(self, key_hash: np.ndarray) -> int:
        """Slot of one key, -1 if no level takes it."""
        before = 0
        for k, bits in enumerate(self.level_bits.tolist()):
            place = before + int(_at(key_hash, k, bits)[0])
            if self._array("bits", "u1", place // 8, 1)[0] >> (place % 8) & 1:
                block = place // BLOCK
                own = self._bytes(self.offset["bits"] + block * BLOCK // 8, BLOCK // 8)
                below = int.from_bytes(own, "little") & ((1 << place % BLOCK) - 1)
                return int(self._array("ranks", "<u8", block, 1)[0]) + below.bit_count()
            before += bits
        return -1

    def locate(self, key: int | None, occurrence: int = 0) -> tuple[int, int] | None:
        """(start, length) of a document's ids, or None."""
        key_hash = key_hashes(np.array([key or 0]), np.array([occurrence]), np.array([key is None]), self.seed)
        slot = self._slot(key_hash)
        if slot < 0:
            return None
        row = self._array("slots", _SLOT, slot, 1)[0]
        return (int(row["start"]), int(row["length"])) if row["fingerprint"] == fingerprints(key_hash)[0] else None

    def document(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """Ids of one document, or None."""
        found = self.locate(key, occurrence)
        return None if found is None else self.ids(*found)

    def occurrences(self, key: int | None) -> int:
        """Documents of a key, by lookups alone."""
        least, most = 0, 1  # least is there (or 0), most is to be tried
        while self.locate(key, most - 1) is not None:
            least, most = most, 2 * most
        while least + 1 < most:
            middle = (least + most) // 2
            least, most = (middle, most) if self.locate(key, middle - 1) is not None else (least, middle)
        return least

    def find(self, keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of many documents, with the index read whole; start
        -1 where one is missing."""
        bits = np.unpackbits(self._array("bits", "u1", 0, int(self.level_bits.sum()) // 8), bitorder="little").astype(bool)
        hashes = key_hashes(keys, occurrence, null, self.seed)
        slot = slots(hashes, np.split(bits, np.cumsum(self.level_bits)[:-1]) if len(self.level_bits) else [])
        table, there = self._array("slots", _SLOT, 0, self.docs), slot >= 0
        there[there] = table["fingerprint"][slot[there]] == fingerprints(hashes[there])
        start, length = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        start[there], length[there] = table["start"][slot[there]], table["length"][slot[there]]
        return start, length


def document(manifest: DataFrame, key: int | None, occurrence: int = 0) -> np.ndarray | None:
    """Ids of the document of a key, by the manifest; or None."""
    k = F.lit(key).cast("long")
    holds = F.col("nulls") > 0 if key is None else (F.col("low") <= k) & (F.col("high") >= k)
    for row in manifest.filter(holds).orderBy("number").toLocalIterator():
        shard = Shard(row.path)
        if (found := shard.document(key, occurrence)) is not None:
            return found
        # equal keys may go on in the next shard
        occurrence -= shard.occurrences(key)
    return None


# -- encoding --------------------------------------------------------------------


class TextEncoder:
    """A tokenizer of the tokenizers library behind a table of words."""

    def __init__(self, path: str, cache: int = LIMIT) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        small = self.tokenizer.get_vocab_size() <= 0x10000
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # byte-level: a character stands for a byte
        self.table = SegmentTable(self._library, self._words, self.kind, cache)
        # the library looks for these in a text before all else, across words
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """New words go through the library as one text; what belongs to each
        is told by the bytes of the tokens, as none crosses a space."""
        text = [" " + w for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(text)], add_special_tokens=False)[0].ids, dtype=self.kind)
        upto = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum([len(w.encode()) for w in text])
        stops = np.searchsorted(upto, ends) + 1
        if len(upto) != stops[-1] or (upto[stops - 1] != ends).any():
            return self._library(text)
        data, size = ids.tobytes(), self.kind.itemsize
        cuts = [0, *(stops * size).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text in UTF-8, as little-endian integers."""
        whole = [k for k, data in enumerate(texts) if any(t in data for t in self.added)]
        if not whole:
            return self.table.encode(texts)
        plain = iter(self.table.encode([data for k, data in enumerate(texts) if k not in set(whole)]))
        special = dict(zip(whole, self._library([texts[k].decode() for k in whole])))
        return [special[k] if k in special else next(plain) for k in range(len(texts))]


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
            keys.append(key)
            texts.append(data)
            size += len(data)
            if size >= GROUP:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_shards(docs: DataFrame, uri: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; returns their manifest, a stored table.

    The manifest has a row for each shard: number, path, docs, ids, nulls
    (documents without key), low and high (range of the other keys), and
    ``first``, the ids of all shards before. Null texts are empty and hold the
    end id alone; texts may be of any length. Rows with equal keys stand in
    the order of a hash of their text. Other columns of ``docs`` are not
    looked at. Partitions without documents write no file.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    count = int(size // shard_bytes + 1)
    rows = small_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("key"), "tie"]
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(tokenizer)
        mark = np.array([end], dtype=own.kind).tobytes()
        parts, keys = [], []
        for group, texts in _groups(batches):
            parts += [ids + mark for ids in own.encode(texts)]
            keys += group
        if not keys:
            return
        number = TaskContext.get().partitionId()
        path = f"{uri}/part-{number:07d}.ids"
        lengths = np.array([len(p) // own.kind.itemsize for p in parts], dtype=np.int64)
        ids = np.frombuffer(b"".join(parts), dtype=own.kind)
        null = np.array([k is None for k in keys])
        write_shard(path, ids, lengths, np.array([k or 0 for k in keys], dtype=np.int64), null)
        named = [k for k in keys if k is not None]
        row = {"number": number, "path": path, "docs": len(keys), "ids": len(ids), "nulls": int(null.sum()), "low": min(named, default=None), "high": max(named, default=None)}
        yield pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

    made = stored(dealt.mapInArrow(tidy(run), "number bigint, path string, docs bigint, ids bigint, nulls bigint, low bigint, high bigint"), "token-manifest")
    group = F.floor(F.col("number") / _MANIFEST_GROUP).alias("group")
    before = lambda w: F.coalesce(F.sum("ids").over(w.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = made.groupBy(group).agg(F.sum("ids").alias("ids")).withColumnRenamed("group", "number")
    groups = groups.select(F.col("number").alias("group"), before(Window.partitionBy(F.lit(0))).alias("above"))
    within = made.select("*", group).withColumn("within", before(Window.partitionBy("group")))
    return stored(within.join(groups, "group").withColumn("first", F.col("above") + F.col("within")).drop("group", "above", "within"), "token-manifest")


_MANIFEST = pa.schema([("number", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files.

    Each document is found by its key through the index of its shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*[c.to_pylist() for c in batch.columns]):
                shard = Shard(path)
                keys, occurrence, null = shard.documents()
                start, length = shard.find(keys, occurrence, null)
                if (start < 0).any():
                    raise ValueError(f"{path}: a key is missing from its index")
                ids = shard.ids(0, shard.count)
                crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(start + at), pa.array(length), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return manifest.select("path", "first").repartition(shards, "path").mapInArrow(tidy(run), f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
