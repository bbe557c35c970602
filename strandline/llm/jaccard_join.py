"""Near-duplicate documents by an exact join on n-gram Jaccard similarity.

Documents are sets of word n-grams; two link at ``percent`` hundredths of
similarity. The join filters by prefixes: with each set in one global order,
rare n-grams first, sets that link share an n-gram in the first
n - ceil(t n) + 1 of each. The order comes from two tables of counts of fixed
size over all documents, of hashed n-grams and of hashed words. N-grams come
by their counter, a quarter of an octave apart above 127; among those of one
counter, and once the corpus is large most counters are alike by collisions,
those of rarer words come first, which chance repeats least. Collisions cost
speed, never a link, as any total order is right.

1. Equal sets are one class; classes are named by a 128-bit digest of their
   set. N-grams are 64-bit hashes; two of them would have to collide within
   one pair of sets to change a similarity.
2. Prefix n-grams meet: the classes of one n-gram are paired within the
   length filter. A pair is tied unless the sketches of its sets, parities of
   hashed n-grams in about a bit an n-gram, differ in more places than sets
   that link can; a phrase that two documents share by chance, or a noisy
   order, thus ties nothing. Of an n-gram of many classes neighbours in order
   of size are tied unseen. A tie is a candidate for a link; what links is
   tied, over some neighbours. A very frequent n-gram is salted, and the first
   class of each size of each salt ties the salts.
3. Tied classes form blocks (connected components). Links do not leave a
   block, so a block's texts come together and are joined there in memory by
   prefix, length, positional and suffix filters, in an order by the counts
   of the block, each pair verified at most once and not at all if both are
   known to be in one component. A block beyond a size is cut into pieces by
   size of set, and a sample of the block (``pivots``) joins every piece.
4. The links found, a forest in each piece, give components. In a block of
   several pieces those outside its largest component meet all pieces within
   the length filter; classes of the largest one are not compared with each
   other again, so a block that is one great group of near copies costs its
   size and not the square of it. Where most lie outside, every two pieces
   within the length filter meet instead, which sends less.

No pair of equal texts is ever made, and candidates are linear in the rows
of an n-gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.batches import encoded, map_texts, tidy
from strandline.llm.components import components
from strandline.llm.shared import stored
from strandline.llm.textkit import shingle_set, window_hashes, word_hashes

WIDTH, PERCENT = 4, 85
#: Counters of the table of n-gram counts, as a power of two. Its size is
#: fixed, a byte a counter where it is broadcast; it sets the order alone.
COUNTER_BITS = 24
#: The same of words, in the order of n-grams of one counter.
WORD_BITS = 20
_SLICES = 512
#: Bits of the set of classes whose texts are sent.
SIEVE_BITS = 25
#: Bytes of text in a piece of a block, and the share of them that pivots add.
PIECE_BYTES, PIVOTS = 4 << 20, 0.25
#: Classes of an n-gram, by its counter, for each salt.
SALT = 20_000
#: Classes of an n-gram of which all pairs are looked at.
PAIRED = 24


def set_of(data: bytes, width: int = WIDTH) -> np.ndarray:
    return shingle_set(word_hashes(data.lower()), width)


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def tie_of(name: bytes) -> int:
    """64 bits of a class's name: enough for candidates, which are verified."""
    return int.from_bytes(name[:8], "little", signed=True)


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the n-grams that fall on each of 64 bits or more, a power
    of two of at least one an n-gram."""
    bits = max(64, 1 << (max(len(shingles), 1) - 1).bit_length())
    # high bits of a product, as n-grams of one prefix need not differ in their own
    at = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by sketches;
    the longer one is folded to the length of the other."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        # n-grams are placed by high bits: one bit of the shorter is a run of the longer
        runs = np.unpackbits(a.view(np.uint8)).reshape(8 * b.nbytes, -1)
        a = np.packbits(runs.sum(axis=1, dtype=np.int64).astype(np.uint8) & 1).view(np.uint64)
    return int(np.bitwise_count(a ^ b).sum())


def classes(docs: DataFrame, keys: list[str], text: str, width: int) -> DataFrame:
    """Per document its keys, ``__n`` (size of its set), ``__class``,
    ``__tie`` and ``__sketch``."""

    def make():
        def of(data: bytes) -> tuple:
            s = set_of(data, width)
            name = class_of(s)
            return len(s), name, tie_of(name), sketch(s)

        return of

    return map_texts(docs, keys, text, make, [("__n", pa.int64(), "bigint"), ("__class", pa.binary(), "binary"), ("__tie", pa.int64(), "bigint"), ("__sketch", pa.binary(), "binary")])


# -- the order of n-grams ----------------------------------------------------------


def _codes(counts: np.ndarray) -> np.ndarray:
    """A byte for each count: exact to 127, then a quarter of an octave."""
    fine = 128 + 4 * (np.log2(np.maximum(counts, 128)) - 7)
    return np.where(counts < 128, counts, np.minimum(fine, 255)).astype(np.uint8)


#: About the count that each code stands for.
_COUNTS = np.where(np.arange(256) < 128, np.arange(256), 2.0 ** (7 + (np.arange(256) - 128) / 4))


class Order:
    """The order of n-grams: codes of the counts of hashed n-grams and words."""

    def __init__(self, grams: np.ndarray, words: np.ndarray) -> None:
        self.grams, self.words = grams, words

    def prefix(self, data: bytes, width: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, its prefix in the order, about the count of each of those)."""
        words = word_hashes(data.lower())
        if len(words) < width:
            s = shingle_set(words, width)
            return s, s, np.ones(len(s))
        s, first = np.unique(window_hashes(words, width), return_index=True)
        code = self.grams[(s >> np.uint64(64 - _bits(self.grams))).astype(np.int64)]
        own = np.concatenate([[0], np.cumsum(self.words[(words >> np.uint64(64 - _bits(self.words))).astype(np.int64)], dtype=np.int64)])
        rare = (own[width:] - own[:-width])[first]
        order = np.lexsort((rare, code))[: prefix_length(len(s), percent)]
        return s, s[order], _COUNTS[code[order]]


def _bits(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


def rarity(docs: DataFrame, text: str, width: int, bits: int = COUNTER_BITS, word_bits: int = WORD_BITS) -> Order:
    """The order by the sets that hold an n-gram and the places of a word."""
    slices = min(_SLICES, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, held, size = np.zeros(1 << bits, dtype=np.uint16), np.zeros(1 << word_bits, dtype=np.uint32), [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                grams[at] = np.minimum(grams[at] + n, 0xFFFF)  # so common is common enough
            held, size = [], 0

        for batch in batches:
            for data in encoded(batch.column(0)):
                own = word_hashes(data.lower())
                at, n = np.unique((own >> np.uint64(64 - word_bits)).astype(np.uint32), return_counts=True)
                words[at] += n.astype(np.uint32)
                s = shingle_set(own, width)
                held.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(s)
                if size > 500_000:
                    add()
        add()
        if words.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in [*grams.reshape(slices, -1), words]]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices + 1), pa.int32()), pa.array(parts)], names=["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                kind = np.uint16 if part < slices else np.uint32
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts.as_py()), dtype=kind).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_codes(x).tobytes() for x in sums.values()])], names=["part", "counts"])

    parts = docs.select(text).mapInArrow(tidy(count), "part int, counts binary").repartition("part")
    grams, words = np.zeros((slices, (1 << bits) // slices), dtype=np.uint8), np.zeros(1 << word_bits, dtype=np.uint8)
    # written down, so that the tasks' tables, some 5 MB each, leave the disk
    for row in stored(parts.mapInArrow(tidy(total), "part int, counts binary"), "jaccard-counts").toLocalIterator():
        if row.part < slices:
            grams[row.part] = np.frombuffer(row.counts, dtype=np.uint8)
        else:
            words[:] = np.frombuffer(row.counts, dtype=np.uint8)
    return Order(grams.ravel(), words)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, m, n, sure) of rows (token, salt, name, n) that come together by
    token and salt in order of n: all pairs within the length filter, and of
    more than PAIRED classes, or salted ones, neighbours, as ``sure``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(token: np.ndarray, salt: np.ndarray, name: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # a class comes once from each task that has it
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (name[1:] != name[:-1])])
            token, salt, name, n = (x[new] for x in (token, salt, name, n))
            start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
            count = np.diff(np.append(start, len(token)))
            group, count = np.repeat(np.arange(len(start)), count), np.repeat(count, count)
            sure = (count > PAIRED) | (salt > 0)
            left, right, by = [], [], np.arange(len(token))
            for far in range(1, PAIRED):
                by = by[by + far < len(token)]
                if far == 2:
                    by = by[~sure[by]]
                by = by[(group[by] == group[by + far]) & (100 * n[by] >= percent * n[by + far])]
                if not len(by):
                    break
                left.append(by)
                right.append(by + far)
            left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
            columns = [name[left], name[right], n[left], n[right], sure[left]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "m", "n", "sure"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            some = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            some = [x.astype(np.int64) for x in some]
            if held is not None:
                some = [np.concatenate(x) for x in zip(held, some)]
            # the last group may go on in the next batch
            goes_on = (some[0] == some[0][-1]) & (some[1] == some[1][-1])
            last = len(goes_on) if goes_on.all() else len(goes_on) - int(np.argmin(goes_on[::-1]))
            at = 0 if goes_on.all() else last
            if at:
                yield made(*[x[:at] for x in some])
            held = [x[at:] for x in some]
        if held is not None:
            yield made(*held)

    return rows.select("token", "salt", "name", "n").mapInArrow(tidy(run), "a bigint, b bigint, m bigint, n bigint, sure boolean")


def _alike(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, m, n) whose sketches let them link."""
    # two classes of one ``tie_of`` have no sketch and are not sifted
    one = F.when(F.min("__class") == F.max("__class"), F.min("__sketch"))
    sketches = stored(known.groupBy(F.col("__tie").alias("a")).agg(one.alias("x")), "jaccard-sketches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, other, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = np.ones(batch.num_rows, dtype=bool)
            for k, (m, n, one, two) in enumerate(zip(size, other, x, y)):
                if one is not None and two is not None:
                    keep[k] = differing(one, two) <= m + n - 2 * -(-percent * (m + n) // (100 + percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(sketches, "a", "left").join(sketches.toDF("b", "y"), "b", "left")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint")


def _ties(docs: DataFrame, known: DataFrame, text: str, width: int, percent: int, bits: int) -> DataFrame:
    """Candidate ties (a, b) between classes, by ``tie_of`` their names."""
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs, text, width, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = table.value, set()
        for batch in batches:
            tokens, names, sizes, counts, salts = [], [], [], [], []
            for data in encoded(batch.column(0)):
                s, prefix, common = order.prefix(data, width, percent)
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)
                dealt = 1 + (common / SALT).astype(np.int64)
                tokens.append(prefix)
                names.append(tie_of(name))
                sizes.append(len(s))
                counts.append(len(prefix))
                salts.append(np.where(dealt > 1, 1 + int.from_bytes(name[8:15], "little") % dealt, 0))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(salts).astype(np.int32), np.repeat(np.array(names, dtype=np.int64), counts), np.repeat(np.array(sizes, dtype=np.int32), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "salt", "name", "n"])

    rows = docs.select(text).mapInArrow(tidy(run), "token bigint, salt int, name bigint, n int")
    before = Window.partitionBy("token", "salt").orderBy("n", "name")
    near = rows.select("*", F.lag("name").over(before).alias("a"), F.lag("n").over(before).alias("m"), F.lead("n").over(before).alias("o"))
    # each size's first class of each salt, in one order over all salts; one
    # product, as a condition on the salt alone would make a second pass
    heads = near.filter(F.coalesce("salt", F.lit(0)) * F.when(F.col("m").isNull() | (F.col("m") < F.col("n")), 1).otherwise(0) > 0).select("token", "n", "name")
    across = Window.partitionBy("token").orderBy("n", "name")
    heads = heads.select("name", "n", F.lag("name").over(across).alias("a"), F.lag("n").over(across).alias("m"))
    within = lambda m, n: F.coalesce(100 * F.col(m).cast("long") >= percent * F.col(n).cast("long"), F.lit(False))
    heads = heads.filter((F.col("a") != F.col("name")) & within("m", "n"))
    heads = heads.select("a", F.col("name").alias("b"), F.col("m").cast("long"), F.col("n").cast("long"), F.lit(True).alias("sure"))
    pairs = _pairs(near.filter(within("m", "n") | within("n", "o")), percent).union(heads)
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("m").alias("m"), F.max("n").alias("n"), F.max("sure").alias("sure")), "jaccard-pairs")
    return pairs.filter("sure").select("a", "b").union(_alike(pairs.filter("not sure").drop("sure"), known, percent))


# -- the join inside a block ---------------------------------------------------------


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of the symmetric difference of two sorted arrays."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(x) // 2
    at = int(np.searchsorted(y, x[middle]))
    meets = at < len(y) and y[at] == x[middle]
    rest = y[at + meets :]
    right = abs(len(x) - middle - 1 - len(rest))
    left = abs(middle - at)
    bound = left + right + (not meets)
    if bound > most:
        return bound
    left = _apart(x[:middle], y[:at], most - right - (not meets), depth - 1)
    if left + right + (not meets) > most:
        return left + right + (not meets)
    return left + _apart(x[middle + 1 :], rest, most - left - (not meets), depth - 1) + (not meets)


def link(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, allowed: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Component label of each set (its smallest member's place).

    ``known``: labels to start from. ``allowed``: of a set and others, which
    pairs are to be verified here; the rest are left to other tasks.
    """
    count = len(sets)
    label = np.arange(count) if known is None else known.copy()
    members: dict[int, list[int]] = {}
    for k, root in enumerate(label.tolist()):
        members.setdefault(root, []).append(k)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(values))
    single = np.sort(counts)  # by rank
    ranked = [np.sort(r) for r in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    index: dict[int, tuple[list[int], list[int]]] = {}
    for x in np.argsort(sizes, kind="stable").tolist():
        n, own = int(sizes[x]), ranked[x]
        prefix = own[: prefix_length(n, percent)]
        shared = np.flatnonzero(single[prefix] > 1).tolist()
        found, mine, theirs = [], [], []
        for i in shared:
            if (posting := index.get(int(prefix[i]))) is not None:
                found.append(np.array(posting[0]))
                theirs.append(np.array(posting[1]))
                mine.append(np.full(len(posting[0]), i))
        if found:
            ys, i, j = np.concatenate(found), np.concatenate(mine), np.concatenate(theirs)
            ys, first, hits = np.unique(ys, return_index=True, return_counts=True)
            m = sizes[ys]
            least = -(-percent * (n + m) // (100 + percent))
            keep = (100 * m >= percent * n) & (1 + np.minimum(n - i[first] - 1, m - j[first] - 1) >= least) & (label[ys] != label[x])
            if allowed is not None:
                keep &= allowed(x, ys)
            at = np.flatnonzero(keep)
            for k in at[np.argsort(-hits[at], kind="stable")].tolist():
                y = int(ys[k])
                if label[y] == label[x]:
                    continue
                most = n + int(m[k]) - 2 * int(least[k])
                if _apart(own, ranked[y], most, 2) > most:
                    continue
                common = len(np.intersect1d(own, ranked[y], assume_unique=True))
                if 100 * common >= percent * (n + int(m[k]) - common):
                    a, b = sorted((int(label[x]), int(label[y])))
                    label[members[b]] = a
                    members[a] += members.pop(b)
        for i in shared:
            posting = index.setdefault(int(prefix[i]), ([], []))
            posting[0].append(x)
            posting[1].append(i)
    return label


def _joined(pieces: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): classes linked, a forest for each task.

    pieces: (block, first, second, name, root, piece, outside, text). Without
    ``second`` all rows of a task meet. With it, they are the classes of the
    piece ``second`` and some of those outside the block's largest component,
    which meet them; ``root`` is the component known so far. Two outside are
    left to the task of the later piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                held.clear()
                return
            names = sorted(held)
            if task[2] is None:
                label = link([held[c][0] for c in names], percent)
                start = np.arange(len(names))
            else:
                first: dict[bytes, int] = {}
                start = np.array([first.setdefault(held[c][1], k) for k, c in enumerate(names)])
                piece, outside = np.array([held[c][2] for c in names]), np.array([held[c][3] for c in names])
                inner = piece == task[2]

                def allowed(x: int, ys: np.ndarray) -> np.ndarray:
                    if inner[x]:
                        return ~inner[ys] & (piece[ys] < task[2] if outside[x] else True)
                    return inner[ys] & (~outside[ys] | (piece[x] < task[2]))

                label = link([held[c][0] for c in names], percent, start, allowed)
            moved = np.unique(start[label != start])
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in moved], pa.binary()), pa.array([names[label[k]] for k in moved], pa.binary())], names=["a", "b"])
            held.clear()

        for batch in batches:
            block, first, second, name, root, piece, outside = (c.to_pylist() for c in batch.columns[:7])
            for k, data in enumerate(encoded(batch.column(7))):
                if (block[k], first[k], second[k]) != task:
                    yield from flush()
                    task = (block[k], first[k], second[k])
                if name[k] not in held:
                    held[name[k]] = (set_of(data, width), root[k], piece[k], outside[k])
        yield from flush()

    order = ["block", "first", "second"]
    rows = pieces.select(*order, "name", "root", "piece", "outside", "text")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), "a binary, b binary")


def _sieve(names: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bit set of fixed size that has every name: what is not in it need not
    be sent to meet them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits >> 3, dtype=np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at = tie_of(x) & (1 << bits) - 1
                held[at >> 3] |= 1 << (at & 7)
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(held.tobytes(), 1)])], names=["part", "held"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits >> 3, dtype=np.uint8)
        for batch in batches:
            for x in batch.column(1):
                held |= np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(held.tobytes(), 1)])], names=["part", "held"])

    kind, out = "part int, held binary", np.zeros(1 << bits >> 3, dtype=np.uint8)
    some = names.select("name").mapInArrow(gather, kind).withColumn("part", (F.rand(1) * 16).cast("int")).repartition(16, "part").mapInArrow(join, kind)
    for row in some.toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row.held), dtype=np.uint8)
    return out


def _texts(docs: DataFrame, text: str, width: int, names: DataFrame) -> DataFrame:
    """(name, text): a text of each class of ``names``, and of few others,
    once from each task."""
    shipped, bits = docs.sparkSession.sparkContext.broadcast(_sieve(names)), SIEVE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), shipped.value
        for batch in batches:
            names, at = [], []
            for k, data in enumerate(encoded(batch.column(0))):
                s = set_of(data, width)
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                place = tie_of(name) & (1 << bits) - 1
                if held[place >> 3] >> (place & 7) & 1:
                    seen.add(name)
                    names.append(name)
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(at, pa.int64()))], names=["name", "text"])

    return docs.select(text).mapInArrow(tidy(run), "name binary, text string")


def _pieces(blocks: DataFrame, piece_bytes: int) -> tuple[DataFrame, bool]:
    """(name, n, block, bytes) with ``piece`` and ``pieces``, and whether any
    block has several.

    Pieces take classes in order of size: bytes are summed by size, and the
    classes of a size that reaches over several pieces are dealt out by name.
    """
    total = blocks.groupBy("block").agg(F.sum("bytes").alias("total")).filter(F.col("total") > piece_bytes)
    sizes = blocks.join(total, "block").groupBy("block", "n").agg(F.sum("bytes").alias("own"), F.max("total").alias("total"))
    upto = F.sum("own").over(Window.partitionBy("block").orderBy("n"))
    place = lambda at: F.floor(at / piece_bytes).cast("int")
    cut = sizes.select("block", "n", place(upto - F.col("own")).alias("low"), place(upto - 1).alias("high"), (place(F.col("total") - 1) + 1).alias("count"))
    # written down, so that the join below can be split where one size of a block has very many classes
    cut = stored(cut, "jaccard-sizes")
    if cut.isEmpty():
        return blocks.withColumns({"piece": F.lit(0), "pieces": F.lit(1)}), False
    dealt = F.col("low") + F.pmod(F.xxhash64("name"), (F.col("high") - F.col("low") + 1).cast("long")).cast("int")
    return blocks.join(cut, ["block", "n"], "left").select(*blocks.columns, F.coalesce(dealt, F.lit(0)).alias("piece"), F.coalesce("count", F.lit(1)).alias("pieces")), True


def _meetings(found: DataFrame, links: DataFrame, docs: DataFrame, text: str, width: int, percent: int, piece_bytes: int) -> DataFrame | None:
    """(a, b): links between the pieces of blocks; None where no class lies
    outside the largest component of its block.

    found: the classes of blocks of several pieces; links: components within
    the pieces.
    """
    rooted = stored(found.join(links.toDF("name", "root"), "name", "left").withColumn("root", F.coalesce("root", "name")), "jaccard-rooted")
    largest = rooted.groupBy("block", "root").agg(F.count(F.lit(1)).alias("count")).groupBy("block").agg(F.max(F.struct("count", "root"))["root"].alias("largest"))
    largest = stored(largest, "jaccard-largest")
    rooted = rooted.join(largest, "block").withColumn("outside", F.col("root") != F.col("largest")).drop("largest")
    spans = rooted.groupBy("block", "piece", "pieces").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum(F.when(F.col("outside"), F.col("bytes"))).alias("out"), F.min(F.when(F.col("outside"), F.col("n"))).alias("out_low"), F.max(F.when(F.col("outside"), F.col("n"))).alias("out_high"))
    spans = stored(spans, "jaccard-spans")
    # those outside, in order of size, make as many lots as they have bytes of pieces
    outer = spans.filter("out > 0").withColumn("upto", F.sum("out").over(Window.partitionBy("block").orderBy("piece")))
    outer = outer.select("block", "piece", F.floor((F.col("upto") - F.col("out")) / piece_bytes).cast("int").alias("lot"), "out_low", "out_high")
    outer = stored(outer, "jaccard-outside")
    if outer.isEmpty():
        return None
    lots = outer.groupBy("block", F.col("lot").alias("first")).agg(F.min("out_low").alias("out_low"), F.max("out_high").alias("out_high"))
    # lots send themselves and all pieces once a lot; where they are many, every two pieces are less
    count = spans.groupBy("block").agg(F.max("pieces").alias("pieces")).join(outer.groupBy("block").agg((F.max("lot") + 1).alias("lots")), "block")
    chosen = stored(count.select("block", (2 * F.col("lots") < F.col("pieces") - 1).alias("by_lot")), "jaccard-choice")
    spans = spans.join(chosen, "block")
    right = spans.select("block", "by_lot", F.col("piece").alias("second"), "low", "high")
    near = (100 * F.col("out_high") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("out_low"))
    left = spans.select("block", F.col("piece").alias("first"), F.col("low").alias("out_low"), F.col("high").alias("out_high"))
    meet = right.filter("by_lot").join(lots, "block").union(right.filter("not by_lot").join(left, "block").filter("first < second"))
    meet = stored(meet.filter(near).select("block", "first", "second", "by_lot"), "jaccard-meetings")
    rooted = rooted.join(chosen, "block").withColumn("outside", F.col("outside") & F.col("by_lot")).drop("by_lot")
    columns = ["block", "first", "second", "name", "root", "piece", "outside"]
    inner = rooted.join(meet.withColumn("piece", F.col("second")), ["block", "piece"])
    others = rooted.filter("outside").join(outer.select("block", "piece", F.col("lot").alias("first")), ["block", "piece"]).join(meet.filter("by_lot"), ["block", "first"])
    pairs = rooted.join(meet.filter("not by_lot").withColumn("piece", F.col("first")), ["block", "piece"])
    tasks = inner.select(*columns).union(others.select(*columns)).union(pairs.select(*columns))
    return _joined(tasks.join(_texts(docs, text, width, found), "name"), width, percent)


def linked_classes(docs: DataFrame, known: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, counter_bits: int = COUNTER_BITS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(node, root): classes that link, directly or not, with a smaller one.

    ``known``: ``classes`` of the documents.
    """
    ties = components(_ties(docs, known, text, width, percent, counter_bits), "jaccard-ties")
    blocks = ties.union(ties.select("root", "root").distinct()).toDF("__tie", "block")
    sizes = known.groupBy(F.col("__class").alias("name")).agg(F.max("__n").alias("n"), F.max("__tie").alias("__tie"))
    # a word is about seven bytes
    blocks = stored(blocks.join(sizes, "__tie").drop("__tie").withColumn("bytes", 7 * F.col("n") + 64), "jaccard-blocks")
    placed, several = _pieces(blocks, piece_bytes)
    first = F.array("piece")
    if several:
        spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "name"), n)
        pivot = (F.col("pieces") > 1) & (spread(1, F.col("pieces").cast("long")) == 0) & (spread(2, F.lit(1 << 20)) < int(PIVOTS * (1 << 20)))
        first = F.when(pivot, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(first)
    tasks = placed.select("block", F.explode(first).alias("first"), F.lit(None).cast("int").alias("second"), "name", F.lit(None).cast("binary").alias("root"), "piece", F.lit(False).alias("outside"))
    links = components(_joined(tasks.join(_texts(docs, text, width, blocks), "name"), width, percent), "jaccard-links")
    if several and (more := _meetings(placed.filter("pieces > 1"), links, docs, text, width, percent, piece_bytes)) is not None:
        links = components(links.toDF("a", "b").union(more), "jaccard-meetings")
    return links


def grouped(docs: DataFrame, keys: list[str], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document its ``keys``, n_shingles and component_id.

    ``component_id``: the smallest ``key`` of the documents reachable by
    links, its own included. Documents without words, null texts among them,
    link with nothing. Null keys count for no component; documents with equal
    keys keep their rows. An empty table stays empty.
    """
    width, percent = options.get("width", WIDTH), options.get("percent", PERCENT)
    known = stored(classes(docs, keys, text, width), "jaccard-classes")
    filled = known.filter("__n > 0")
    roots = linked_classes(docs, filled, text, width=width, percent=percent, **{k: v for k, v in options.items() if k not in ("width", "percent")})
    names = filled.groupBy("__class").agg(F.min(key).alias("least"))
    names = stored(names.join(roots.withColumnRenamed("node", "__class"), "__class", "left").withColumn("root", F.coalesce("root", "__class")), "jaccard-names")
    # written down, so that Spark can split a component with very many classes
    least = stored(names.groupBy("root").agg(F.min("least").alias("__component")), "jaccard-least")
    names = names.join(least, "root").select("__class", "__component")
    out = known.withColumn("__class", F.when(F.col("__n") > 0, F.col("__class"))).join(names, "__class", "left")
    return out.select(*keys, F.col("__n").alias("n_shingles"), F.when(F.col("__n") > 0, F.col("__component")).otherwise(F.col(key)).alias("component_id"))
