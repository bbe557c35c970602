import hashlib
import random
from collections import Counter

import numpy as np

from strandline.llm import suffix_dedup, suffix_sort
from tests.llm.samples import SCHEMA, awkward, frame


def brute(rows, length):
    datas = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(d[i : i + length] for _, d in datas for i in range(len(d) - length + 1))
    out = []
    for doc_id, d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(map(tuple, suffix_dedup.deduplicated(df, **options).collect()), key=repr)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = brute(docs.select("doc_id", "text").collect(), 200)
    assert got(docs) == expected
    assert got(docs, hot=1, block=2000) == expected


def test_awkward_rows_and_short_strings(spark):
    for length, kmer in ((50, 16), (200, 80), (24, 5), (200, 40)):
        assert got(frame(spark), length=length, kmer=kmer) == brute(awkward(), length)


def passages(seed=3):
    rng = random.Random(seed)
    letter = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [letter(rng.randint(150, 500)) for _ in range(6)] + ["xy" * 300, "z" * 700]
    rows = []
    for i in range(60):
        parts = [letter(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randint(50, len(p))], letter(rng.randint(0, 90))]
        rows.append((i, "".join(parts), None, None, 0))
    return rows


def test_overlapping_passages_and_runs(spark):
    rows = passages()
    for options in ({}, {"hot": 2}, {"block": 500}):
        assert got(spark.createDataFrame(rows, SCHEMA), **options) == brute(rows, 200)


def test_equal_rows_null_ids_and_empty(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(1, 400)) + "".join(random.Random(2).choice("mnop") for _ in range(300))
    rows = [(4, text, None, None, 0), (4, text, None, None, 0), (4, "q" + text[300:], None, None, 0), (None, text[350:], None, None, 0), (6, None, None, None, 0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 200)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    left = suffix_dedup.deduplicated(spark.createDataFrame([(1, "abc", None, None, 0)], SCHEMA), kept=True).first()
    assert left.kept == b"abc"


def test_null_ids_share_no_identity(spark, tmp_path):
    """Rows without id, two equal and one that shares nothing, from rows and
    from files, beside columns with the names of working columns."""
    rng = random.Random(9)
    one, other = ("".join(rng.choices("abcdefgh", k=320)) for _ in range(2))
    rows = [(None, one, "x", "y", 0), (None, other, "x", "y", 0), (1, one, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "__row", "source": "__file"})
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        assert got(table) == brute(rows, 200)
        assert sorted(r.n_removed for r in suffix_dedup.deduplicated(table).collect()) == [0, 320, 320]


def test_text_beyond_a_piece(spark):
    """Above a megabyte a text is taken in pieces: repeats across their cuts."""
    rng = random.Random(10)
    text = "".join(rng.choices("abcdefghijklmnop", k=2_300_000))
    rows = [(1, text, None, None, 0), (2, text[1_040_000:1_060_000], None, None, 0)]
    found = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (found[1].n_removed, found[1].n_spans, found[2].n_removed) == (20_000, 1, 20_000)


def test_cover_holds_every_difference():
    p = suffix_sort.PERIOD
    for i in range(p):
        for j in range(p):
            s = suffix_sort.SHIFT[i, j]
            assert (i + s) % p in suffix_sort.COVER and (j + s) % p in suffix_sort.COVER


def test_blockwise_order_equals_plain_sort():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 99, 3000), np.tile(rng.integers(97, 123, 300), 12), np.full(1500, 97), rng.integers(0, 256, 2000)):
        text = text.astype(np.uint8)
        data = text.tobytes()
        places = np.flatnonzero(rng.random(len(text) - 200) < 0.7)
        sorter = suffix_sort.Sorter(text, 200)
        order = np.concatenate(list(sorter.buckets(places, size=200)))
        strings = [data[i : i + 200] for i in order]
        assert strings == sorted(data[i : i + 200] for i in places)
        counts = Counter(strings)
        assert suffix_sort.repeated(text, places, 200, bucket=100).tolist() == [i for i in places if counts[data[i : i + 200]] > 1]
