import zlib
from collections import defaultdict

import numpy as np

from strandline.llm import sharding
from tests.llm.samples import SCHEMA, frame


def check(docs, got, shards):
    rows = docs.collect()
    assert sorted(map(repr, [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows])) == sorted(map(repr, [(r.doc_id, r["size"], r.text_crc32) for r in got]))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1


def test_law_holds_and_order_is_repeatable(spark):
    docs = frame(spark)
    for size in (1 << 25, 2000):
        got = sharding.report(sharding.sharded(docs, 16, bucket_bytes=size)).collect()
        check(docs, got, 16)
        again = sharding.report(sharding.sharded(docs.repartition(3), 16, bucket_bytes=size)).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sorted((r.shard, r.slot) for r in got) != [(r.shard, r.slot) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))]


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "x", None, None, None)] * 5 + [(3, None, "en", "a", 1)] * 4 + [(3, "y", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(docs, sharding.report(sharding.sharded(docs, 16)).collect(), 16)
    assert sharding.report(sharding.sharded(spark.createDataFrame([], SCHEMA), 16)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5)], "doc_id long, text string, shard string, slot int")
    got = sharding.sharded(docs, 2).collect()
    assert [(r.doc_id, r.text, r.slot) for r in got] == [(1, "a", 0)]
    docs = spark.createDataFrame([(1, "a", 3, 4), (2, "b", 3, 4)], "doc_id long, text string, __bucket int, __first long")
    assert sorted((r.doc_id, r.text) for r in sharding.sharded(docs, 2).collect()) == [(1, "a"), (2, "b")]


def test_order_is_the_permutation_of_each_bucket(spark):
    """Against buckets filled and shuffled by hand, in order of their number."""
    rows = [(k, f"text {k}" * (k % 7), None, None, None) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.sharded(docs, 7, bucket_bytes=1500).select("doc_id", "text", "__bucket", "shard", "slot").collect()
    buckets = defaultdict(list)
    for r in got:
        buckets[r["__bucket"]].append((r.doc_id, r.text))
    expected = []
    for b in sorted(buckets):
        own = sorted(buckets[b])
        expected += [own[i] for i in np.random.Generator(np.random.PCG64([7, b])).permutation(len(own))]
    assert len(buckets) > 5 and [(r.doc_id, r.text) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == expected


def test_equal_rows_without_id_fill_several_buckets(spark):
    docs = spark.createDataFrame([(None, "same " * 20, None, None, None)] * 400, SCHEMA)
    got = sharding.sharded(docs, 16, bucket_bytes=4000)
    assert got.select("__bucket").distinct().count() > 5
    check(docs, sharding.report(got).collect(), 16)
