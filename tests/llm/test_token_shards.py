import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import shared, token_shards
from tests.llm.samples import SCHEMA, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)  # as it is, without settings


def expected(tokenizer, rows):
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        out.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    docs = frame(spark)
    for size in (1 << 26, 3000):
        made = token_shards.write_shards(docs, shared.folder(spark, "tokens"), PATH, 2, shard_bytes=size)
        got = token_shards.read_shards(made).collect()
        assert sorted(map(tuple, got)) == expected(tokenizer, docs.collect())
    assert made.count() > 3


def test_keyed_access_repeats_and_nulls(spark, tokenizer):
    rows = [(7, "b", None, None, None), (7, "b", None, None, None), (None, "n", None, None, None), (9, "<|endoftext|> \n  x", None, None, None)]
    made = token_shards.write_shards(spark.createDataFrame(rows, SCHEMA), shared.folder(spark, "tokens"), PATH, 2)
    shard = token_shards.Shard(made.first().path)
    whole = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert shard.document(7, 0).tolist() == shard.document(7, 1).tolist() == whole("b")
    assert shard.document(None).tolist() == whole("n") and shard.document(9).tolist() == whole("<|endoftext|> \n  x")
    assert shard.document(8) is None and shard.document(7, 2) is None


def test_empty_table(spark):
    made = token_shards.write_shards(spark.createDataFrame([], SCHEMA), shared.folder(spark, "tokens"), PATH, 2)
    assert made.isEmpty() and token_shards.read_shards(made).count() == 0


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, 20000)
    zero = np.zeros(len(keys), dtype=np.int64)
    hashes = token_shards.key_hashes(keys, zero, zero.astype(bool), 1)
    levels = token_shards.build_levels(hashes)
    assert sorted(token_shards.slots(hashes, levels).tolist()) == list(range(len(keys)))
    assert sum(map(len, levels)) < 5 * len(keys)


def test_segments_equal_the_library(tokenizer):
    own = token_shards.TextEncoder(PATH, cache=4)
    texts = ["a b  c\n d", " lead and trail ", "", "x" * 300 + " yy", "tab\tin it's <|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|>b c", "é 日本 a b c  d"]
    for _ in range(3):
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_keys_over_several_shards(spark, tokenizer):
    """By the manifest: each occurrence of a key whose rows fill shards."""
    rows = [(5, f"text {k} " * 30, None, None, None) for k in range(40)] + [(None, f"null {k} " * 20, None, None, None) for k in range(20)] + [(k, f"doc {k}", None, None, None) for k in range(6, 30)]
    made = token_shards.write_shards(spark.createDataFrame(rows, SCHEMA), shared.folder(spark, "tokens"), PATH, 2, shard_bytes=1500)
    assert made.filter("low <= 5 and high >= 5").count() > 1 and made.filter("nulls > 0").count() > 1
    whole = lambda t: (*tokenizer.encode(t, add_special_tokens=False).ids, 2)
    for key, n in ((5, 40), (None, 20)):
        found = {tuple(token_shards.document(made, key, k).tolist()) for k in range(n)}
        assert found == {whole(r[1]) for r in rows if r[0] == key}
        assert token_shards.document(made, key, n) is None
    assert tuple(token_shards.document(made, 17).tolist()) == whole("doc 17") and token_shards.document(made, 99) is None


def test_lookup_reads_no_more_of_a_larger_shard(tmp_path):
    read = {}
    for n in (10_000, 1_000_000):
        path, keys = str(tmp_path / str(n)), np.arange(n, dtype=np.int64) * 3
        token_shards.write_shard(path, np.arange(2 * n, dtype="<u4"), np.full(n, 2), keys, np.zeros(n, dtype=bool))
        shard, sizes = token_shards.Shard(path), []
        plain = shard._bytes
        shard._bytes = lambda at, size: sizes.append(size) or plain(at, size)
        for k in range(0, n, n // 100):
            assert shard.document(3 * k).tolist() == [2 * k, 2 * k + 1]
        assert shard.document(1) is None
        read[n] = sum(sizes)
    assert read[1_000_000] < 1.5 * read[10_000]
