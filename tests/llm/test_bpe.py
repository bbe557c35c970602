import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import bpe
from tests.llm.samples import SCHEMA, frame

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN, cache=50)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def same(own, theirs, text):
    ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
    assert ids == theirs.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_every_character(own, theirs):
    for c in range(0x110000):
        if c % 7 == 0 or c < 0x3000:
            if not 0xD800 <= c < 0xE000:
                same(own, theirs, "a1" + chr(c) + "b " + chr(c) + "2 " + chr(c))


def test_white_space_and_marks(own, theirs):
    rng = random.Random(3)
    for alphabet in ("aab  \n\tt'sé1 .,!日 ", " .,!a", "ab", "\u00a0 x\u2003.\x1c"):
        for _ in range(3000):
            same(own, theirs, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    same(own, theirs, text)


def test_very_long_matches(own, theirs):
    rng = random.Random(1)
    same(own, theirs, "".join(rng.choice("abcde") for _ in range(60_000)))
    same(own, theirs, "a" * 60_001)
    assert not any(own.queue.words) and not any(own.queue.buckets)


def expected(theirs, text):
    ids = np.array(theirs.encode_ordinary(text or ""), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_documents(spark, sf, theirs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), frame(spark)):
        got = bpe.digest_documents(docs, ["doc_id"], PATH, public_tokenizers.PATTERN).collect()
        assert sorted(map(tuple, got)) == sorted((r.doc_id, *expected(theirs, r.text)) for r in docs.collect())


def test_repeats_nulls_and_empty(spark, theirs):
    docs = spark.createDataFrame([(None, "a b", None, None, 0), (1, None, None, None, 0), (1, "<|endoftext|> x", None, None, 0), (1, "<|endoftext|> x", None, None, 0)], SCHEMA)
    rows = bpe.encode_documents(docs, ["doc_id"], PATH, public_tokenizers.PATTERN)
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in rows.collect()))) == sorted(map(repr, ((r.doc_id, theirs.encode_ordinary(r.text or "")) for r in docs.collect())))
    back = bpe.decode_documents(rows, ["doc_id"], PATH, public_tokenizers.PATTERN)
    assert sorted(r.text for r in back.collect()) == ["", "<|endoftext|> x", "<|endoftext|> x", "a b"]
    assert bpe.digest_documents(spark.createDataFrame([], SCHEMA), ["doc_id"], PATH, public_tokenizers.PATTERN).count() == 0
