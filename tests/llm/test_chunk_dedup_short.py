"""Copies shorter than 100 bytes are removed too."""

from strandline.llm import chunk_dedup
from tests.llm.samples import SCHEMA


def test_exact_copies_of_short_texts(spark):
    texts = ['token = "2abc3ff2" From reha', "tiny", "y", "a text of some sixty bytes, which is more than a single chunk"]
    assert max(map(len, texts)) < 100
    rows = [(10 * c + k, t, None, None, 0) for c in range(3) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in chunk_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, text, *_ in rows:
        r, n = got[doc_id], len(text)
        assert (r.text, r.n_repeated, r.n_removed) == ((text, n, 0) if doc_id < 10 else ("", n, n))
