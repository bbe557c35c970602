"""The pipeline against brute-force versions of its stages, one after another."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from strandline.llm import bpe, pseudonyms, quality_rules
from strandline.llm.registry import PSEUDONYM_KEY
from strandline.llm.shared import stored
from tests.llm import test_decontamination, test_jaccard_join, test_quality_rules
from tests.llm.samples import SCHEMA


def by_hand(spark, rows, items):
    """Rows (doc_id, text, lang, source, n_chars) that come out, tokenised."""
    judged = test_quality_rules.brute(rows)
    kept = {r[0] for r in judged if r[-1]}
    rows = [r for r in rows if r[0] in kept]
    groups = {r[0]: r[2] for r in test_jaccard_join.brute(rows)}
    sizes = {r[0]: r[1] for r in test_jaccard_join.brute(rows)}
    rows = [r for r in rows if groups[r[0]] == r[0] or not sizes[r[0]]]
    dirty = {r[0] for r in test_decontamination.brute(rows, items) if r[-1]}
    rows = [r for r in rows if r[0] not in dirty]
    # the stage is tested against its own plain version elsewhere
    texts = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, SCHEMA), PSEUDONYM_KEY).collect()}
    own = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    return sorted((d, theirs.encode_ordinary(t or "")) for d, t in texts.items())


def test_run_equals_stages_by_hand(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    got = corpus_pipeline.run(spark, sf)
    expected = by_hand(spark, docs, items)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == expected
    assert 0.5 * len(docs) < len(expected) < len(docs)


def test_stages_keep_columns_and_awkward_rows(spark, sf):
    text = "one two three four five six seven eight nine ten " + " ".join(f"word{k}" for k in range(40))
    rows = [(3, text, "en", "s", 1), (3, text, "en", "s", 1), (1, text.upper(), None, None, None), (None, text + " more", "en", "s", 2), (7, None, "en", "s", None), (8, "", None, None, 0), (9, "a 4111111111111111 b", "de", "s", 20)]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, stored(docs, "in"), sf), "out")
            assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes), name
    by_stage = {n: stored(f(spark, stored(spark.createDataFrame(rows, SCHEMA), "in"), sf), "out").collect() for n, f in corpus_pipeline.STAGES}
    assert len(by_stage["byte-level BPE"]) == len(by_stage["pseudonyms"]) == len(rows)
    near = by_stage["n-gram Jaccard join"]
    assert sorted(map(repr, (r.doc_id for r in near))) == ["7", "8", "9", "None"]  # null is the smallest id
    moved = next(r for r in by_stage["pseudonyms"] if r.doc_id == 9)
    assert re.fullmatch(r"a 4\d{15} b", moved.text) and moved.text != rows[-1][1] and moved.n_chars == 20


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "pseudonyms", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None and quality_rules.WINDOW == 8
