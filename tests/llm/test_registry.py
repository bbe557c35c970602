"""The registered queries: their columns, and their SQL where there is some."""

import os

import duckdb
import pytest

from strandline.llm import registry

COLUMNS = {
    "op2_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op5_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_token_shards": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_host_reputation": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contracts(spark, sf, name):
    kinds = dict(registry.QUERIES[name](spark, sf).dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        path = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = registry.QUERIES[name](spark, folder)
    expected = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    at = [expected.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in expected.fetchall())
