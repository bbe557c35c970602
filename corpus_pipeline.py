"""Corpus preparation: documents through five operators, stage by stage.

Each stage works on all that its predecessor kept, which is written as
Parquet and read again in between. All but the last return the columns of
``documents``; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontamination, jaccard_join, pseudonyms, quality_rules
from strandline.llm.registry import PSEUDONYM_KEY, read
from strandline.llm.shared import named_rows, stored

#: Near-duplicates share four fifths of their runs of five words; the operator's
#: defaults are those of the op10 query.
NEAR_WIDTH, NEAR_PERCENT = 5, 80

#: The columns of ``documents`` that stages work with.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with columns beside OWN renamed c0, c1, ..., so that none has
    the name of a working column; ``toDF(*docs.columns)`` names them back."""
    return docs.toDF(*[c if c in OWN else f"c{i}" for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds.

    Null and empty texts have no words and go. Null languages and sources are
    groups of their own. Equal rows are judged alike; rows with equal ids
    each by their own text. Texts may have any length. An empty table stays
    empty. Columns of any name pass through.
    """
    rows = _aside(docs)
    judged = quality_rules.judge(quality_rules.measures(rows, rows.columns))
    return judged.filter("kept").select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id.

    Null ids count as the smallest, and of rows with equal ids one stays.
    Documents without words, null texts among them, all stay. Texts may have
    any length. An empty table stays empty. Columns of any name pass through.
    Rows are named by their files and places there, without a copy of them.
    """
    rows = _aside(docs)
    placed = named_rows(rows, **{c: F.col(c) for c in rows.columns})
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "__file", "__row")
    keyed = placed.select(order.alias("order"), "text")
    groups = jaccard_join.grouped(keyed, ["order"], key="order", width=NEAR_WIDTH, percent=NEAR_PERCENT)
    first = groups.filter((F.col("component_id") == F.col("order")) | (F.col("n_shingles") == 0)).select("order.__file", "order.__row")
    return placed.join(first.hint("shuffle_hash"), ["__file", "__row"], "left_semi").select(*rows.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item.

    Documents without words, null texts among them, all stay, and so do all
    where no item has a word. Rows are judged one by one, so repeated rows
    and ids are alike. Texts may have any length. An empty table stays empty.
    Columns of any name pass through.
    """
    return decontamination.decontaminated(_aside(docs), read(spark, sf_dir, "benchmark")).toDF(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced in the texts; n_chars follows a changed text.

    Null and empty texts stay as they are, with their n_chars. Rows are
    changed one by one, equal texts alike. Texts may have any length. An
    empty table stays empty. Columns of any name pass through.
    """
    rows = _aside(docs)
    out = pseudonyms.pseudonymise(rows.withColumn("before", F.col("text")), PSEUDONYM_KEY)
    changed = F.when(F.col("text") != F.col("before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*rows.columns).toDF(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and their decoding.

    Null texts are empty and have no ids. Every row gives a row, repeated
    ones too. Texts may have any length. An empty table gives an empty table.
    Columns other than doc_id, lang and source are left out.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, ["doc_id", "lang", "source"], path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pseudonyms", pseudonymise),
    ("byte-level BPE", tokenise),
]
#: SQL expresses no stage but the first; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
