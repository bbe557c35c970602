"""What the near-duplicate stage leaves on disk beside its results."""

import time

import corpus_pipeline
from pyspark.sql import functions as F

from strandline.llm import components, jaccard_join, shared
from strandline.llm.shared import stored


def shuffles(spark):
    """Shuffle files of the session."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().name())
    return {x for x in names if x.startswith("shuffle_")}


def left(spark, before):
    """New shuffle files; Spark removes them in the background."""
    for _ in range(50):
        if not (now := shuffles(spark) - before):
            break
        time.sleep(0.1)
    return now


def test_stored_leaves_no_shuffle_files(spark):
    # held, so that no garbage collection removes them
    df = spark.range(0, 10_000, 1, 4).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffles(spark)
    out = stored(df, "disk")
    assert not left(spark, before)
    assert out.count() == stored(df, "disk").count() == 7
    assert spark.conf.get(shared._CLEANUP, None) is None


def test_stage_copies_no_texts_and_keeps_no_shuffles(spark, sf, monkeypatch):
    written, held = {}, []

    def watched(df, name):
        held.append(df)
        written[name] = df.columns
        before = shuffles(spark)
        out = stored(df, name)
        written[name, "left"] = left(spark, before)
        return out

    for module in (jaccard_join, components, shared, corpus_pipeline):
        monkeypatch.setattr(module, "stored", watched)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.near_duplicates(spark, docs, sf).count() < docs.count()
    assert "jaccard-pairs" in written and "jaccard-counts" in written
    assert not [k for k, v in written.items() if "text" in v]
    assert not [k for k, v in written.items() if k[1] == "left" and v]


def test_stage_passes_a_column_named_as_the_files_own(spark, sf):
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}", k) for k in (1, 2)] + [(3, "a1 b1 c1 d1 e1 f1", 3)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, _metadata int"), "disk")
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[:2]
