"""Global shuffle into shards: an external shuffle of two passes.

Pass one scatters every record, by a seeded hash of its id and text, into as
many buckets as it takes for a bucket to fit in memory. Pass two puts each
bucket in an order that does not depend on how it arrived, shuffles it by
Fisher-Yates under a seed of its own, and writes it. Bucket after bucket, the
records stand in one random permutation; shards are equal stretches of it, so
their row counts are at most one apart and a bucket meets few shards.

Counts of buckets are summed up in two levels, as tables; where a bucket
begins comes to its task as one more row of the shuffle, so neither the
driver nor a task's closure holds anything of all buckets.

The same seed gives the same shards on any cluster, and a lost task repeats
exactly what it did before. Only records without id, which may be equal by
the million, are scattered by their place in the files as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandline.llm.batches import small_batches, tidy
from strandline.llm.shared import folder, named_rows, stored

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 32 << 20
#: Buckets whose counts are summed in one group before groups are summed.
GROUP = 1024
#: Columns that the result brings; those of ``docs`` with these names go.
OWN = ("shard", "slot", "__bucket", "__first")


def scattered(docs: DataFrame, key: str, text: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Pass one: ``docs`` with ``__bucket`` and ``__first``, dealt out by
    bucket, and their number. One row of each bucket has no record and in
    ``__first`` how many records the buckets before hold."""
    columns = docs.columns
    size, total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + 64 * F.count(F.lit(1)), F.count(F.lit(1))).first()
    buckets = int(size // bucket_bytes + 1)
    named = named_rows(docs, **{c: F.col(c) for c in columns})
    own = F.when(F.col(key).isNull(), F.xxhash64("__file", "__row"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text), own), F.lit(buckets)).cast("int")
    rows = named.select(*columns, bucket.alias("__bucket"), F.lit(None).cast("long").alias("__first"))
    counts = stored(rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    group = F.floor(F.col("__bucket") / GROUP).alias("group")
    before = lambda w, order: F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy(group).agg(F.sum("n").alias("n")).select("group", before(Window.partitionBy(F.lit(0)), "group").alias("above"))
    first = counts.select("*", group).withColumn("within", before(Window.partitionBy("group"), "__bucket")).join(groups, "group")
    marks = first.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes], "__bucket", (F.col("above") + F.col("within")).alias("__first"))
    return rows.union(marks).repartitionById(buckets, "__bucket"), int(total)


def permuted(docs: DataFrame, shards: int, seed: int = 7, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``__bucket``, ``shard`` and ``slot`` (their place in it).

    Null ids and texts hash and sort as nulls; equal rows are
    interchangeable. Texts may be of any length: a bucket holds a long one
    whole. An empty table stays empty. Columns of ``docs`` named as one of
    OWN are replaced.
    """
    kept = small_batches(docs).drop(*OWN)
    rows, total = scattered(kept, key, text, seed, bucket_bytes)
    bounds = np.array([s * total // shards for s in range(shards + 1)], dtype=np.int64)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], None
        for batch in batches:
            begins = batch.column(names.index("__first"))
            if begins.null_count < len(begins):
                first = pc.max(begins).as_py()
                batch = batch.filter(pc.is_null(begins))
            if batch.num_rows:
                held.append(batch)
        if not held:
            return
        bucket = held[0].column(names.index("__bucket"))[0].as_py()
        table = pa.Table.from_batches(held).drop_columns("__first")
        order = pc.sort_indices(table, sort_keys=[(key, "ascending"), (text, "ascending")]).to_numpy()
        order = order[np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(order))]
        place = first + np.arange(len(order))
        shard = np.searchsorted(bounds, place, side="right") - 1
        for at in range(0, len(order), 2000):
            part = table.take(pa.array(order[at : at + 2000])).combine_chunks()
            s = shard[at : at + 2000]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
            columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.int32()), pa.array(place[at : at + 2000] - bounds[s], pa.int64())], names=[*part.column_names, "shard", "slot"])

    kept_fields = [T.StructField(f.name, f.dataType) for f in kept.schema.fields]
    made = [T.StructField("__bucket", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    return rows.mapInArrow(tidy(run), T.StructType([*kept_fields, *made]))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Pass two written: Parquet, a folder for each shard, rows in slot order."""
    rows = permuted(docs, shards, **options)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, shards: int, **options) -> DataFrame:
    """What ``write_shards`` wrote to the shared folder, read back."""
    path = folder(docs.sparkSession, "shards")
    write_shards(docs, path, shards, **options)
    own = [T.StructField("__bucket", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    return docs.sparkSession.read.schema(T.StructType([*docs.drop(*OWN).schema.fields, *own])).parquet(path)


def report(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of each record: size, checksum and where it went."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return rows.select(
        key, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("__bucket").alias("bucket"),
    )
