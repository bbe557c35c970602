"""Coverage rows as a stream: shards that arrive as files.

An addition to what a batch run needs: bins are summed by chromosome and
window of positions while shards come in, and repeated rows of a shard that is
delivered twice are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.sources.readers import COVERAGE_SCHEMA


def coverage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New tab-separated shards of a folder, with the time they were read."""
    return spark.readStream.schema(COVERAGE_SCHEMA).option("sep", "\t").csv(folder).withColumn("read_at", F.current_timestamp())


def summed_bins(rows: DataFrame, width: int, late: str = "10 minutes") -> DataFrame:
    """Reads and fragments by (chr, cell of ``width``), each bin once.

    Bins are remembered for ``late`` after they were read.
    """
    once = rows.withWatermark("read_at", late).dropDuplicatesWithinWatermark(["chr", "start", "end"])
    return once.groupBy("chr", (F.floor(F.col("start") / width) * width).alias("cell")).agg(F.sum("tot_reads").alias("tot_reads"), F.sum("num_frags").alias("num_frags"), F.count(F.lit(1)).alias("bins"))


def start(spark: SparkSession, folder: str, name: str, checkpoint: str, width: int = 1_000_000) -> StreamingQuery:
    """Runs over what is there and ends; the totals are a table in memory."""
    totals = summed_bins(coverage_stream(spark, folder), width)
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; works on batches and streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, window)
    return rows.groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total")
