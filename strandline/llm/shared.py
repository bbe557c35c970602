"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder
    takes its place and is set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = os.path.join(tempfile.gettempdir(), "strandline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    # with its file system, so that what does not go through Spark's readers finds it too
    path = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole}/strandline/{name}-{uuid.uuid4().hex}"


#: Spark's own removal of shuffle files at the end of a query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there.

    The shuffle files of the write go with its end. Else they stay until the
    driver happens to collect its garbage, which in a long run it seldom does,
    and the disk has to hold the shuffles of all steps at once.
    """
    path, conf = folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.parquet(path)


def _scanned(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of its files."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    named = node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation")
    # a column of that name hides the files' own
    return named and "_metadata" not in [x.lower() for x in node.schema().fieldNames()]


def named_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of ``docs``, with ``__file`` and ``__row``, which name each
    row alike in every scan: a hash of its file's path and its place there.

    Where ``docs`` is more than a scan of files, the columns are written to
    the shared folder first, and those files name the rows.
    """
    name = F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    chosen = [c.alias(n) for n, c in columns.items()]
    if _scanned(docs):
        return docs.select(*name, *chosen)
    return stored(docs.select(*chosen), "named-rows").select(*name, *columns)
