"""Chromosomes and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import cumulative_offsets

#: Contigs of a coverage file that are used, but for the prefix chr.
PRIMARY = tuple(str(k) for k in range(1, 23)) + ("X", "Y", "MT")


def chromosome_number(name: Column) -> Column:
    """1 to 22, X 23, Y 24, with or without chr; 0 for any other name."""
    bare = F.upper(F.regexp_replace(name, "^(?i:chr)", ""))
    number = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.rlike("^([1-9]|1[0-9]|2[0-4])$"), bare.cast("int"))
    return F.coalesce(number, F.lit(0))


def chromosome_lengths(arms: DataFrame) -> DataFrame:
    """(chr, length, offset): lengths, and their sum before each chromosome."""
    ends = arms.groupBy("chr").agg(F.max("end").alias("length"))
    return cumulative_offsets(ends, "chr", "length", "offset")


def genome_position(df: DataFrame, lengths: DataFrame, place: str, name: str) -> DataFrame:
    """``df`` with the genome-wide position of ``place``; the lengths are a
    row for each chromosome."""
    return df.join(F.broadcast(lengths.select("chr", F.col("offset").alias("__offset"))), "chr", "left").withColumn(name, F.col("__offset") + F.col(place)).drop("__offset")


def chromosome_position(df: DataFrame, lengths: DataFrame, place: str) -> DataFrame:
    """The reverse: (chr, pos) of genome-wide positions."""
    table = lengths.select("chr", F.col("offset").alias("__from"), (F.col("offset") + F.col("length")).alias("__to"))
    met = df.join(F.broadcast(table), (F.col(place) >= F.col("__from")) & (F.col(place) < F.col("__to")))
    return met.withColumn("pos", F.col(place) - F.col("__from")).drop("__from", "__to")
