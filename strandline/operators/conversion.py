"""Inputs of other tools, made from counts and simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import ordered
from strandline.operators.scoring import binomial_counts


def known_sites(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls at listed sites (chr, pos), once each."""
    return calls.join(sites.select("chr", "pos").distinct(), ["chr", "pos"])


def substitutions(calls: DataFrame) -> DataFrame:
    """Single-base changes that are not 1|1."""
    return calls.filter((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("hap") != "1|1"))


def without_contigs(rows: DataFrame, excluded: list[str], column: str = "contig") -> DataFrame:
    return rows.filter(~F.col(column).isin(*excluded)) if excluded else rows


def pileup_counts(tumour: DataFrame, normal: DataFrame) -> DataFrame:
    """One row a site with both samples' counts, under the pileup names.

    Sites without tumour counts keep zeros.
    """
    t = tumour.select("chr", "pos", F.col("ref_count").alias("__tr"), F.col("alt_count").alias("__ta"))
    rows = normal.join(t, ["chr", "pos"], "left")
    zero = F.lit(0).cast("long")
    named = {"File1R": "ref_count", "File1A": "alt_count", "File2R": "__tr", "File2A": "__ta"}
    counts = [F.coalesce(F.round(F.col(c)).cast("long"), zero).alias(n) for n, c in named.items()]
    empty = [zero.alias(n) for n in ("File1E", "File1D", "File2E", "File2D")]
    return rows.select(F.col("chr").alias("Chromosome"), F.col("pos").alias("Position"), F.col("ref").alias("Ref"), F.col("alt").alias("Alt"), *counts, *empty)


def refilled_counts(sites: DataFrame, simulated: DataFrame, bins: DataFrame) -> DataFrame:
    """Simulated counts at all sites; sites that were not simulated take their
    bin's simulated depth, all of it reference. bins: (bin_id, depth)."""
    s = simulated.select("chr", "pos", F.col("ref_count").alias("__r"), F.col("alt_count").alias("__a"))
    met = sites.join(s, ["chr", "pos"], "left").join(bins.select("bin_id", F.col("depth").alias("__d")), "bin_id", "left")
    zero = F.lit(0.0)
    return met.select(*sites.columns, F.coalesce("__r", "__d", zero).alias("ref_count"), F.coalesce("__a", zero).alias("alt_count"))


def allelic_count_table(counts: DataFrame, header: DataFrame) -> DataFrame:
    """Lines of an allelic-count file: the header's, then the rows in order.

    Sites come once.
    """
    rows = counts.dropDuplicates(["chr", "pos"])
    text = F.concat_ws("\t", F.col("chr").cast("string"), F.col("pos").cast("string"), F.round("ref_count").cast("long").cast("string"), F.round("alt_count").cast("long").cast("string"), "ref", "alt")
    names = F.lit("\t".join(["CONTIG", "POSITION", "REF_COUNT", "ALT_COUNT", "REF_NUCLEOTIDE", "ALT_NUCLEOTIDE"]))
    top = header.select(F.lit(0).alias("__o"), F.lit(0).alias("__c"), F.monotonically_increasing_id().alias("__p"), "value")
    line = header.sparkSession.range(1).select(F.lit(1).alias("__o"), F.lit(0).alias("__c"), F.lit(0).cast("long").alias("__p"), names.alias("value"))
    body = rows.select(F.lit(2).alias("__o"), F.col("chr").cast("int").alias("__c"), F.col("pos").alias("__p"), text.alias("value"))
    return top.union(line).union(body).orderBy("__o", "__c", "__p").select("value")


def replaced_counts(metadata: DataFrame, counts: DataFrame) -> DataFrame:
    """Fragment counts with new values; each interval must have one."""
    out = metadata.drop("count").join(counts.select("contig", "start", "end", "count"), ["contig", "start", "end"], "left")
    return out.withColumn("count", F.when(F.col("count").isNull(), F.raise_error(F.lit("an interval has no count"))).otherwise(F.col("count")))


def dummy_normal(sites: DataFrame, seed: int, depth: int = 30) -> DataFrame:
    """Counts of a diploid sample of one depth at heterozygous sites."""
    rows = sites.withColumn("__d", F.lit(depth)).withColumn("__p", F.lit(0.5))
    out = binomial_counts(rows, ["chr", "pos"], "__d", "__p", seed, "alt_count")
    return out.withColumn("ref_count", F.col("__d") - F.col("alt_count")).drop("__d", "__p")


def threshold_intervals(thresholds: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chr, start, end): from each threshold to the next, the last to the
    chromosome's end."""
    w = Window.partitionBy("chr").orderBy("threshold")
    ends = thresholds.join(F.broadcast(lengths.select("chr", "length")), "chr")
    return ends.select("chr", F.col("threshold").alias("start"), F.coalesce(F.lead("threshold").over(w), F.col("length")).alias("end"))


def interval_totals(intervals: DataFrame, totals: DataFrame) -> DataFrame:
    """Intervals with the counts of the same place in order in ``totals``
    (chr, k, ...), where files go by position alone."""
    w = Window.partitionBy("chr").orderBy("start")
    return intervals.withColumn("k", F.row_number().over(w) - 1).join(totals, ["chr", "k"]).drop("k")


def sample_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample").agg(F.sum("reads").alias("reads"))


def log_ratio(tumour: Column, normal: Column) -> Column:
    return F.log2(tumour / normal)


def clonal_threshold(segments: DataFrame, score: str, weight: str, least_bend: float = 0.05) -> float | None:
    """Score at the elbow of the weight's curve; the median score where the
    curve hardly bends. None without segments."""
    top = ordered.elbow(segments, score, weight).agg(F.min(F.struct((-F.col("bend")).alias("b"), F.col(score).alias("s")))["b"].alias("b"), F.min(F.struct((-F.col("bend")).alias("b"), F.col(score).alias("s")))["s"].alias("s")).first()
    if top is None or top["s"] is None:
        return None
    if -top["b"] >= least_bend:
        return float(top["s"])
    return float(segments.agg(F.median(score)).first()[0])


def ratio_bias(segments: DataFrame) -> float | None:
    """The older estimate of reference bias: mean ratio of reference to
    alternate counts, weighted by segments' evidence."""
    row = segments.agg((F.sum(-F.col("loglik") * F.col("alt") / F.col("ref")) / F.sum(-F.col("loglik"))).alias("b")).first()
    return None if row["b"] is None else float(row["b"])


def best_of_results(results: DataFrame) -> DataFrame:
    """Mean score by purity and method, of results named in their paths."""
    named = results.withColumn("purity", F.regexp_extract("path", r"_(0\.\d+)_", 1).cast("double")).withColumn("method", F.regexp_extract("path", r"([a-z]+)\.(?:tsv|parquet)$", 1))
    return named.groupBy("purity", "method").agg(F.avg("mad_score").alias("mad_score"), F.count(F.lit(1)).alias("n"))
