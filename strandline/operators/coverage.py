"""Coverage bins: cleaning, covariates, assignment to allelic segments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.genome import PRIMARY, chromosome_number
from strandline.operators import intervals, ordered
from strandline.operators.aggregates import log_standardise, standardise
from strandline.operators.regression import negative_binomial_outliers


def clean_bins(bins: DataFrame, most_z: float = 3.0) -> DataFrame:
    """Bins of primary contigs with reads and fragments, whose share of failed
    reads is not out of line, with ``midpoint`` and ``fragcorr``.

    fragcorr: coverage over the mean fragment length of all bins kept,
    rounded half to even; bins with none are dropped. The share's mean and
    deviation, and the mean length, are single rows read first.
    """
    name = F.regexp_replace("chr", "^chr", "")
    named = F.when(name == "M", "MT").otherwise(name)
    rows = bins.filter(named.isin(*PRIMARY)).withColumn("chr", chromosome_number(named)).filter("chr > 0 and tot_reads > 0 and num_frags > 0")
    rows = standardise(rows.withColumn("__fail", F.col("fail_reads") / F.col("tot_reads")), ["__fail"])
    rows = rows.filter(F.coalesce("__fail_z", F.lit(0.0)) < most_z).drop("__fail", "__fail_z")
    mean = rows.agg(F.avg("mean_frag_len")).first()[0]
    rows = rows.withColumn("midpoint", F.floor((F.col("start") + F.col("end")) / 2)).withColumn("fragcorr", F.bround(F.col("covcorr") / F.lit(mean or 1.0)))
    return rows.filter("fragcorr > 0")


def fragment_lengths(bins: DataFrame) -> DataFrame:
    """Bins with fragment lengths, and C_frag_len, C_frag_len11: their means,
    weighted by fragments, centred over 5 and 11 bins of a chromosome.

    Windows end with the chromosome, which keeps chromosomes apart and lets
    them run in parallel.
    """
    rows = bins.filter("mean_frag_len > 0 and std_frag_len > 0")
    for width in (5, 11):
        rows = ordered.moving_weighted_mean(rows, ["chr"], ["start"], "mean_frag_len", "num_frags", width, f"C_frag_len{'' if width == 5 else width}")
    return rows


def join_track(bins: DataFrame, track: DataFrame, signals: list[str], width: int = 50_000) -> DataFrame:
    """Bins with the signals of the track's interval that holds their midpoint
    (null where none does; of several the one that starts first)."""
    ids = ["chr", "start", "end"]
    named = track.select("chr", F.col("start").alias("__ts"), F.col("end").alias("__te"), *signals)
    met = intervals.point_in_interval(bins.select(*ids, "midpoint"), named, ["chr"], "midpoint", "__ts", "__te", width)
    first = met.groupBy(*ids).agg(F.min(F.struct("__ts", *signals)).alias("t")).select(*ids, *[F.col(f"t.{s}").alias(s) for s in signals])
    return bins.join(first, ids, "left")


def join_normal(bins: DataFrame, normal: DataFrame) -> DataFrame:
    """With the normal sample's columns, suffixed _N, by bin."""
    ids = ["chr", "start", "end"]
    return bins.join(normal.select(*ids, *[F.col(c).alias(f"{c}_N") for c in normal.columns if c not in ids]), ids, "left")


def scale_covariates(bins: DataFrame, plain: list[str], logged: list[str], square_gc: bool = True) -> DataFrame:
    """C_*_z of plain covariates and C_*_lz of logged ones; columns without
    any value are dropped first. The square of C_GC_z joins as C_GC2_z."""
    there = bins.agg(*[F.count(c).alias(c) for c in [*plain, *logged]]).first() if plain or logged else {}
    plain, logged = [c for c in plain if there[c]], [c for c in logged if there[c]]
    out = log_standardise(standardise(bins, plain), logged)
    if square_gc and "C_GC" in plain:
        out = out.withColumn("C_GC2_z", F.col("C_GC_z") * F.col("C_GC_z"))
    return out


def covariate_columns(df: DataFrame) -> list[str]:
    """Scaled covariates, by their names."""
    return [c for c in df.columns if re.match(r"C_.*_l?z$", c)]


def filter_bins(bins: DataFrame, segment: str = "seg_idx", most: float = 6.0, least_bins: int = 5) -> DataFrame:
    """Bins with all covariates within ``most`` deviations, no count outlier,
    in segments of ``least_bins`` or more."""
    rows = negative_binomial_outliers(bins, "fragcorr").filter("not nb_outlier").drop("nb_outlier")
    for c in covariate_columns(rows):
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < most))
    n = F.count(F.lit(1)).over(Window.partitionBy(segment))
    return rows.withColumn("__n", n).filter(F.col("__n") >= least_bins).drop("__n")


def site_bins(sites: DataFrame, bins: DataFrame, pad: int = 300, width: int = 10_000) -> DataFrame:
    """Sites with ``bin_id`` of the bin that holds them, else of one that does
    when widened by ``pad``, else -1."""
    found = intervals.padded_interval(sites.select("snp_id", "chr", "pos"), bins.select("chr", "start", "end", "bin_id"), ["chr"], "pos", "start", "end", "bin_id", width, pad, ["snp_id"])
    return sites.join(found, "snp_id")


def assign_segments(bins: DataFrame, sites: DataFrame) -> DataFrame:
    """Bins with seg_idx, allelic_cluster and summed counts of their sites.

    sites: (bin_id, snp_id, seg_idx, cluster, min_count, maj_count). Bins
    whose sites lie in more than one segment are dropped, bins without sites
    keep nulls.
    """
    inside = sites.filter("bin_id >= 0").groupBy("bin_id").agg(
        F.min("seg_idx").alias("seg_idx"), F.max("seg_idx").alias("__high"), F.min(F.struct("snp_id", "cluster"))["cluster"].alias("allelic_cluster"),
        F.sum("min_count").alias("min_count"), F.sum("maj_count").alias("maj_count"),
    )
    return bins.join(inside, "bin_id", "left").filter("seg_idx is null or seg_idx = __high").drop("__high")


def fill_from_segments(bins: DataFrame, extents: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Bins without a segment that lie inside the extent of one take it (the
    largest number if several). extents: (chr, seg_idx, low, high, cluster)."""
    open_ = bins.filter("seg_idx is null")
    outer = extents.select("chr", F.col("low").alias("__l"), F.col("high").alias("__h"), F.col("seg_idx").alias("__seg"))
    found = intervals.contained(open_.select("chr", "start", "end", "bin_id"), outer, ["chr"], "start", "end", "__l", "__h", "__seg", width, ["bin_id"])
    named = found.join(extents.select(F.col("seg_idx").alias("__seg"), F.col("cluster").alias("__c")), "__seg")
    return bins.join(named, "bin_id", "left").withColumn("seg_idx", F.coalesce("seg_idx", "__seg")).withColumn("allelic_cluster", F.coalesce("allelic_cluster", "__c")).drop("__seg", "__c")


def fallback_counts(bins: DataFrame, few: int = 10) -> DataFrame:
    """Counts of segments with at most ``few`` bins replaced by the mean counts
    of their allelic cluster."""
    sizes = bins.groupBy(F.col("seg_idx").alias("__seg")).agg((F.count(F.lit(1)) <= few).alias("__few"))
    means = bins.groupBy(F.col("allelic_cluster").alias("__clu")).agg(F.avg("min_count").alias("__min"), F.avg("maj_count").alias("__maj"))
    met = bins.join(sizes, F.col("seg_idx").eqNullSafe(F.col("__seg"))).join(means, F.col("allelic_cluster").eqNullSafe(F.col("__clu")))
    pick = lambda c, mean: F.when(F.col("__few"), F.col(mean)).otherwise(F.col(c).cast("double"))
    out = met.withColumn("min_count", pick("min_count", "__min")).withColumn("maj_count", pick("maj_count", "__maj"))
    return out.drop("__seg", "__few", "__clu", "__min", "__maj")


def log_length(start: Column, end: Column) -> Column:
    return F.log((end - start + 1).cast("double"))
