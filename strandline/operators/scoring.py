"""Segments of other tools, comparison with the truth, and simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import intervals, ordered
from strandline.operators.aggregates import bucketed, weighted_mean
from strandline.operators.allelic_mcmc import seed_of

COMMON = ["chr", "start_bp", "end_bp", "mu_major", "sigma_major", "mu_minor", "sigma_minor"]


def common_segments(rows: DataFrame, major: Column, minor: Column) -> DataFrame:
    """(chr, start_bp, end_bp) with means, and deviations of a tenth of them."""
    return rows.select("chr", "start_bp", "end_bp", major.alias("mu_major"), (major / 10).alias("sigma_major"), minor.alias("mu_minor"), (minor / 10).alias("sigma_minor"))


def from_copy_numbers(rows: DataFrame) -> DataFrame:
    """Tools that report major and minor copies (n_major, n_minor)."""
    return common_segments(rows, F.col("n_major").cast("double"), F.col("n_minor").cast("double"))


def from_total_and_minor(rows: DataFrame) -> DataFrame:
    """Tools that report total and lesser copies (total, lesser)."""
    return common_segments(rows, (F.col("total") - F.col("lesser")).cast("double"), F.col("lesser").cast("double"))


def from_log_ratio(rows: DataFrame) -> DataFrame:
    """Tools that report log2 ratio and minor fraction (log_ratio, maf)."""
    total = 2 * F.pow(F.lit(2.0), F.col("log_ratio"))
    return common_segments(rows, total * (1 - F.col("maf")), total * F.col("maf"))


def from_bins(bins: DataFrame, attributes: DataFrame) -> DataFrame:
    """Tools that report a cluster for each bin (chr, start, end, cluster) and
    copies for each cluster (cluster, n_major, n_minor)."""
    runs = ordered.collapse(bins, ["chr"], ["start"], ["cluster"], [F.min("start").alias("start_bp"), F.max("end").alias("end_bp")])
    return from_copy_numbers(runs.join(F.broadcast(attributes), "cluster"))


def pair_segments(truth: DataFrame, found: DataFrame, width: int = 5_000_000) -> DataFrame:
    """Overlaps of two sets of segments with means of both; t_ is the truth."""
    left = truth.select("chr", F.col("start_bp").alias("a"), F.col("end_bp").alias("b"), F.col("mu_major").alias("t_major"), F.col("mu_minor").alias("t_minor"))
    right = found.select("chr", F.col("start_bp").alias("c"), F.col("end_bp").alias("d"), F.col("mu_major").alias("f_major"), F.col("mu_minor").alias("f_minor"))
    met = intervals.overlaps(left, right, ["chr"], ("a", "b"), ("c", "d"), width)
    return met.select("chr", "overlap_start", "overlap_end", (F.col("overlap_end") - F.col("overlap_start")).alias("length"), "t_major", "t_minor", "f_major", "f_minor", (F.col("b") - F.col("a")).alias("event_length"))


def compare(truth: DataFrame, found: DataFrame, low: float = 0.25, high: float = 4.0, points: int = 400) -> DataFrame:
    """One row: the least length-weighted absolute deviation of both alleles
    over scale factors, the factors within 1 % of it, and lengths that overlap
    and that do not. Batches of overlaps are summed under all factors at once."""
    pairs = pair_segments(truth, found)
    factors = low * np.power(high / low, np.arange(points) / (points - 1.0))

    def partial(batches):
        """Weighted error and weight of a batch under every factor."""
        for p in batches:
            error = np.zeros(points)
            for t, f in (("t_major", "f_major"), ("t_minor", "f_minor")):
                error += (np.abs(p[t].to_numpy(float) - factors[:, None] * p[f].to_numpy(float)) * p["length"].to_numpy(float) / 2).sum(axis=1)
            yield pd.DataFrame({"k": factors, "error": error, "weight": float(p["length"].sum())})

    sums = pairs.select("t_major", "t_minor", "f_major", "f_minor", "length").mapInPandas(partial, "k double, error double, weight double")
    scores = sums.groupBy("k").agg((F.sum("error") / F.sum("weight")).alias("mad"))
    best = scores.agg(F.min("mad").alias("m")).first()["m"]
    length = truth.agg(F.sum(F.col("end_bp") - F.col("start_bp")).alias("t")).first()["t"] or 0
    near = scores.filter(F.col("mad") <= F.lit((best or 0.0) * 1.01)).agg(F.min("mad").alias("mad_score"), F.min("k").alias("optimal_lower_bound"), F.max("k").alias("optimal_upper_bound"))
    overlap = pairs.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("overlap_length"))
    both = overlap.first()["overlap_length"]
    return near.withColumn("non_overlap_length", F.lit(int(length - both))).withColumn("overlap_length", F.lit(int(both)))


def truth_at(points: DataFrame, truth: DataFrame, width: int = 5_000_000) -> DataFrame:
    """Segments with the truth at their midpoint; those without are dropped."""
    middle = points.withColumn("__mid", F.floor((F.col("start_bp") + F.col("end_bp")) / 2))
    named = truth.select("chr", F.col("start_bp").alias("__s"), F.col("end_bp").alias("__e"), F.col("mu_major").alias("t_major"), F.col("mu_minor").alias("t_minor"))
    return intervals.point_in_interval(middle, named, ["chr"], "__mid", "__s", "__e", width).drop("__mid", "__s", "__e")


def error_map(pairs: DataFrame, lengths: list[float], fractions: list[float]) -> DataFrame:
    """Length-weighted mean error by event length and cell fraction."""
    cells = pairs.withColumn("length_bin", bucketed(F.col("event_length"), lengths)).withColumn("ccf_bin", bucketed(F.col("ccf"), fractions))
    return cells.groupBy("length_bin", "ccf_bin", "purity", "method").agg(weighted_mean(F.col("error"), F.col("length")).alias("error"))


def method_of_purity(purity: Column, kind: Column) -> Column:
    """Clustered results from a purity on (0.3 genomes, 0.2 exomes)."""
    return F.when(purity >= F.when(kind == "WES", 0.2).otherwise(0.3), "clustered").otherwise("unclustered")


# -- simulation --------------------------------------------------------------------


def binomial_counts(rows: DataFrame, ids: list[str], depth: str, chance: str, seed: int, name: str) -> DataFrame:
    """With ``name``: a binomial draw for each row, seeded by its ids."""

    def of(batches):
        for p in batches:
            seeds = [seed_of(seed, *k) for k in p[ids].itertuples(index=False, name=None)]
            p[name] = [int(np.random.default_rng(s).binomial(int(n), float(c))) for s, n, c in zip(seeds, p[depth], p[chance])]
            yield p

    return rows.mapInPandas(of, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def simulated_sites(sites: DataFrame, profile: DataFrame, purity: float, depth: int, seed: int) -> DataFrame:
    """ref_count and alt_count of sites (chr, pos, aidx) under a profile of
    segments (chr, start_bp, end_bp, mu_major, mu_minor) at a purity."""
    segs = profile.select("chr", F.col("start_bp").alias("__s"), F.col("end_bp").alias("__e"), "mu_major", "mu_minor")
    placed = intervals.point_in_interval(sites, segs, ["chr"], "pos", "__s", "__e", 5_000_000)
    own = lambda c: purity * F.col(c) + (1 - purity)
    total = own("mu_major") + own("mu_minor")
    alt = F.when(F.col("aidx"), own("mu_major")).otherwise(own("mu_minor")) / total
    rows = placed.withColumn("__d", F.round(F.lit(depth) * total / 2).cast("long")).withColumn("__p", alt)
    out = binomial_counts(rows, ["chr", "pos"], "__d", "__p", seed, "alt_count")
    return out.withColumn("ref_count", F.col("__d") - F.col("alt_count")).select(*sites.columns, "ref_count", "alt_count")


def log_ratio_and_baf(sites: DataFrame, normal: DataFrame, seed: int, least_depth: int = 20) -> DataFrame:
    """(chr, pos, log_r, baf) for tools that take them: log2 of depth ratio
    over its mean, and alternate fraction with alleles swapped at random."""
    met = sites.join(normal.select("chr", "pos", F.col("ref_count").alias("__nr"), F.col("alt_count").alias("__na")), ["chr", "pos"]).distinct().filter(F.col("__nr") + F.col("__na") > least_depth)
    ratio = F.log2((F.col("ref_count") + F.col("alt_count")) / (F.col("__nr") + F.col("__na")))
    rows = met.withColumn("__r", ratio)
    mean = rows.agg(F.avg("__r")).first()[0] or 0.0
    fraction = F.col("alt_count") / (F.col("ref_count") + F.col("alt_count"))
    turned = F.pmod(F.xxhash64(F.lit(seed), "chr", "pos"), F.lit(2)) == 0
    return rows.select("chr", "pos", (F.col("__r") - F.lit(mean)).alias("log_r"), F.when(turned, 1 - fraction).otherwise(fraction).alias("baf"))


def random_profile(spark: SparkSession, lengths: dict[int, int], events: int, seed: int) -> DataFrame:
    """Segments of a random genome: arm and focal events on a diploid one."""
    rng = np.random.default_rng(seed)
    state = {c: [(0, n, 1.0, 1.0)] for c, n in lengths.items()}
    for _ in range(events):
        c = int(rng.choice(sorted(lengths)))
        n = lengths[c]
        size = n // 2 if rng.random() < 0.4 else int(n * rng.uniform(0.01, 0.2))
        a = int(rng.integers(0, n - size + 1))
        gain, major = float(rng.choice([-1, 1])), rng.random() < 0.5
        out = []
        for s, e, x, y in state[c]:
            for u, v, inside in ((s, min(e, a), False), (max(s, a), min(e, a + size), True), (max(s, a + size), e, False)):
                if u < v:
                    out.append((u, v, max(0.0, x + gain) if inside and major else x, max(0.0, y + gain) if inside and not major else y))
        state[c] = out
    rows = [(c, s, e, max(x, y), min(x, y)) for c, segs in state.items() for s, e, x, y in segs]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["chr", "start_bp", "end_bp", "mu_major", "mu_minor"]))


def replication_track(rows: DataFrame, width: int = 50_000) -> DataFrame:
    """(chr, start, end, C_RT): means of a signal by cells of ``width``."""
    cell = F.floor(F.col("pos") / width)
    out = rows.groupBy("chr", cell.alias("__c")).agg(F.avg("signal").alias("C_RT"))
    return out.select("chr", (F.col("__c") * width).alias("start"), ((F.col("__c") + 1) * width).alias("end"), "C_RT")
