"""Phased heterozygous sites: loading, orientation, merging, arms, evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandline.functions.special import beta_cdf, beta_logcdf, beta_logsf, beta_ppf
from strandline.operators import intervals, ordered


def parse_haplotypes(calls: DataFrame) -> DataFrame:
    """allele_a, allele_b and phased from ``hap`` (0|1, 1|0, 0/1)."""
    part = lambda k: F.expr(f"try_cast(regexp_extract(hap, '^(.)[/|](.)', {k}) as tinyint)")
    return calls.withColumn("allele_a", part(1)).withColumn("allele_b", part(2)).withColumn("phased", F.substring("hap", 2, 1) == "|")


def drop_homozygous(calls: DataFrame) -> DataFrame:
    """Without sites phased 1|1."""
    return calls.filter(~(F.col("phased") & (F.col("allele_a") == 1) & (F.col("allele_b") == 1)))


def merge_readbacked(sites: DataFrame, backed: DataFrame) -> DataFrame:
    """Imputed phases corrected by phase sets read from single molecules.

    In each phase set the orientation that agrees better with the imputed
    one (by Jaccard index of the sites that carry the alternate allele on
    haplotype A) is taken; its sites replace the imputed ones with misphasing
    probability 0, and sites only in phase sets are added.
    """
    own = sites.select("chr", "pos", F.col("allele_a").alias("__a"))
    met = backed.filter("phased and ps is not null").join(own, ["chr", "pos"], "left")
    one, two, both = F.col("allele_a") == 1, F.col("allele_b") == 1, F.col("__a") == 1
    jaccard = lambda x: F.count_if(x & both) / F.greatest(F.count_if(F.col("__a").isNotNull() & (x | both)), F.lit(1))
    flip = met.groupBy("chr", "ps").agg((jaccard(two) > jaccard(one)).alias("__flip"))
    turned = met.join(flip, ["chr", "ps"])
    fixed = turned.select(
        "chr", "pos", F.col("ref").alias("__ref"), F.col("alt").alias("__alt"), F.when(F.col("__flip"), F.col("allele_b")).otherwise(F.col("allele_a")).alias("__na"),
        F.when(F.col("__flip"), F.col("allele_a")).otherwise(F.col("allele_b")).alias("__nb"),
    )
    updated = sites.join(fixed, ["chr", "pos"], "left").select(
        "chr", "pos", "ref", "alt", F.coalesce("__na", "allele_a").alias("allele_a"), F.coalesce("__nb", "allele_b").alias("allele_b"),
        (F.col("phased") | F.col("__na").isNotNull()).alias("phased"), F.when(F.col("__na").isNotNull(), 0.0).otherwise(F.col("misphase_prob")).alias("misphase_prob"),
    )
    added = fixed.join(sites.select("chr", "pos"), ["chr", "pos"], "left_anti")
    added = added.select("chr", "pos", F.col("__ref").alias("ref"), F.col("__alt").alias("alt"), F.col("__na").alias("allele_a"), F.col("__nb").alias("allele_b"), F.lit(True).alias("phased"), F.lit(0.0).alias("misphase_prob"))
    return updated.unionByName(added)


def with_counts(sites: DataFrame, tumour: DataFrame, normal: DataFrame | None = None) -> DataFrame:
    out = sites.join(tumour, ["chr", "pos"])
    return out if normal is None else out.join(normal, ["chr", "pos"])


def orient(sites: DataFrame) -> DataFrame:
    """maj_count and min_count: counts of haplotypes A and B."""
    alt_is_a = F.col("allele_a") > 0
    return sites.filter("phased").withColumn("aidx", alt_is_a).withColumn("maj_count", F.when(alt_is_a, F.col("alt_count")).otherwise(F.col("ref_count"))).withColumn("min_count", F.when(F.col("allele_b") > 0, F.col("alt_count")).otherwise(F.col("ref_count")))


def apply_reference_bias(sites: DataFrame, bias: float) -> DataFrame:
    """Reference counts times the bias; where there are none the alternate
    counts are divided by it. Haplotype counts follow."""
    none = F.col("ref_count") == 0
    fixed = sites.withColumn("alt_count", F.when(none, F.col("alt_count") / bias).otherwise(F.col("alt_count"))).withColumn("ref_count", F.col("ref_count") * bias)
    return orient(fixed)


def credible_interval(sites: DataFrame) -> DataFrame:
    """ci_lo, median, ci_hi of the fraction of haplotype A."""

    def quantile(q: float):
        @F.pandas_udf(T.DoubleType())
        def of(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(beta_ppf(q, a.to_numpy(float) + 1, b.to_numpy(float) + 1, 50))

        return of("maj_count", "min_count")

    return sites.withColumns({"ci_lo": quantile(0.05), "median": quantile(0.5), "ci_hi": quantile(0.95)})


def chromosome_arms(bands: DataFrame) -> DataFrame:
    """(chr, arm, start, end): each chromosome cut at its centromere.

    ``arm`` numbers all arms from 0. The short arm ends where the first
    centromeric band does.
    """
    w = Window.partitionBy("chr").orderBy("start")
    first = bands.withColumn("__c", (F.col("stain") == "acen") & ~F.coalesce(F.lag("stain").over(w) == "acen", F.lit(False)))
    cut = first.groupBy("chr").agg(F.min(F.when(F.col("__c"), F.col("end"))).alias("cut"), F.min("start").alias("low"), F.max("end").alias("high"))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("low").alias("start"), F.coalesce("cut", "high").alias("end")), F.struct(F.lit(1).alias("half"), F.col("cut").alias("start"), F.col("high").alias("end")))
    arms = cut.select("chr", F.explode(halves).alias("h")).select("chr", "h.*").filter("start is not null and end > start")
    return arms.withColumn("arm", (F.col("chr") - 1) * 2 + F.col("half")).select("chr", "arm", "start", "end")


def place_in_arms(sites: DataFrame, arms: DataFrame, least_span: int = 5) -> DataFrame:
    """Sites with their arm and dense ``snp_id``; arms of few sites dropped.

    Arms are a table of 48 rows: the join is broadcast.
    """
    named = F.broadcast(arms.select(F.col("chr").alias("__chr"), "arm", F.col("start").alias("__s"), F.col("end").alias("__e")))
    placed = sites.join(named, (F.col("chr") == F.col("__chr")) & (F.col("pos") >= F.col("__s")) & (F.col("pos") < F.col("__e"))).drop("__chr", "__s", "__e")
    rows = ordered.row_ids(placed, ["arm"], ["pos"], "snp_id")
    wide = rows.groupBy("arm").agg((F.max("snp_id") - F.min("snp_id")).alias("n")).filter(F.col("n") > least_span).select("arm")
    return rows.join(F.broadcast(wide), "arm")


def load_sites(calls: DataFrame, tumour: DataFrame, arms: DataFrame, normal: DataFrame | None = None, backed: DataFrame | None = None, misphase: float = 0.001) -> DataFrame:
    """The chain from calls to placed, oriented sites, as one plan."""
    sites = drop_homozygous(parse_haplotypes(calls)).withColumn("misphase_prob", F.lit(misphase)).select("chr", "pos", "ref", "alt", "allele_a", "allele_b", "phased", "misphase_prob")
    if backed is not None:
        sites = merge_readbacked(sites, drop_homozygous(parse_haplotypes(backed)))
    return place_in_arms(orient(with_counts(sites, tumour, normal)), arms)


def bias_samples(segments: DataFrame, grid: list[float], seed: int, draws: int = 1000) -> DataFrame:
    """(bias, gap, weight) for each segment and trial bias.

    segments: (segment, allele, ref, alt, n_snp) with both alleles. The gap is
    the mean distance of the alternate fractions of the two alleles, drawn
    from their Beta posteriors, under that bias. Draws come from a seed of
    the segment.
    """
    both = segments.groupBy("segment").pivot("allele", [0, 1]).agg(F.sum("ref").alias("ref"), F.sum("alt").alias("alt"), F.sum("n_snp").alias("n"))
    both = both.dropna()

    def of(batches):
        for p in batches:
            out = []
            for r in p.itertuples(index=False, name=None):
                values = dict(zip(p.columns, r))
                rng = np.random.default_rng([seed, int(values["segment"])])
                for b in grid:
                    # allele 0 carries the alternate on A, allele 1 on B
                    f0 = rng.beta(values["0_alt"] + 1, values["0_ref"] * b + 1, draws)
                    f1 = rng.beta(values["1_ref"] * b + 1, values["1_alt"] + 1, draws)
                    out.append((values["segment"], b, float(np.abs(f0 - f1).mean()), float(values["0_n"] + values["1_n"])))
            yield pd.DataFrame(out, columns=["segment", "bias", "gap", "weight"])

    return both.mapInPandas(of, "segment long, bias double, gap double, weight double")


def estimate_reference_bias(segments: DataFrame, seed: int = 1, rounds: tuple[int, ...] = (10, 20, 30), low: float = 0.8, high: float = 1.2, least_snps: int = 20) -> float:
    """The bias under which both alleles of segments agree best.

    Segments need both alleles with more than ``least_snps`` sites each. The
    grid narrows around the best point of each round.
    """
    ready = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("__k"), F.every(F.col("n_snp") > least_snps).alias("__ok")).filter("__k = 2 and __ok").select("segment")
    kept = segments.join(ready, "segment")
    best = 1.0
    for points in rounds:
        grid = np.linspace(low, high, points)
        scores = bias_samples(kept, grid.tolist(), seed).groupBy("bias").agg((F.sum(F.col("gap") * F.col("weight")) / F.sum("weight")).alias("g")).collect()
        if not scores:
            return 1.0
        best = min(scores, key=lambda r: (r.g, r.bias)).bias
        step = (high - low) / (points - 1)
        low, high = best - step, best + step
    return float(best)


def segment_alleles(sites: DataFrame, breaks: DataFrame) -> DataFrame:
    """Counts by segment and allele: (segment, allele, ref, alt, n_snp).

    breaks: (arm, start, end) ranges of snp_id, in order.
    """
    ranges = ordered.row_ids(breaks, ["arm"], ["start"], "segment")
    met = intervals.point_in_interval(sites.select("arm", "snp_id", "aidx", "ref_count", "alt_count"), ranges.select("arm", "start", "end", "segment"), ["arm"], "snp_id", "start", "end", 1000)
    return met.groupBy("segment", F.when(F.col("aidx"), 0).otherwise(1).alias("allele")).agg(F.sum("ref_count").alias("ref"), F.sum("alt_count").alias("alt"), F.count(F.lit(1)).alias("n_snp"))


def heterozygous(ref: Column, alt: Column) -> Column:
    """Posterior says one copy of each: see ``het_mass`` for the rule."""
    return het_mass(ref, alt) > 0.7


@F.pandas_udf(T.DoubleType())
def het_mass(ref: pd.Series, alt: pd.Series) -> pd.Series:
    """Posterior mass of an alternate fraction between 0.4 and 0.6."""
    a, b = alt.to_numpy(float) + 1, ref.to_numpy(float) + 1
    return pd.Series(beta_cdf(0.6, a, b) - beta_cdf(0.4, a, b))


@F.pandas_udf(T.DoubleType())
def het_log_odds(ref: pd.Series, alt: pd.Series) -> pd.Series:
    """Log posterior odds of a fraction above one half."""
    a, b = alt.to_numpy(float) + 1, ref.to_numpy(float) + 1
    return pd.Series(beta_logsf(0.5, a, b) - beta_logcdf(0.5, a, b))


@F.pandas_udf(T.DoubleType())
def hom_mass(ref: pd.Series, alt: pd.Series) -> pd.Series:
    """Posterior mass of an alternate fraction above 0.95."""
    return pd.Series(1 - beta_cdf(0.95, alt.to_numpy(float) + 1, ref.to_numpy(float) + 1))


def quality_calls(calls: DataFrame, least_depth: int = 8, most_mapq0: float = 0.05, most_filtered: float = 0.1) -> DataFrame:
    """Calls with few reads of mapping quality 0, few filtered, and depth."""
    depth = F.col("t_refcount") + F.col("t_altcount")
    return calls.filter((F.col("mapq0_reads") / F.col("total_reads") <= most_mapq0) & (1 - (depth + F.col("n_refcount") + F.col("n_altcount")) / F.col("total_reads") <= most_filtered) & (depth > least_depth))


def heterozygous_calls(calls: DataFrame, most_odds: float = 2.15, least_mass: float = 0.7) -> DataFrame:
    """Calls that the normal sample shows to be heterozygous."""
    return calls.filter((F.abs(het_log_odds("n_refcount", "n_altcount")) < most_odds) & (het_mass("n_refcount", "n_altcount") > least_mass))
