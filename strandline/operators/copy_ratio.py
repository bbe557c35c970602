"""From clustered segments to allelic copy ratios and exported segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.operators.aggregates import scale_to_ploidy
from strandline.operators.allelic_mcmc import seed_of


def allele_rows(bins: DataFrame) -> DataFrame:
    """Each bin once for each allele, -1 (minor) and 1 (major)."""
    return bins.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("allele"))


def pseudo_observations(segments: DataFrame, keys: list[str], seed: int = 1, draws: int = 10_000) -> DataFrame:
    """(keys, segment, allele, n, mean, ssd): copy ratio of an allele, drawn as
    Poisson(exp N(mu, sigma)) times Beta of the allele's counts.

    segments: (keys, segment, allele, mu, sigma, own, other, bins). A row's
    draws come from the seed of its key, segment and allele; ``n`` is its
    number of bins, the moments those of all draws.
    """
    kinds = dict(segments.dtypes)
    names = [*keys, "segment", "allele", "n", "mean", "ssd"]

    def of(batches):
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                rng = np.random.default_rng(seed_of(seed, *[r[k] for k in keys], r["segment"], r["allele"]))
                rate = np.exp(rng.normal(r["mu"], r["sigma"], draws))
                x = rng.poisson(np.minimum(rate, 1e12)) * rng.beta(r["own"] + 1, r["other"] + 1, draws)
                rows.append((*[r[k] for k in keys], r["segment"], r["allele"], float(r["bins"]), float(x.mean()), float(x.var() * r["bins"])))
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "segment", "allele"]) + ", n double, mean double, ssd double"
    return segments.select(*keys, "segment", "allele", "mu", "sigma", "own", "other", "bins").mapInPandas(of, schema)


def grey_segments(observed: DataFrame, least: float = 3, sds: float = 2.5) -> DataFrame:
    """With ``grey``: few bins, or a deviation above ``sds`` times what the
    line through all segments gives at their mean."""
    sd = F.sqrt(F.col("ssd") / F.col("n"))
    line = observed.select(F.col("mean"), sd.alias("sd")).agg(F.regr_slope("sd", "mean").alias("b"), F.regr_intercept("sd", "mean").alias("a")).first()
    bound = F.lit(float(line["a"] or 0.0)) + F.lit(float(line["b"] or 0.0)) * F.col("mean")
    return observed.withColumn("grey", (F.col("n") < least) | (sd > sds * bound))


def cluster_summary(rows: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Mean, population deviation, length and count of each cluster."""
    return rows.groupBy(*keys, cluster).agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"), F.sum(F.col("end_bp") - F.col("start_bp")).alias("territory"), F.count(F.lit(1)).alias("n"))


def merge_classes(clonal: DataFrame, subclonal: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Clusters of two classes as one numbering, clonal ones first."""
    both = clonal.withColumn("subclonal", F.lit(False)).unionByName(subclonal.withColumn("subclonal", F.lit(True)))
    return ordered.renumber(both, keys, ["subclonal", cluster], "__c").withColumn(cluster, F.col("__c")).drop("__c")


def export_segments(bins: DataFrame, rescale: bool = True) -> DataFrame:
    """(chr, start_bp, end_bp, num_bins, mu/sigma of major and minor).

    bins: (chr, start, end, major_cluster, minor_cluster, and the clusters'
    mu_major, sigma_major, mu_minor, sigma_minor). A segment ends where either
    cluster changes; the larger mean is the major one. Rescaled, the
    length-weighted mean total is two.
    """
    runs = ordered.collapse(
        bins, ["chr"], ["start"], ["major_cluster", "minor_cluster"],
        [F.min("start").alias("start_bp"), F.max("end").alias("end_bp"), F.count(F.lit(1)).alias("num_bins"), *[F.first(c).alias(c) for c in ("mu_major", "sigma_major", "mu_minor", "sigma_minor")]],
    )
    turned = F.col("mu_minor") > F.col("mu_major")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    out = runs.select("chr", "start_bp", "end_bp", "num_bins", pick("mu_major", "mu_minor").alias("mu_major"), pick("sigma_major", "sigma_minor").alias("sigma_major"), pick("mu_minor", "mu_major").alias("mu_minor"), pick("sigma_minor", "sigma_major").alias("sigma_minor"))
    return rescaled(out) if rescale else out


def rescaled(segments: DataFrame) -> DataFrame:
    """Means and deviations by the factor that makes the mean total two."""
    rows = segments.withColumn("__len", F.col("end_bp") - F.col("start_bp")).withColumn("__tau", F.col("mu_major") + F.col("mu_minor"))
    factor = scale_to_ploidy(rows, [], "__len", "__tau").first()["factor"] or 1.0
    out = segments
    for c in ("mu_major", "sigma_major", "mu_minor", "sigma_minor"):
        out = out.withColumn(c, F.col(c) / F.lit(float(factor)))
    return out


def absolute_segments(segments: DataFrame) -> DataFrame:
    """The wider format: f, tau and its deviation, and the label of loss of
    heterozygosity without loss of copies. segments also have n_hets."""
    tau = F.col("mu_major") + F.col("mu_minor")
    return segments.select(
        "chr", "start_bp", "end_bp", F.col("num_bins").alias("n_probes"), (F.col("end_bp") - F.col("start_bp")).alias("length"), "n_hets", (F.col("mu_minor") / tau).alias("f"), tau.alias("tau"),
        F.sqrt(F.col("sigma_major") ** 2 + F.col("sigma_minor") ** 2).alias("sigma_tau"), "mu_minor", "sigma_minor", "mu_major", "sigma_major",
        F.when((F.col("mu_minor") < 0.1) & (F.abs(tau - 2) < 0.25), 2).otherwise(1).cast("long").alias("seg_label_cnloh"),
    )


def minor_fraction(minor: Column, major: Column) -> Column:
    return minor / (minor + major)
