"""Grouped statistics with mergeable parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import betaln


def standardise(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Columns less their mean, by their population deviation.

    The means and deviations are one row, read first, so no row of the table
    is joined. Nulls and NaN stay out of both and null in the result; a
    column that does not vary becomes 0.
    """
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    parts = [e for c in columns for e in (F.avg(clean(c)), F.stddev_pop(clean(c)))]
    found = list(df.agg(*parts).first()) if columns else []
    for k, c in enumerate(columns):
        mean, sd = found[2 * k], found[2 * k + 1]
        df = df.withColumn(c + suffix, (clean(c) - F.lit(mean)) / F.lit(sd) if sd else clean(c) * 0.0)
    return df


def log_standardise(df: DataFrame, columns: list[str], suffix: str = "_lz") -> DataFrame:
    logs = {c: f"__log_{c}" for c in columns}
    for c, name in logs.items():
        df = df.withColumn(name, F.log1p(F.col(c)))
    df = standardise(df, list(logs.values()), "_z")
    for c, name in logs.items():
        df = df.withColumnRenamed(name + "_z", c + suffix).drop(name)
    return df


def allele_evidence(df: DataFrame, keys: list[str], major: str, minor: str, prior: float = 1.0) -> DataFrame:
    """Counts by key and the Beta-binomial evidence of one shared fraction."""
    sums = df.groupBy(*keys).agg(F.sum(F.col(major).cast("double")).alias("major"), F.sum(F.col(minor).cast("double")).alias("minor"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("log_evidence", betaln(F.col("major") + prior, F.col("minor") + prior))


def deviations(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, ssd): count, mean and sum of squared deviations."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("ssd"))


def merge_deviations(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merges (n, mean, ssd) of parts into those of ``keys``.

    The total is the sum within the parts and the sum between their means.
    """
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    return parts.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), (F.sum("ssd") + F.greatest(between, F.lit(0.0))).alias("ssd"))


def remove_deviations(total: tuple[Column, Column, Column], part: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """(n, mean, ssd) of what is left of a total without a part."""
    (n, mean, ssd), (k, m, s) = total, part
    left = n - k
    rest = F.when(left > 0, (n * mean - k * m) / left)
    return left, rest, F.when(left > 0, ssd - s - k * left / n * (m - rest) * (m - rest))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def scale_to_ploidy(df: DataFrame, keys: list[str], length: str, total: str) -> DataFrame:
    """(keys, factor): length-weighted mean total copy number over two."""
    return df.groupBy(*keys).agg((weighted_mean(F.col(total), F.col(length)) / 2).alias("factor"))


def best_row(df: DataFrame, keys: list[str], by: str, names: list[str]) -> DataFrame:
    """The row of each key with the largest ``by``; of ties the first in order
    of ``names``."""
    best = F.min(F.struct((-F.col(by)).alias("__by"), *names)).alias("b")
    grouped = df.groupBy(*keys).agg(best) if keys else df.agg(best)
    return grouped.select(*keys, *[F.col(f"b.{n}") for n in names], (-F.col("b.__by")).alias(by))


def histogram_entropy(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """(keys, bins, entropy) of a histogram with cells of ``width``."""
    cells = df.groupBy(*keys, F.floor(F.col(value) / width).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    n, x = F.sum("__n"), F.col("__n")
    # -sum p ln p with p = n_i / n
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("bins"), (F.log(n.cast("double")) - F.sum(x * F.log(x.cast("double"))) / n).alias("entropy"))


def bucketed(value: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below the value."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(value >= b, 1).otherwise(0)
    return out


def spread_line(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: regression of the deviation of groups on their mean, with
    their medians and the number of groups."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return stats.agg(F.regr_slope("s", "m").alias("slope"), F.regr_intercept("s", "m").alias("intercept"), F.median("m").alias("median_mean"), F.median("s").alias("median_sd"), F.count(F.lit(1)).alias("groups"))
