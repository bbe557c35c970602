"""Operators over ordered rows: islands, chunks, moving means, prefix scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from strandline.functions.special import betaln


def _window(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def row_ids(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Dense ids from 0: places within each key, after the sizes of the keys
    before it. Only the sizes of keys pass through one task."""
    own = df.withColumn("__place", F.row_number().over(_window(keys, order)) - 1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return own.join(before, keys).withColumn(name, F.col("__before") + F.col("__place")).drop("__before", "__place")


def islands(df: DataFrame, keys: list[str], order: list[str], value: list[str], name: str = "island") -> DataFrame:
    """Numbers, from 0, the runs of rows with equal values in order."""
    w = _window(keys, order)
    changed = F.lit(False)
    for v in value:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    step = F.when(F.row_number().over(w) == 1, 0).otherwise(changed.cast("int"))
    return df.withColumn("__step", step).withColumn(name, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__step")


def collapse(df: DataFrame, keys: list[str], order: list[str], value: list[str], aggregates: list[Column]) -> DataFrame:
    """One row for each run: its keys, number, values and aggregates."""
    return islands(df, keys, order, value).groupBy(*keys, "island", *value).agg(*aggregates)


def consecutive_runs(df: DataFrame, keys: list[str], index: str, least: int) -> DataFrame:
    """(keys, start, stop, n): runs of consecutive indices of ``least`` or more."""
    start = F.col(index) - F.row_number().over(_window(keys, [index]))
    runs = df.withColumn("__run", start).groupBy(*keys, "__run").agg(F.min(index).alias("start"), F.max(index).alias("stop"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least).drop("__run")


def breakpoints(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = _window(keys, order)
    return df.withColumn("__before", F.lag(value).over(w)).withColumn("__row", F.row_number().over(w)).filter((F.col("__row") > 1) & ~F.col(value).eqNullSafe(F.col("__before"))).drop("__before", "__row")


def intervals_between(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, start, end): from each place to the next."""
    return df.select(*keys, F.col(place).alias("start"), F.lead(place).over(_window(keys, [place])).alias("end")).filter("end is not null")


def chunk_ranges(df: DataFrame, keys: list[str], size: int, least_fraction: float = 0.05) -> DataFrame:
    """(keys, chunk, start, end) over the rows of each key, [start, end).

    Chunks of ``size`` rows; a last one below ``least_fraction`` of it joins
    the chunk before. The last row of a key is part of its last chunk.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = F.floor(F.col("n") / size).cast("long")
    rest = F.col("n") - whole * size
    short = (whole > 0) & (rest < F.lit(size * least_fraction))
    count = F.when(short, whole).otherwise(whole + 1)
    chunks = n.withColumn("__count", count).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1)))
    end = F.when(F.col("chunk") == F.col("__count") - 1, F.col("n")).otherwise((F.col("chunk") + 1) * size)
    return chunks.select(*keys, "chunk", (F.col("chunk") * size).alias("start"), end.alias("end"))


def moving_weighted_mean(df: DataFrame, keys: list[str], order: list[str], value: str, weight: str, width: int, name: str) -> DataFrame:
    """Centred sum(w x) / sum(w) over ``width`` rows; rows past the ends and
    null values count nothing."""
    w = _window(keys, order).rowsBetween(-(width // 2), width // 2)
    here = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.withColumn(name, F.sum(F.col(weight) * F.col(value)).over(w) / F.sum(here).over(w))


def split_posterior(df: DataFrame, keys: list[str], order: list[str], major: str, minor: str, prior: float | Column = 1.0) -> DataFrame:
    """``log_posterior`` of a split after each row of a key.

    The score of a split is the Beta-binomial evidence of the rows up to it
    and of the rows after it; the last row stands for no split. Scores are
    normalised over the key.
    """
    w, whole = _window(keys, order), Window.partitionBy(*keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    h = prior if isinstance(prior, Column) else F.lit(float(prior))
    sums = df.withColumn("__a", F.sum(F.col(major).cast("double")).over(upto)).withColumn("__b", F.sum(F.col(minor).cast("double")).over(upto))
    sums = sums.withColumn("__ta", F.sum(F.col(major).cast("double")).over(whole)).withColumn("__tb", F.sum(F.col(minor).cast("double")).over(whole))
    one = F.lit(1.0) + h
    score = betaln(F.col("__a") + one, F.col("__b") + one) + betaln(F.col("__ta") - F.col("__a") + one, F.col("__tb") - F.col("__b") + one)
    scored = sums.withColumn("__score", score).withColumn("__top", F.max("__score").over(whole))
    out = scored.withColumn("log_posterior", F.col("__score") - F.col("__top") - F.log(F.sum(F.exp(F.col("__score") - F.col("__top"))).over(whole)))
    return out.drop("__a", "__b", "__ta", "__tb", "__score", "__top")


def edge_outliers(df: DataFrame, keys: list[str], order: list[str], value: str, sigmas: float = 5.0, least: int = 4) -> DataFrame:
    """(keys, n, first_out, last_out): whether the first and the last row lie
    ``sigmas`` population deviations from the mean of the rows between.

    The row next to an edge is tried with it: an edge is out only if it is
    further from the mean than its neighbour. Keys under ``least`` rows have
    no edges that are out.
    """
    w = _window(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("__k", F.row_number().over(w)).withColumn("__n", n).withColumn("__v", F.col(value).cast("double"))
    inner = F.when((F.col("__k") > 1) & (F.col("__k") < F.col("__n")), F.col("__v"))
    pick = lambda k: F.max(F.when(F.col("__k") == k, F.col("__v")))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inner).alias("m"), F.stddev_pop(inner).alias("s"),
        pick(F.lit(1)).alias("a"), pick(F.lit(2)).alias("a2"), pick(F.col("__n")).alias("z"), pick(F.col("__n") - 1).alias("z2"),
    )
    far = lambda x, y: (F.abs(F.col(x) - F.col("m")) > sigmas * F.col("s")) & (F.abs(F.col(x) - F.col("m")) > F.abs(F.col(y) - F.col("m"))) & (F.col("n") >= least)
    return stats.select(*keys, "n", F.coalesce(far("a", "a2"), F.lit(False)).alias("first_out"), F.coalesce(far("z", "z2"), F.lit(False)).alias("last_out"))


def renumber(df: DataFrame, within: list[str], ids: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 for the distinct ``ids`` in each of ``within``."""
    return df.withColumn(name, F.dense_rank().over(_window(within, ids)) - 1)


def cumulative_offsets(df: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """Sum of the sizes before each row, for tables as small as chromosomes."""
    return df.withColumn(name, F.coalesce(F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def elbow(df: DataFrame, score: str, weight: str) -> DataFrame:
    """(score, share, bend): share of the weight at or below each score, and
    its distance from the straight line between the ends of the curve.

    The elbow is the row with the largest ``bend``.
    """
    steps = df.groupBy(score).agg(F.sum(weight).alias("__w"))
    total = steps.agg(F.sum("__w").alias("t"), F.min(score).alias("a"), F.max(score).alias("z")).first()
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("share", F.sum("__w").over(w) / F.lit(total["t"]))
    x = (F.col(score) - F.lit(total["a"])) / F.lit((total["z"] - total["a"]) or 1.0) if total["t"] is not None else F.lit(0.0)
    return out.select(score, "share", (F.col("share") - x).alias("bend"))
