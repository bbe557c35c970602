"""Purity and copy-number scale by grid search over allelic imbalance levels.

A clonal segment with ``na`` copies of its major allele of ``tau`` in all
has, at purity a, the minor allele fraction imbalance(a, na, tau). Segments
are scored against the levels of each purity: sorted by their share of the
major allele once in each task, as each level is the best of a run of shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import betaln, normal_logpdf
from strandline.operators.aggregates import best_row

MOST_COPIES = 7
#: Segments of a task that are sorted together.
_HELD = 1_000_000


def imbalance(purity: Column, major: Column, total: Column) -> Column:
    """Fraction of the major allele in a mixture with normal cells."""
    return (1 + purity * (major - 1)) / (2 * (1 - purity) + total * purity)


def subclone_imbalance(purity: Column, fraction: Column, major: Column, total: Column, sub_major: Column, sub_total: Column) -> Column:
    """The same with a subclone that makes up ``fraction`` of the tumour."""
    own, sub = purity * (1 - fraction), purity * fraction
    return ((1 - purity) + own * major + sub * sub_major) / (2 * (1 - purity) + own * total + sub * sub_total)


def levels(most: int = MOST_COPIES) -> list[tuple[int, int]]:
    """(major, total) with at least half of the copies major."""
    return [(na, tau) for tau in range(1, most + 1) for na in range(-(-tau // 2), tau + 1)]


def purity_comb(segments: DataFrame, major: str, minor: str, points: int = 10_000, most: int = MOST_COPIES, weight: str | None = None) -> DataFrame:
    """(purity, score): sum over segments of their best level's Beta density.

    ``points`` purities strictly between 0 and 1. A level whose fraction is 0
    or 1 scores nothing. With ``weight``, segments count by it.
    """
    a, b = F.col(major).cast("double"), F.col(minor).cast("double")
    counts = segments.select(a.alias("a"), b.alias("b"), betaln(a + 1, b + 1).alias("norm"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.arange(1, points + 1) / (points + 1.0)
        score, rows, known, held, size = np.zeros(points), 0, 0, [], 0

        def add() -> None:
            nonlocal score, known, held, size
            if held:
                a, b, norm, w = np.concatenate(held, axis=1)
                score += _scores(grid, a, b, norm, w, most)
                known += size
            held, size = [], 0

        for batch in batches:
            rows += batch.num_rows
            some = pa.Table.from_batches([batch]).filter(pc.and_(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()), batch.column(3).is_valid()))
            held.append(np.array([c.to_numpy() for c in some.columns], dtype=float))
            size += some.num_rows
            if size >= _HELD:
                add()
        if size:
            add()
        if rows:
            for at in range(0, points, 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(grid[part]), pa.array(score[part]) if known else pa.nulls(len(grid[part]), pa.float64())], names=["purity", "part"])

    return counts.mapInArrow(run, "purity double, part double").groupBy("purity").agg(F.sum("part").alias("score"))


def _scores(grid: np.ndarray, a: np.ndarray, b: np.ndarray, norm: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """For each purity the sum over segments, weighted, of their best level's
    log density.

    A segment's best level depends on a / (a + b) alone: between two levels
    next to each other it changes at one share, which lies between them. So
    segments are sorted by share once, and each level takes sums of a run.
    """
    plain = (a >= 0) & (b >= 0) & np.isfinite(a + b)
    # more digits than a double, as what is left of sums without their norm is small, and a run's sum is a difference
    odd, out = ~plain, np.zeros(len(grid), dtype=np.longdouble)
    share = a[plain] / np.maximum(a[plain] + b[plain], 1e-300)
    order = np.argsort(share, kind="stable")
    share = share[order]
    upto = [np.concatenate([[0], np.cumsum((w[plain] * x[plain])[order], dtype=np.longdouble)]) for x in (a, b)]
    na, tau = np.array(levels(most), dtype=float).T
    for at in range(0, len(grid), 4096):
        p = grid[at : at + 4096, None]
        x = np.sort((1 + p * (na - 1)) / (2 * (1 - p) + tau * p), axis=1)
        inside = (x > 0) & (x < 1)
        x = np.where(inside, x, 0.5)
        one, two = np.log(x), np.log(1 - x)
        if inside.all():
            fall, rise = two[:, :-1] - two[:, 1:], one[:, 1:] - one[:, :-1]
            with np.errstate(invalid="ignore", divide="ignore"):
                cut = fall / (fall + rise)
            cut = np.clip(np.where(np.isfinite(cut), cut, x[:, 1:]), x[:, :-1], x[:, 1:])
            ends = np.full((len(p), len(na) + 1), len(share))
            ends[:, 0], ends[:, 1:-1] = 0, np.searchsorted(share, cut)
            total = sum((side * np.diff(u[ends], axis=1)).sum(axis=1) for side, u in ((one, upto[0]), (two, upto[1])))
            out[at : at + 4096] += total
            one_by_one = np.flatnonzero(odd)
        else:
            one_by_one = np.arange(len(a))
        one, two = np.where(inside, one, -np.inf), np.where(inside, two, -np.inf)
        for k in one_by_one:
            out[at : at + 4096] += w[k] * (a[k] * one + b[k] * two).max(axis=1)
    return (out - (w * norm).sum(dtype=np.longdouble)).astype(float)


def _best_density(purity: Column, major: Column, minor: Column, most: int) -> Column:
    """Log Beta density of the counts at their likeliest level; null where
    every level's fraction is 0 or 1."""
    # the normaliser of the density does not depend on the level
    a, b = major.cast("double") + 1, minor.cast("double") + 1

    def density(na: int, tau: int) -> Column:
        x = imbalance(purity, F.lit(float(na)), F.lit(float(tau)))
        return F.when((x > 0) & (x < 1), (a - 1) * F.log(x) + (b - 1) * F.log(1 - x))

    return F.array_max(F.array(*[density(na, tau) for na, tau in levels(most)])) - betaln(a, b)


def scored_at(segments: DataFrame, major: str, minor: str, purity: float, most: int = MOST_COPIES) -> DataFrame:
    """With ``score``: the log density at the likeliest level of a purity."""
    return segments.withColumn("score", _best_density(F.lit(float(purity)), F.col(major), F.col(minor), most))


def fit_purity(segments: DataFrame, major: str, minor: str, points: int = 10_000, most: int = MOST_COPIES) -> float | None:
    """The purity of the best score, the smallest of equal ones; None with
    fewer than two segments, which fit any purity."""
    if segments.limit(2).count() < 2:
        return None
    top = best_row(purity_comb(segments, major, minor, points, most).filter("score is not null"), [], "score", ["purity"]).first()
    return top["purity"]


def coverage_comb(clusters: DataFrame, mean: str, sd: str, factors: list[float], most: int = 5, purity: float = 1.0, weight: str | None = None) -> DataFrame:
    """(k, score): clusters against copy numbers 0 to ``most`` times k, in a
    mixture with normal cells, which have one copy of each allele.

    The score of a cluster is its best Gaussian log density. With ``weight``,
    clusters count by it.
    """
    grid = clusters.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in factors])))
    best = F.array_max(F.array(*[normal_logpdf(F.col(mean), F.lit((1 - purity) + float(c) * purity) * F.col("k"), F.col(sd)) for c in range(most + 1)]))
    part = best * (F.col(weight) if weight else F.lit(1.0))
    return grid.withColumn("__best", part).groupBy("k").agg(F.sum("__best").alias("score"))


def fit_scale(clusters: DataFrame, mean: str, sd: str, purity: float, steps: int = 400, most: int = 5, weight: str | None = None) -> float | None:
    """The factor of the best score, among ``steps`` up to twice the median
    mean; the smallest of equal ones. None without clusters."""
    middle = clusters.agg(F.median(mean)).first()[0]
    if middle is None:
        return None
    factors = [2 * middle * (k + 1) / steps for k in range(steps)]
    return best_row(coverage_comb(clusters, mean, sd, factors, most, purity, weight), [], "score", ["k"]).first()["k"]


def copy_number(mean: Column, k: Column, most: int = 5) -> Column:
    """The level nearest to a mean."""
    return F.least(F.greatest(F.round(mean / k), F.lit(0.0)), F.lit(float(most)))


def assign(points: DataFrame, ids: list[str], value: str, clusters: list[tuple[int, float, float]], low: float, high: float, null: int = -1) -> DataFrame:
    """(ids, cluster, loglik): the likeliest of normal clusters (number, mean,
    deviation) or of a uniform on [low, high), which is ``null``.

    Clusters are few: they are part of the expression. Ties: the first.
    """
    options = [F.struct((-normal_logpdf(F.col(value), F.lit(m), F.lit(s))).alias("l"), F.lit(c).alias("c")) for c, m, s in clusters]
    options.append(F.struct(F.lit(-_uniform(low, high)).alias("l"), F.lit(null).alias("c")))
    best = F.array_min(F.array(*options))
    return points.select(*ids, best["c"].alias("cluster"), (-best["l"]).alias("loglik"))


def _uniform(low: float, high: float) -> float:
    return -math.log(high - low)
