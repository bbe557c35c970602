"""Bayesian segmentation of coverage within an allelic segment.

Counts of a segment are log-normal Poisson around one mean; its evidence is
the Laplace approximation at the mode of (mu, log sigma). A random segment is
split where a draw among candidates and staying whole says, or joined with its
neighbour by a draw between two and one. All places are candidates of short
segments; of long ones, places where sums to both sides differ most, and from
each good one the places to its left and right as long as they are likely.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.special import logsumexp
from strandline.operators.allelic_mcmc import seed_of
from strandline.operators.regression import LnpPrior, laplace_evidence, lnp_fit, prior_constant

EXHAUSTIVE = 150
LEAST_SIDE = 2
#: Kernel widths and least distances of peaks, by what the
#: segment's length is beyond; the share of places below a peak; candidates
#: beside the peaks, so far from both ends of segments up to a length.
WIDTHS = ((50_000, (1000,)), (10_000, (500,)), (5000, (500, 100, 25)), (1000, (100, 50, 25)), (0, (50, 10)))
SPACING = ((50_000, 10_000), (5000, 1000), (0, 50))
PEAK_SHARE, RIM, RIMMED = 0.98, 10, 1000
#: Places this much less likely than the best peak are not walked from or to;
#: steps to a side, fewer in segments beyond a length.
WALK_RANGE, WALK_STEPS, WALK_STEPS_LONG, WALK_LONG = 5.0, 15, 5, 25_000


def spaced_peaks(x: np.ndarray, least: float, distance: int) -> np.ndarray:
    """Places at or above ``least``, highest first, none nearer than
    ``distance`` to a higher one; in order of place."""
    kept: list[int] = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < least:
            break
        if all(abs(int(k) - j) >= distance for j in kept):
            kept.append(int(k))
    return np.array(sorted(kept), dtype=int)


def change_kernel(residual: np.ndarray, width: int) -> np.ndarray:
    """|sum to the right - sum to the left| of ``width`` values at each place
    between values, 0 where a side has fewer. Widths above 10 weigh places
    by their distance from the middle, up to e at the rims."""
    n = len(residual)
    out, at = np.zeros(max(n - 1, 0)), np.arange(width, n - width + 1)
    c = np.concatenate([[0.0], np.cumsum(residual)])
    out[at - 1] = np.abs(c[at + width] - 2 * c[at] + c[at - width])
    if width > 10:
        out[at - 1] *= np.exp(2 * np.abs(np.arange(len(at)) - len(at) / 2) / max(len(at), 1))
    return out


class CoverageSegmentation:
    def __init__(self, counts: np.ndarray, base: np.ndarray, prior: LnpPrior | None = None) -> None:
        self.x, self.base = np.asarray(counts, float), np.asarray(base, float)
        self.n = len(self.x)
        self.breaks: list[int] = []
        start = math.log(max(float((self.x / np.exp(self.base)).mean()), 1e-6)) if self.n else 0.0
        self.prior = prior or LnpPrior(mean=start)
        self.memo: dict[tuple[int, int], tuple[float, float, float]] = {}

    def fit(self, st: int, en: int) -> tuple[float, float, float]:
        """(evidence, mu, log sigma) of a segment."""
        if (st, en) not in self.memo:
            found = lnp_fit(self.x[st:en], self.base[st:en], self.prior)
            if found is None:
                found = lnp_fit(self.x[st:en], self.base[st:en], self.prior, nodes=400, radius=50.0)
            self.memo[st, en] = (laplace_evidence(found[3], found[2]) + prior_constant(self.prior), found[0], found[1]) if found else (-math.inf, math.nan, math.nan)
        return self.memo[st, en]

    def candidates(self, st: int, en: int) -> np.ndarray:
        inside = np.arange(st + LEAST_SIDE, en - LEAST_SIDE + 1)
        if en - st < EXHAUSTIVE:
            return inside
        n, residual = en - st, self.x[st:en] / np.exp(self.base[st:en])
        distance = next(d for beyond, d in SPACING if n > beyond)
        # kernels do not reach the rims of shorter segments
        peaks = {st + RIM, en - RIM} if n <= RIMMED else set()
        for width in next(w for beyond, w in WIDTHS if n > beyond):
            if 2 * width < n:
                score = change_kernel(residual, width)
                least = float(np.quantile(score[width - 1 : n - width], PEAK_SHARE))
                peaks.update((spaced_peaks(score, least, distance) + st + 1).tolist())
        found = np.array(sorted(peaks), dtype=int)
        found = found[(found >= inside[0]) & (found <= inside[-1])]
        return found if len(found) else inside

    def scored(self, st: int, en: int) -> tuple[np.ndarray, np.ndarray]:
        """Places to split at and the evidence of each split."""
        places = self.candidates(st, en)
        found = {int(m): self.fit(st, m)[0] + self.fit(m, en)[0] for m in places}
        if en - st >= EXHAUSTIVE and found:
            least = max(found.values()) - WALK_RANGE
            steps = WALK_STEPS_LONG if en - st > WALK_LONG else WALK_STEPS
            for peak in [m for m, score in found.items() if score > least]:
                for side in (-1, 1):
                    for m in range(peak + side, peak + side * (steps + 1), side):
                        if m in found or not st + LEAST_SIDE <= m <= en - LEAST_SIDE:
                            break
                        score = self.fit(st, m)[0] + self.fit(m, en)[0]
                        if not score > least:
                            break
                        found[m] = score
        places = np.array(sorted(found), dtype=int)
        return places, np.array([found[int(m)] for m in places])

    def split(self, k: int, rng: np.random.Generator) -> None:
        edges = [0, *self.breaks, self.n]
        st, en = edges[k], edges[k + 1]
        if en - st < 2 * LEAST_SIDE:
            return
        places, scores = self.scored(st, en)
        scores = np.append(scores, self.fit(st, en)[0])
        # splits share the prior weight that staying has alone
        scores[:-1] -= math.log(max(len(places), 1))
        pick = int(np.searchsorted(np.cumsum(np.exp(scores - logsumexp(scores))), rng.random()))
        if pick < len(places):
            self.breaks = sorted([*self.breaks, int(places[pick])])

    def join(self, k: int, rng: np.random.Generator) -> None:
        edges = [0, *self.breaks, self.n]
        st, mid, en = edges[k], edges[k + 1], edges[k + 2]
        two = self.fit(st, mid)[0] + self.fit(mid, en)[0] - math.log(max(en - st - 2 * LEAST_SIDE + 1, 1))
        gain = two - self.fit(st, en)[0]
        if rng.random() < 1 / (1 + math.exp(min(max(gain, -700), 700))):
            del self.breaks[k]

    def loglik(self) -> float:
        edges = [0, *self.breaks, self.n]
        return sum(self.fit(a, b)[0] for a, b in zip(edges, edges[1:]))

    def run(self, iterations: int, draws: int, rng: np.random.Generator) -> list[tuple[list[int], float]]:
        out, burn = [], max(10, iterations // 2)
        every = max(1, (iterations - burn) // max(draws, 1))
        for i in range(iterations):
            if self.breaks and rng.random() < 0.5:
                self.join(int(rng.integers(len(self.breaks))), rng)
            else:
                self.split(int(rng.integers(len(self.breaks) + 1)), rng)
            if i >= burn and (i - burn) % every == every - 1 and len(out) < draws:
                out.append((list(self.breaks), self.loglik()))
        return out or [(list(self.breaks), self.loglik())]


def coverage_segments(bins: DataFrame, keys: list[str], order: str, count: str, covariates: list[str], beta: list[float], exposure: float = 0.0, iterations: int = 200, draws: int = 5, seed: int = 1) -> DataFrame:
    """(keys, draw, seg_start, seg_end, mu, log_sigma, loglik) of each key's
    bins in ``order``; places from 0, [start, end). One chain for each key."""
    kinds = dict(bins.dtypes)
    base = F.lit(float(exposure))
    for c, b in zip(covariates, beta):
        base = base + F.lit(float(b)) * F.col(c)

    def chain(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        state = CoverageSegmentation(p["__x"].to_numpy(), p["__base"].to_numpy())
        rows = []
        for d, (breaks, loglik) in enumerate(state.run(iterations, draws, np.random.default_rng(seed_of(seed, *key)))):
            edges = [0, *breaks, state.n]
            rows += [(*key, d, a, b, *state.fit(a, b)[1:], loglik) for a, b in zip(edges, edges[1:])]
        return pd.DataFrame(rows, columns=[*keys, "draw", "seg_start", "seg_end", "mu", "log_sigma", "loglik"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", draw int, seg_start bigint, seg_end bigint, mu double, log_sigma double, loglik double"
    return bins.select(*keys, order, F.col(count).cast("double").alias("__x"), base.alias("__base")).groupBy(*keys).applyInPandas(chain, schema)


def collect_segments(shards: DataFrame, keys: list[str]) -> DataFrame:
    """Shards of segmentations as one: segments numbered over all keys in each
    draw, and the draw of the highest total likelihood marked ``best``.

    NaN likelihoods count nothing. Ties: the smallest draw.
    """
    numbered = shards.withColumn("seg_id", F.dense_rank().over(Window.partitionBy("draw").orderBy(*keys, "seg_start")) - 1)
    clean = F.when(~F.isnan("loglik"), F.col("loglik"))
    total = shards.select(*keys, "draw", clean.alias("l")).distinct().groupBy("draw").agg(F.sum("l").alias("total"))
    top = total.agg(F.min(F.struct((-F.col("total")).alias("o"), "draw"))["draw"].alias("d")).first()
    return numbered.withColumn("best", F.col("draw") == F.lit(top["d"] if top else None))
