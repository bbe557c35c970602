"""Bayesian segmentation of allele counts along an arm.

A segmentation is a set of breakpoints between sites; its likelihood is the
product of the Beta-binomial evidences of its segments. Metropolis-Hastings
moves join two neighbours at a random breakpoint or split a random segment at
a place drawn from its split posterior. Picking among k breakpoints and, after
a join, among k segments is equally likely, so the proposal ratio is the split
posterior alone.

Each arm is one chain, seeded by the master seed and the arm: arms run in
parallel and a repeated task repeats its draws.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import logsumexp, np_betaln


def seed_of(*parts: object) -> int:
    """A seed that depends on its parts alone, not on the process."""
    return zlib.crc32(repr(parts).encode())


class Segmentation:
    """Breakpoints over sites with counts, and moves on them."""

    def __init__(self, major: np.ndarray, minor: np.ndarray, prior: float | None = None) -> None:
        self.n = len(major)
        self.a = np.concatenate([[0.0], np.cumsum(major, dtype=float)])
        self.b = np.concatenate([[0.0], np.cumsum(minor, dtype=float)])
        mean = (self.a[-1] + self.b[-1]) / max(self.n, 1)
        self.h = mean / 4 if prior is None else prior
        self.breaks = list(range(1, self.n))
        self.memo: dict[tuple[int, int], float] = {}

    def evidence(self, st: int, en: int) -> float:
        key = (st, en)
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            one = 1 + self.h
            self.memo[key] = float(np_betaln(self.a[en] - self.a[st] + one, self.b[en] - self.b[st] + one))
        return self.memo[key]

    def split_scores(self, st: int, en: int) -> np.ndarray:
        """Log posterior of a split before each of st+1 .. en-1, and of none."""
        mid = np.arange(st + 1, en)
        one = 1 + self.h
        left = np_betaln(self.a[mid] - self.a[st] + one, self.b[mid] - self.b[st] + one)
        right = np_betaln(self.a[en] - self.a[mid] + one, self.b[en] - self.b[mid] + one)
        scores = np.append(left + right, self.evidence(st, en))
        return scores - logsumexp(scores)

    def bounds(self, k: int) -> tuple[int, int]:
        return (self.breaks[k - 1] if k else 0), (self.breaks[k] if k < len(self.breaks) else self.n)

    def combine(self, k: int, rng: np.random.Generator) -> bool:
        st, mid, en = self.bounds(k)[0], self.breaks[k], self.bounds(k + 1)[1]
        gain = self.evidence(st, en) - self.evidence(st, mid) - self.evidence(mid, en)
        if math.log(rng.random() + 1e-300) < gain + self.split_scores(st, en)[mid - st - 1]:
            del self.breaks[k]
            return True
        return False

    def split(self, k: int, rng: np.random.Generator) -> bool:
        st, en = self.bounds(k)
        if en - st < 2:
            return False
        scores = self.split_scores(st, en)
        pick = int(np.searchsorted(np.cumsum(np.exp(scores)), rng.random()))
        if pick >= len(scores) - 1:
            return False
        mid = st + 1 + pick
        gain = self.evidence(st, mid) + self.evidence(mid, en) - self.evidence(st, en)
        if math.log(rng.random() + 1e-300) < gain - scores[pick]:
            bisect.insort(self.breaks, mid)
            return True
        return False

    def settle(self) -> None:
        """Joins neighbours while that raises the likelihood, best first within
        a sweep of pairs: a start near a mode instead of one site a segment."""
        changed = True
        while changed and self.breaks:
            changed, kept, st = False, [], 0
            edges = [*self.breaks, self.n]
            for mid, en in zip(edges, edges[1:]):
                if self.evidence(st, en) >= self.evidence(st, mid) + self.evidence(mid, en):
                    changed = True
                else:
                    kept.append(mid)
                    st = mid
            self.breaks = kept

    def loglik(self) -> float:
        edges = [0, *self.breaks, self.n]
        return sum(self.evidence(a, b) for a, b in zip(edges, edges[1:]))

    def run(self, iterations: int, draws: int, rng: np.random.Generator) -> list[tuple[list[int], float]]:
        """Breakpoints and likelihood of draws spaced over the second half."""
        self.settle()
        out, burn = [], iterations // 2
        every = max(1, (iterations - burn) // max(draws, 1))
        for i in range(iterations):
            if self.breaks and rng.random() < 0.5:
                self.combine(int(rng.integers(len(self.breaks))), rng)
            else:
                self.split(int(rng.integers(len(self.breaks) + 1)), rng)
            if i >= burn and (i - burn) % every == every - 1 and len(out) < draws:
                out.append((list(self.breaks), self.loglik()))
        return out or [(list(self.breaks), self.loglik())]


SCHEMA = "draw int, seg_start bigint, seg_end bigint, major double, minor double, loglik double"


def allelic_segments(sites: DataFrame, keys: list[str], order: str, major: str, minor: str, iterations: int = 20_000, draws: int = 10, seed: int = 1, prior: float | None = None) -> DataFrame:
    """(keys, draw, seg_start, seg_end, major, minor, loglik): segmentations
    drawn for each key. Places count from 0 in ``order``; [start, end)."""
    kinds = dict(sites.dtypes)

    def chain(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        state = Segmentation(p[major].to_numpy(float), p[minor].to_numpy(float), prior)
        rows = []
        for d, (breaks, loglik) in enumerate(state.run(iterations, draws, np.random.default_rng(seed_of(seed, *key)))):
            edges = [0, *breaks, state.n]
            rows += [(*key, d, a, b, state.a[b] - state.a[a], state.b[b] - state.b[a], loglik) for a, b in zip(edges, edges[1:])]
        return pd.DataFrame(rows, columns=[*keys, "draw", "seg_start", "seg_end", "major", "minor", "loglik"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + SCHEMA
    return sites.select(*keys, order, major, minor).groupBy(*keys).applyInPandas(chain, schema)


def breakpoint_support(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, share): share of draws with a breakpoint at each place."""
    total = segments.groupBy(*keys).agg(F.count_distinct("draw").alias("__d"))
    places = segments.filter("seg_start > 0").groupBy(*keys, F.col("seg_start").alias("place")).agg(F.count(F.lit(1)).alias("__k"))
    return places.join(total, keys).select(*keys, "place", (F.col("__k") / F.col("__d")).alias("share"))


def merge_chunks(chunks: DataFrame, key: str = "arm") -> DataFrame:
    """Segmentations of chunks as one per arm: places shifted by the chunk's
    start, likelihoods added. chunks: (arm, chunk_start, draw, ...)."""
    shifted = chunks.withColumn("seg_start", F.col("seg_start") + F.col("chunk_start")).withColumn("seg_end", F.col("seg_end") + F.col("chunk_start"))
    total = chunks.select(key, "draw", "chunk_start", "loglik").distinct().groupBy(key, "draw").agg(F.sum("loglik").alias("loglik"))
    return shifted.drop("loglik", "chunk_start").join(total, [key, "draw"])
