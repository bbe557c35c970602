"""Dirichlet-process clustering of segments: by allele counts with phase, by
coverage, and by allelic copy ratio.

Each is one chain for a sample (or draw, or class), seeded by the master seed
and the key; many samples run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import betaln, lgamma, logsumexp, normal_cdf, np_betaln, np_lgamma
from strandline.operators.allelic_mcmc import seed_of
from strandline.operators.regression import LnpPrior, laplace_evidence, lnp_fit, prior_constant


def pick(log_weights: np.ndarray, rng: np.random.Generator) -> int:
    """An index drawn by normalised weights."""
    p = np.exp(log_weights - logsumexp(log_weights))
    return min(int(np.searchsorted(np.cumsum(p), rng.random())), len(p) - 1)


def picks(log_weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """An index of each row drawn by its normalised weights, as ``pick``."""
    total = np.exp(log_weights - logsumexp(log_weights, axis=1)[:, None]).cumsum(axis=1)
    return np.minimum((total < chances[:, None]).sum(axis=1), log_weights.shape[1] - 1)


def count_prior(size: float, cluster: float | None, total: float, alpha: float) -> float:
    """Log weight of adding ``size`` items to a cluster of that many, or to a
    new one, of ``total`` with them."""
    rest = float(np_lgamma(total + alpha - size) - np_lgamma(total + alpha))
    if cluster is None:
        return float(np_lgamma(size)) + math.log(alpha) + rest
    return float(np_lgamma(size + cluster) - np_lgamma(cluster)) + rest


def rephase_probability(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probability that the minor fraction exceeds one half.

    Normal approximation where both counts exceed 20, else 1000 draws.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = a + b + 2
    mean, var = (a + 1) / n, (a + 1) * (b + 1) / (n * n * (n + 1))
    out = 1 - normal_cdf((0.5 - mean) / np.sqrt(var))
    for k in np.flatnonzero((a <= 20) | (b <= 20)):
        out[k] = (rng.beta(a[k] + 1, b[k] + 1, 1000) > 0.5).mean()
    return np.clip(out, 1e-6, 1 - 1e-6)


#: Arguments of gamma functions from a cluster's sums of minor and major counts
#: and sizes: its evidence with a segment, flipped or not (a, b, b, a, a + b),
#: and without (a, b, a + b), the prior of its size with it and without.
_TERMS = np.array([[1, 0, 1, 0, 1, 1, 0, 1, 0, 0], [0, 1, 0, 1, 1, 0, 1, 1, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 1, 1]], dtype=float)
#: Their signs in the log weight, by flip.
_SIGNS = np.array([[1, 1, 0, 0, -1, -1, -1, 1, 1, -1], [0, 0, 1, 1, -1, -1, -1, 1, 1, -1]], dtype=float).T
#: Weights of segments and clusters that are made in one call, about.
_WEIGHED = 4096
#: Tasks that chains are dealt to, so many that few chains share one.
_CHAIN_TASKS = 64


class AllelicClusters:
    """Segments in clusters of one minor fraction each, with phase flips."""

    def __init__(self, minor, major, sites, prior: float | None = None, alpha: float = 1.0, seed: int = 1) -> None:
        self.a, self.b = np.asarray(minor, float), np.asarray(major, float)
        self.size = np.asarray(sites, float) / max(float(np.mean(sites)), 1e-9)
        self.h = float((self.a + self.b).mean() / 2) if prior is None else prior
        self.alpha, self.rng = alpha, np.random.default_rng(seed)
        self.flip_prob = rephase_probability(self.a, self.b, self.rng)
        n = len(self.a)
        self.cluster, self.flipped = np.full(n, -1), np.zeros(n, dtype=bool)
        # a row for each cluster, in order of their making, and one of a new one: minor and major counts, sizes, segments
        self.names, self.sums = np.zeros(0, dtype=np.int64), np.zeros((1, 4))
        self.next = 0
        self.phase = np.column_stack([np.log1p(-self.flip_prob), np.log(self.flip_prob)])
        # what a segment adds to a cluster's sums in the arguments of _TERMS
        none, h = np.zeros(n), self.h
        self.adds = np.column_stack([self.a, self.b, self.b, self.a, self.a + self.b, none, none, none, self.size, none]) + np.array([1 + h, 1 + h, 1 + h, 1 + h, 2 + 2 * h, 1 + h, 1 + h, 2 + 2 * h, 0, 0])
        # and what it takes away as it leaves its own, by flip
        self.takes = np.stack([np.column_stack([*v, self.size]) @ _TERMS for v in ((self.a, self.b), (self.b, self.a))], axis=1)
        # of each segment and the next, of one orientation and of two: log odds that they are alike
        one, two = np.array([self.a[:-1], self.b[:-1]]), np.array([self.a[1:], self.b[1:]])
        apart = np_betaln(one[0] + 1, one[1] + 1) + np_betaln(two[0] + 1, two[1] + 1)
        gain = np.column_stack([np_betaln(one[0] + v[0] + 1, one[1] + v[1] + 1) - apart for v in (two, two[::-1])])
        # by the first one's place and one more (none: zeros), flip of one of the two, and flip of the other: unlike, alike less unlike
        self.near = np.zeros((n + 1, 2, 2, 2))
        for turn in (0, 1):
            g = gain[:, :: -1 if turn else 1]
            self.near[1:n, turn] = np.stack([-np.log1p(np.exp(np.minimum(g, 700))), np.clip(g, -700, 700)], axis=1)

    def oriented(self, k: int, flip: bool) -> tuple[float, float]:
        return (self.b[k], self.a[k]) if flip else (self.a[k], self.b[k])

    def _evidence(self, a, b):
        return np_betaln(a + 1 + self.h, b + 1 + self.h)

    def _leave(self, k: int) -> None:
        c = int(self.cluster[k])
        if c >= 0:
            at = int(np.searchsorted(self.names, c))
            self.sums[at] -= (*self.oriented(k, self.flipped[k]), self.size[k], 1)
            if self.sums[at, 3] == 0:
                self.names, self.sums = np.delete(self.names, at), np.delete(self.sums, at, axis=0)
            self.cluster[k] = -1

    def weights(self, ks: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log weights, but for a constant, of some segments: by segment,
        cluster (a new one last) and flip, all at once. They are in no cluster
        or, each as if it alone had left it, in those at ``own``."""
        row = np.arange(len(ks))
        terms = self.sums[:, :3] @ _TERMS + self.adds[ks][:, None]
        if own is not None:
            terms[row, own] -= self.takes[ks, self.flipped[ks].view(np.int8)]
        terms[:, -1, -1] = 1.0  # a new cluster's weight has alpha in place of the gamma function of its size
        out = np_lgamma(terms) @ _SIGNS + self.phase[ks][:, None]
        out[:, -1] += math.log(self.alpha)
        # neighbours that look like a segment draw it to their cluster, those that do not push it away
        for first, j in ((ks, ks - 1), (ks + 1, ks + 1)):
            c = self.cluster.take(j, mode="clip")
            near = self.near[first, self.flipped.take(j, mode="clip").view(np.int8)] * (c >= 0)[:, None, None]
            out += near[:, :1]
            out[row, self.names.searchsorted(c)] += near[:, 1]
        return out

    def scores(self, k: int) -> np.ndarray:
        """Log weights, but for a constant, of a segment that is in no
        cluster: by cluster (a new one last) and flip, all at once."""
        return self.weights(np.array([k]))[0]

    def _join(self, k: int, at: int, flip: bool) -> None:
        if at == len(self.names):
            self.names, self.sums = np.append(self.names, self.next), np.vstack([self.sums, np.zeros(4)])
            self.next += 1
        self.sums[at] += (*self.oriented(k, flip), self.size[k], 1)
        self.cluster[k], self.flipped[k] = self.names[at], flip

    def move(self, k: int, chance: float | None = None) -> None:
        """A segment leaves its cluster and joins one by a draw."""
        self._leave(k)
        chance = self.rng.random() if chance is None else chance
        at, flip = divmod(int(picks(self.scores(k).reshape(1, -1), np.array([chance]))[0]), 2)
        self._join(k, at, bool(flip))

    def sweep(self) -> None:
        """Every segment moves once, in random order.

        Most moves of a settled chain lead back to where they began and leave
        all as it was, so moves are weighed some at a time, as many as now
        pass without a change; those up to the first change hold.
        """
        order = self.rng.permutation(len(self.a))
        chance = self.rng.random(len(order))
        at = changes = 0
        while at < len(order):
            ks = order[at : at + min(1 + 2 * at // (changes + 1), 1 + _WEIGHED // len(self.sums))]
            own = self.names.searchsorted(self.cluster[ks])
            alone = (self.cluster[ks] < 0) | (self.sums[own, 3] == 1)  # in no cluster, or in one that ends as they leave
            if alone[0]:
                self.move(int(ks[0]), chance[at])
                at, changes = at + 1, changes + 1
                continue
            if alone.any():
                ks, own = ks[: alone.argmax()], own[: alone.argmax()]
            found = picks(self.weights(ks, own).reshape(len(ks), -1), chance[at : at + len(ks)])
            moved = found != 2 * own + self.flipped[ks]
            first = int(moved.argmax())
            if moved[first]:
                k, (to, flip) = int(ks[first]), divmod(int(found[first]), 2)
                self._leave(k)
                self._join(k, to, bool(flip))
                at, changes = at + first + 1, changes + 1
            else:
                at += len(ks)

    def loglik(self) -> float:
        s = self.sums[:-1]
        own = float(self._evidence(s[:, 0], s[:, 1]).sum())
        phase = np.where(self.flipped, np.log(self.flip_prob), np.log1p(-self.flip_prob)).sum()
        n = float(s[:, 2].sum())
        counts = float(np_lgamma(s[:, 2]).sum()) + len(s) * math.log(self.alpha) + float(np_lgamma(self.alpha) - np_lgamma(n + self.alpha))
        return own + float(phase) + counts

    def run(self, sweeps: int, draws: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        out, burn = [], sweeps // 2
        every = max(1, (sweeps - burn) // max(draws, 1))
        for i in range(sweeps):
            self.sweep()
            if i >= burn and (i - burn) % every == every - 1 and len(out) < draws:
                out.append((self.cluster.copy(), self.flipped.copy(), self.loglik()))
        return out or [(self.cluster.copy(), self.flipped.copy(), self.loglik())]


def allelic_clusters(segments: DataFrame, keys: list[str], order: str, minor: str, major: str, sites: str, sweeps: int = 200, draws: int = 100, seed: int = 1, prior: float | None = None) -> DataFrame:
    """(keys, order, draw, cluster, flipped, loglik) for each key's segments.

    The first half of the sweeps settles the chain. The reference takes 100
    draws, and all segments move between two of them.
    """
    kinds = dict(segments.dtypes)

    def chain(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        state = AllelicClusters(p[minor], p[major], p[sites], prior, seed=seed_of(seed, *key))
        for d, (cluster, flipped, loglik) in enumerate(state.run(sweeps, draws)):
            yield p[[*keys, order]].assign(draw=d, cluster=cluster, flipped=flipped, loglik=loglik)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, order]) + ", draw int, cluster int, flipped boolean, loglik double"
    # by number, so that adaptive plans leave each chain its task
    return segments.select(*keys, order, minor, major, sites).repartition(_CHAIN_TASKS, *keys).groupBy(*keys).applyInPandas(chain, schema)


def clustering_loglik(assigned: DataFrame, keys: list[str], cluster: str, minor: str, major: str, flipped: str, alpha: float = 1.0, prior: float = 1.0) -> DataFrame:
    """(keys, clusters, loglik): evidence of the clusters and of their sizes,
    from assignments, in aggregates alone."""
    a = F.when(F.col(flipped), F.col(major)).otherwise(F.col(minor)).cast("double")
    b = F.when(F.col(flipped), F.col(minor)).otherwise(F.col(major)).cast("double")
    own = assigned.groupBy(*keys, cluster).agg(F.sum(a).alias("__a"), F.sum(b).alias("__b"), F.count(F.lit(1)).cast("double").alias("__n"))
    part = betaln(F.col("__a") + 1 + prior, F.col("__b") + 1 + prior) + lgamma(F.col("__n")) + math.log(alpha)
    n = F.sum("__n")
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), (F.sum(part) + lgamma(F.lit(float(alpha))) - lgamma(n + alpha)).alias("loglik"))


class CoverageClusters:
    """Coverage segments in clusters of one log-normal Poisson each.

    Segments under 3 bins take no part (-1), those under 10 wait until the
    others have settled and then join their likeliest cluster.
    """

    def __init__(self, counts: list[np.ndarray], bases: list[np.ndarray], alpha: float = 0.5, seed: int = 1, start: list[int] | None = None) -> None:
        self.x, self.base = [np.asarray(c, float) for c in counts], [np.asarray(b, float) for b in bases]
        size = np.array([len(c) for c in self.x])
        self.white, self.grey = np.flatnonzero(size >= 10), np.flatnonzero((size >= 3) & (size < 10))
        self.alpha, self.rng = alpha, np.random.default_rng(seed)
        mean = np.concatenate(self.x).mean() if len(self.x) else 1.0
        self.prior = LnpPrior(mean=math.log(max(mean, 1e-6)))
        self.memo: dict[frozenset, tuple[float, float, float]] = {}
        self.cluster = np.full(len(self.x), -1)
        self.members: dict[int, set[int]] = {}
        for k in self.white:
            self._put(int(k), int(start[k]) if start is not None and start[k] >= 0 else int(k))

    def fit(self, members: frozenset) -> tuple[float, float, float]:
        """(evidence, mu, sigma) of the pooled bins of some segments."""
        if members not in self.memo:
            order = sorted(members)
            found = lnp_fit(np.concatenate([self.x[k] for k in order]), np.concatenate([self.base[k] for k in order]), self.prior)
            self.memo[members] = (laplace_evidence(found[3], found[2]) + prior_constant(self.prior), found[0], math.exp(found[1])) if found else (-math.inf, math.nan, math.nan)
        return self.memo[members]

    def _put(self, k: int, c: int) -> None:
        self.cluster[k] = c
        self.members.setdefault(c, set()).add(k)

    def move(self, k: int) -> None:
        c = int(self.cluster[k])
        self.members[c].discard(k)
        if not self.members[c]:
            del self.members[c]
        options = [*self.members, None]
        scores = []
        for o in options:
            own = frozenset(self.members[o]) if o is not None else frozenset()
            gain = self.fit(own | {k})[0] - (self.fit(own)[0] if own else 0.0)
            scores.append(gain + count_prior(1.0, float(len(own)) if own else None, float(len(self.white)), self.alpha))
        o = options[pick(np.array(scores), self.rng)]
        self._put(k, max(self.members, default=-1) + 1 if o is None else o)

    def merge_move(self) -> None:
        """Two random clusters join by a draw between two and one."""
        if len(self.members) < 2:
            return
        a, b = self.rng.choice(sorted(self.members), 2, replace=False)
        one, two = frozenset(self.members[a] | self.members[b]), (frozenset(self.members[a]), frozenset(self.members[b]))
        sizes = [float(len(s)) for s in two]
        gain = self.fit(one)[0] - self.fit(two[0])[0] - self.fit(two[1])[0] + float(np_lgamma(sum(sizes)) - np_lgamma(sizes[0]) - np_lgamma(sizes[1])) - math.log(self.alpha)
        if self.rng.random() < 1 / (1 + math.exp(min(max(-gain, -700), 700))):
            for k in self.members.pop(b):
                self._put(k, int(a))

    def run(self, sweeps: int) -> float:
        for _ in range(sweeps):
            for k in self.rng.permutation(self.white):
                self.move(int(k))
            self.merge_move()
        total = sum(self.fit(frozenset(m))[0] for m in self.members.values())
        names = {c: i for i, c in enumerate(sorted(self.members))}
        self.members = {names[c]: m for c, m in self.members.items()}
        for c, m in self.members.items():
            self.cluster[list(m)] = c
        fitted = {c: frozenset(m) for c, m in self.members.items()}
        for k in self.grey:
            scores = {c: self.fit(m | {int(k)})[0] - self.fit(m)[0] for c, m in fitted.items()}
            if scores:
                self.cluster[k] = max(scores, key=lambda c: (scores[c], -c))
        return total


def coverage_clusters(bins: DataFrame, keys: list[str], segment: str, count: str, base: str, sweeps: int = 10, seed: int = 1) -> DataFrame:
    """(keys, segment, cluster, mu, sigma, loglik) for each key, e.g. a draw."""
    kinds = dict(bins.dtypes)

    def chain(key, p: pd.DataFrame) -> pd.DataFrame:
        groups = [(s, g) for s, g in p.sort_values([segment]).groupby(segment)]
        state = CoverageClusters([g[count].to_numpy() for _, g in groups], [g[base].to_numpy() for _, g in groups], seed=seed_of(seed, *key))
        total = state.run(sweeps)
        rows = []
        for (s, _), c in zip(groups, state.cluster.tolist()):
            _, mu, sigma = state.fit(frozenset(state.members[c])) if c >= 0 else (0.0, math.nan, math.nan)
            rows.append((*key, s, c, mu, sigma, total))
        return pd.DataFrame(rows, columns=[*keys, segment, "cluster", "mu", "sigma", "loglik"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, segment]) + ", cluster int, mu double, sigma double, loglik double"
    return bins.select(*keys, segment, count, base).groupBy(*keys).applyInPandas(chain, schema)


# -- allelic copy ratio --------------------------------------------------------------------


def normal_gamma_evidence(n, mean, ssd, center: float, alpha: float = 100.0, beta: float = 30.0, kappa: float = 1e-6):
    """Log evidence of n values with mean and summed squared deviation."""
    n, mean, ssd = np.asarray(n, float), np.asarray(mean, float), np.asarray(ssd, float)
    kn, an = kappa + n, alpha + n / 2
    bn = beta + ssd / 2 + kappa * n * (mean - center) ** 2 / (2 * kn)
    return np_lgamma(an) - np_lgamma(np.asarray(alpha)) + alpha * math.log(beta) - an * np.log(bn) + 0.5 * (math.log(kappa) - np.log(kn)) - n / 2 * math.log(2 * math.pi)


def merged(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float]:
    """(n, mean, ssd) of two parts together."""
    n = a[0] + b[0]
    if n == 0:
        return 0.0, 0.0, 0.0
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


class CopyRatioClusters:
    """Segments (n, mean, ssd) in normal clusters; moves of single segments,
    splits and merges of clusters."""

    def __init__(self, n, mean, ssd, alpha: float = 0.5, seed: int = 1, **prior: float) -> None:
        self.stats = [(float(a), float(b), float(c)) for a, b, c in zip(n, mean, ssd)]
        total = sum(s[0] for s in self.stats)
        self.center = sum(s[0] * s[1] for s in self.stats) / total if total else 0.0
        self.alpha, self.prior, self.rng = alpha, prior, np.random.default_rng(seed)
        self.cluster = np.zeros(len(self.stats), dtype=int)
        self.members: dict[int, set[int]] = {0: set(range(len(self.stats)))} if self.stats else {}

    def pooled(self, members) -> tuple[float, float, float]:
        out = (0.0, 0.0, 0.0)
        for k in sorted(members):
            out = merged(out, self.stats[k])
        return out

    def evidence(self, members) -> float:
        return float(normal_gamma_evidence(*self.pooled(members), self.center, **self.prior)) if members else 0.0

    def _number(self, members: set[int]) -> int:
        c = max(self.members, default=-1) + 1
        self.members[c] = members
        self.cluster[list(members)] = c
        return c

    def move(self, k: int) -> None:
        c = int(self.cluster[k])
        self.members[c].discard(k)
        if not self.members[c]:
            del self.members[c]
        options = [*self.members, None]
        scores = [self.evidence(self.members[o] | {k}) - self.evidence(self.members[o]) + math.log(len(self.members[o])) if o is not None else self.evidence({k}) + math.log(self.alpha) for o in options]
        o = options[pick(np.array(scores), self.rng)]
        if o is None:
            self._number({k})
        else:
            self.members[o].add(k)
            self.cluster[k] = o

    def split(self) -> None:
        """A random cluster is cut along the order of means where a draw says."""
        c = int(self.rng.choice(sorted(self.members)))
        order = sorted(self.members[c], key=lambda k: (self.stats[k][1], k))
        if len(order) < 2:
            return
        up, down = [(0.0, 0.0, 0.0)], [(0.0, 0.0, 0.0)]
        for k in order:
            up.append(merged(up[-1], self.stats[k]))
        for k in reversed(order):
            down.append(merged(down[-1], self.stats[k]))
        down.reverse()
        left, right = np.array(up[1:-1]).T, np.array(down[1:-1]).T
        sizes = np.arange(1, len(order))
        scores = normal_gamma_evidence(*left, self.center, **self.prior) + normal_gamma_evidence(*right, self.center, **self.prior)
        scores = scores + np_lgamma(sizes.astype(float)) + np_lgamma((len(order) - sizes).astype(float)) + math.log(self.alpha) - math.log(len(sizes))
        scores = np.append(scores, self.evidence(self.members[c]) + float(np_lgamma(np.asarray(float(len(order))))))
        at = pick(scores, self.rng)
        if at < len(sizes):
            away = set(order[at + 1 :])
            self.members[c] -= away
            self._number(away)

    def merge(self) -> None:
        if len(self.members) < 2:
            return
        a, b = (int(c) for c in self.rng.choice(sorted(self.members), 2, replace=False))
        na, nb = float(len(self.members[a])), float(len(self.members[b]))
        gain = self.evidence(self.members[a] | self.members[b]) - self.evidence(self.members[a]) - self.evidence(self.members[b]) + float(np_lgamma(na + nb) - np_lgamma(na) - np_lgamma(nb)) - math.log(self.alpha)
        if self.rng.random() < 1 / (1 + math.exp(min(max(-gain, -700), 700))):
            away = self.members.pop(b)
            self.members[a] |= away
            self.cluster[list(away)] = a

    def loglik(self) -> float:
        n = float(len(self.stats))
        own = sum(self.evidence(m) + float(np_lgamma(float(len(m)))) for m in self.members.values())
        return own + len(self.members) * math.log(self.alpha) + float(np_lgamma(self.alpha) - np_lgamma(n + self.alpha))

    def run(self, iterations: int) -> None:
        for _ in range(iterations if self.stats else 0):
            u = self.rng.random()
            if u < 0.5:
                self.move(int(self.rng.integers(len(self.stats))))
            elif u < 0.75:
                self.split()
            else:
                self.merge()
        names = {c: i for i, c in enumerate(sorted(self.members, key=lambda c: self.pooled(self.members[c])[1]))}
        self.members = {names[c]: m for c, m in self.members.items()}
        self.cluster = np.array([names[int(c)] for c in self.cluster], dtype=int)


def copy_ratio_clusters(segments: DataFrame, keys: list[str], segment: str, n: str, mean: str, ssd: str, iterations: int = 2000, seed: int = 1, **prior: float) -> DataFrame:
    """(keys, segment, cluster, cluster_mean, cluster_sd, loglik); clusters
    numbered by their means."""
    kinds = dict(segments.dtypes)

    def chain(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(segment, kind="stable")
        state = CopyRatioClusters(p[n], p[mean], p[ssd], seed=seed_of(seed, *key), **prior)
        state.run(iterations)
        pools = {c: state.pooled(m) for c, m in state.members.items()}
        total = state.loglik()
        rows = [(*key, s, int(c), pools[c][1], math.sqrt(pools[c][2] / pools[c][0]), total) for s, c in zip(p[segment], state.cluster.tolist())]
        return pd.DataFrame(rows, columns=[*keys, segment, "cluster", "cluster_mean", "cluster_sd", "loglik"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, segment]) + ", cluster int, cluster_mean double, cluster_sd double, loglik double"
    return segments.select(*keys, segment, n, mean, ssd).groupBy(*keys).applyInPandas(chain, schema)
