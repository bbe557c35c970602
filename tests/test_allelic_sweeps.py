"""Sweeps of allelic segments: the moves one by one, in fewer calls; the query runs all of them."""

import numpy as np

from strandline.operators import dirichlet
from strandline.plans import catalog


def planted(n, depth, seed):
    rng = np.random.default_rng(seed)
    total = rng.integers(depth // 4, depth, n)
    minor = rng.binomial(total, np.clip(rng.normal(rng.choice([0.2, 0.35, 0.5], n), 0.03), 0.01, 0.99))
    turned = rng.random(n) < 0.3
    return np.where(turned, total - minor, minor), np.where(turned, minor, total - minor), total // 50 + 1


def test_sweeps_are_moves_one_by_one():
    for n, depth in ((1, 40), (2, 4000), (40, 12), (150, 60), (150, 6000)):
        counts = planted(n, depth, n)
        one, all_ = (dirichlet.AllelicClusters(*counts, seed=5) for _ in range(2))
        for _ in range(12):
            for k in one.rng.permutation(n):
                one.move(int(k))
            all_.sweep()
            assert (one.cluster == all_.cluster).all() and (one.flipped == all_.flipped).all() and (one.names == all_.names).all()
            assert np.allclose(one.sums, all_.sums) and np.isclose(one.loglik(), all_.loglik())


def test_a_settled_chain_weighs_many_moves_in_a_call(monkeypatch):
    rng = np.random.default_rng(1)
    minor = rng.binomial(2000, np.repeat([0.1, 0.3], 500))
    state, calls = dirichlet.AllelicClusters(minor, 2000 - minor, np.full(1000, 20), seed=3), []
    for _ in range(5):
        state.sweep()
    monkeypatch.setattr(dirichlet, "np_lgamma", lambda x, real=dirichlet.np_lgamma: calls.append(1) or real(x))
    state.sweep()
    assert len(calls) < 100


def test_query_runs_all_sweeps_and_draws(spark, sf, monkeypatch):
    asked, real = [], dirichlet.allelic_clusters
    monkeypatch.setattr(dirichlet, "allelic_clusters", lambda *a, **k: asked.append(k) or real(*a, **k))
    rows = catalog.QUERIES["dp_clusters"](spark, sf)
    assert asked == [{}]
    draws = rows.groupBy("sample", "draw").count().collect()
    samples = {r["sample"] for r in draws}
    assert sorted((r["sample"], r["draw"]) for r in draws) == [(s, d) for s in sorted(samples) for d in range(100)]
