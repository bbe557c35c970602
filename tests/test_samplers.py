import math

import numpy as np
import pytest

from strandline.operators import allelic_mcmc, coverage_mcmc, dirichlet


def planted(rng, fractions, n, depth=40):
    total = rng.poisson(depth, n * len(fractions)) + 1
    f = np.repeat(fractions, n)
    major = rng.binomial(total, f)
    return major, total - major


def test_allelic_segments_find_planted_breakpoints(spark):
    rng = np.random.default_rng(0)
    major, minor = planted(rng, [0.5, 0.8, 0.5], 100)
    rows = [("a", i, int(x), int(y)) for i, (x, y) in enumerate(zip(major, minor))]
    null_major, null_minor = planted(rng, [0.5], 150)
    rows += [("b", i, int(x), int(y)) for i, (x, y) in enumerate(zip(null_major, null_minor))]
    df = spark.createDataFrame(rows, "arm string, place long, maj long, mino long").repartition(5)
    run = lambda: allelic_mcmc.allelic_segments(df, ["arm"], "place", "maj", "mino", iterations=2000, draws=5, seed=3)
    got = run().toPandas()
    assert got.equals(run().toPandas()) or sorted(map(tuple, got.values)) == sorted(map(tuple, run().toPandas().values))
    for (arm, _), g in got.groupby(["arm", "draw"]):
        g = g.sort_values("seg_start")
        assert g.seg_start.iloc[0] == 0 and (g.seg_start.iloc[1:].to_numpy() == g.seg_end.iloc[:-1].to_numpy()).all()
        assert g.major.sum() == sum(r[2] for r in rows if r[0] == arm)
        state = allelic_mcmc.Segmentation(*np.array([(r[2], r[3]) for r in rows if r[0] == arm]).T)
        state.breaks = g.seg_start.iloc[1:].tolist()
        assert state.loglik() == pytest.approx(g.loglik.iloc[0])
    last = got[(got.arm == "a") & (got.draw == 4)].seg_start.tolist()
    assert any(abs(x - 100) <= 4 for x in last) and any(abs(x - 200) <= 4 for x in last) and len(last) <= 6
    assert got[(got.arm == "b") & (got.draw == 4)].shape[0] <= 3
    support = {(r.arm, r.place): r.share for r in allelic_mcmc.breakpoint_support(run(), ["arm"]).collect()}
    assert max(v for (arm, p), v in support.items() if arm == "a" and abs(p - 100) <= 4) > 0.3


def test_split_posterior_is_exact():
    s = allelic_mcmc.Segmentation(np.array([3, 9, 2, 30]), np.array([4, 8, 20, 1]), prior=0.0)
    scores = s.split_scores(0, 4)
    whole = [s.evidence(0, m) + s.evidence(m, 4) for m in (1, 2, 3)] + [s.evidence(0, 4)]
    assert np.exp(scores).sum() == pytest.approx(1) and scores - scores[0] == pytest.approx(np.array(whole) - whole[0])


def test_coverage_segments_find_planted_change(spark):
    rng = np.random.default_rng(2)
    rows = [("s", i, int(rng.poisson(math.exp(rng.normal(3.0 if i < 25 else 3.9, 0.1))))) for i in range(50)]
    rows += [("t", i, int(rng.poisson(math.exp(rng.normal(3.0, 0.1))))) for i in range(30)]
    df = spark.createDataFrame(rows, "seg string, place long, x long")
    got = coverage_mcmc.coverage_segments(df, ["seg"], "place", "x", [], [], iterations=40, draws=3, seed=1).toPandas()
    last = got[(got.seg == "s") & (got.draw == 2)].sort_values("seg_start")
    assert any(abs(x - 25) <= 2 for x in last.seg_start) and len(last) <= 4
    assert got[(got.seg == "t") & (got.draw == 2)].shape[0] <= 2
    collected = coverage_mcmc.collect_segments(spark.createDataFrame(got), ["seg"]).filter("best").toPandas()
    assert sorted(collected.seg_id) == list(range(len(collected))) and collected.draw.nunique() == 1


def test_peaks_and_kernel():
    x = np.array([0, 5, 4, 0, 0, 6, 0.0])
    assert coverage_mcmc.spaced_peaks(x, 1.0, 3).tolist() == [1, 5]
    assert coverage_mcmc.change_kernel(np.r_[np.zeros(30), np.ones(30)], 10).argmax() == 29


def test_allelic_clusters_recover_planted(spark):
    rng = np.random.default_rng(4)
    truth = rng.choice([0, 1], 30)
    flips = rng.random(30) < 0.5
    rows = []
    for k, (c, f) in enumerate(zip(truth, flips)):
        a = rng.binomial(800, [0.5, 0.2][c])
        rows.append((1, k, int(800 - a if f else a), int(a if f else 800 - a), 20))
    df = spark.createDataFrame(rows, "sample int, seg long, mi long, ma long, sites long")
    got = dirichlet.allelic_clusters(df, ["sample"], "seg", "mi", "ma", "sites", sweeps=20, draws=2, seed=2).toPandas()
    last = got[got.draw == 1].sort_values("seg")
    low = last.cluster[truth == 1]
    assert low.nunique() == 1 and low.iloc[0] not in set(last.cluster[truth == 0])


def test_clustering_loglik_matches_numpy(spark):
    rows = [(1, 0, 5, 9, False), (1, 0, 20, 3, True), (1, 1, 7, 7, False), (2, 3, 1, 1, True)]
    df = spark.createDataFrame(rows, "s int, c int, mi long, ma long, f boolean")
    got = {r.s: (r.clusters, r.loglik) for r in dirichlet.clustering_loglik(df, ["s"], "c", "mi", "ma", "f").collect()}
    lb, lg = dirichlet.np_betaln, math.lgamma
    assert got[1] == (2, pytest.approx(float(lb(5 + 3 + 2, 9 + 20 + 2)) + float(lb(9, 9)) + lg(2) + lg(1) + lg(1) - lg(4)))


def test_coverage_and_ratio_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(0, s, int(rng.poisson(math.exp(rng.normal([3.0, 4.0][s % 2], 0.1)))), 0.0) for s in range(6) for _ in range(15 if s < 5 else 5)]
    df = spark.createDataFrame(rows, "draw int, seg long, x long, base double")
    got = dirichlet.coverage_clusters(df, ["draw"], "seg", "x", "base", sweeps=4).toPandas().sort_values("seg")
    assert got.cluster[got.seg % 2 == 0].nunique() == 1 and got.cluster.nunique() == 2
    segs = [(0, k, 50.0, float(m), 50 * 0.04) for k, m in enumerate([1.0, 1.02, 2.0, 2.01, 0.99, 3.0])]
    ratio = dirichlet.copy_ratio_clusters(spark.createDataFrame(segs, "c int, seg long, n double, m double, ssd double"), ["c"], "seg", "n", "m", "ssd", iterations=600, alpha=3.0, beta=0.1).toPandas().sort_values("seg")
    assert ratio.cluster.tolist() == [0, 0, 1, 1, 0, 2]


def test_merge_and_evidence():
    x = np.array([1.0, 2.0, 4.0, 8.0])
    whole = (4.0, x.mean(), ((x - x.mean()) ** 2).sum())
    parts = [(1.0, v, 0.0) for v in x]
    out = (0.0, 0.0, 0.0)
    for p in parts:
        out = dirichlet.merged(out, p)
    assert out == pytest.approx(whole)
    assert dirichlet.count_prior(1.0, 3.0, 5.0, 1.0) > dirichlet.count_prior(1.0, None, 5.0, 1.0)


def test_long_segments_split_at_planted_places():
    rng = np.random.default_rng(5)
    for n, places in ((600, (333,)), (1600, (500, 1100))):
        level = np.repeat([60.0, 90.0, 50.0][: len(places) + 1], np.diff([0, *places, n]))
        state = coverage_mcmc.CoverageSegmentation(rng.poisson(level), np.zeros(n))
        found = state.candidates(0, n)
        assert len(found) < n / 10
        for place in places:
            assert np.abs(found - place).min() <= coverage_mcmc.WALK_STEPS
        best = max(state.run(120, 5, rng), key=lambda d: d[1])[0]
        assert all(min(abs(b - place) for b in best) <= 3 for place in places)


def test_narrow_and_wide_kernels():
    x = np.random.default_rng(2).random(80)
    plain = [abs(x[at : at + 12].sum() - x[at - 12 : at].sum()) for at in range(12, 69)]
    weighed = [v * np.exp(2 * abs(k - len(plain) / 2) / len(plain)) for k, v in enumerate(plain)]
    got = coverage_mcmc.change_kernel(x, 12)
    assert len(got) == 79 and np.allclose(got[11:68], weighed) and not got[:11].any() and not got[68:].any()
    assert np.allclose(coverage_mcmc.change_kernel(x, 10)[9], abs(x[10:20].sum() - x[:10].sum()))
