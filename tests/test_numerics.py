import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import special
from strandline.operators import regression


def test_lgamma_and_beta(spark):
    xs = [0.3, 1.0, 1.5, 2.0, 7.25, 40.0, 1e3, 1e7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    assert special.np_lgamma(np.array(xs)).tolist() == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def test_incomplete_beta_and_quantile():
    # I_x(a, b) for whole a, b is a binomial tail
    for a, b in ((1, 1), (3, 5), (20, 4), (200, 230)):
        n = a + b - 1
        for x in (0.05, 0.3, 0.5, 0.77):
            tail = sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
            assert special.beta_cdf(x, a, b) == pytest.approx(tail, rel=1e-10, abs=1e-14)
            assert math.exp(special.beta_logsf(x, a, b)) == pytest.approx(1 - tail, rel=1e-8, abs=1e-13)
    q = special.beta_ppf([0.05, 0.5, 0.95], 12, 30)
    assert special.beta_cdf(q, 12, 30) == pytest.approx([0.05, 0.5, 0.95], abs=1e-10)


def test_wright_omega():
    z = np.array([-20.0, -3, -1, 0, 1, 2.5, 30, 1000])
    w = special.wright_omega(z)
    assert w + np.log(w) == pytest.approx(z, abs=1e-10)


def test_lnp_derivatives_match_differences_and_nodes():
    rng = np.random.default_rng(0)
    x, base = rng.poisson(60, 40).astype(float), rng.normal(0, 0.2, 40)
    prior = regression.LnpPrior()
    for mu, ls in ((4.0, -1.0), (4.2, -2.0), (3.8, -0.5)):
        value, grad, hess = regression.lnp_derivatives(x, base, mu, ls, prior)
        h = 1e-5
        f = lambda a, b: regression.lnp_loglik(x, base, a, b, prior)
        assert value == pytest.approx(f(mu, ls))
        assert grad == pytest.approx([(f(mu + h, ls) - f(mu - h, ls)) / (2 * h), (f(mu, ls + h) - f(mu, ls - h)) / (2 * h)], rel=1e-4, abs=1e-3)
        g = lambda a, b: regression.lnp_derivatives(x, base, a, b, prior)[1]
        assert hess == pytest.approx(np.array([(g(mu + h, ls) - g(mu - h, ls)) / (2 * h), (g(mu, ls + h) - g(mu, ls - h)) / (2 * h)]), rel=1e-3, abs=1e-2)
        assert value == pytest.approx(regression.lnp_loglik(x, base, mu, ls, prior, nodes=200), abs=1e-6)


def test_lnp_recovers_planted_values(spark):
    rng = np.random.default_rng(5)
    rows = []
    for group, (mu, sigma) in enumerate(((3.0, 0.3), (4.5, 0.15))):
        for c in rng.normal(0, 1, 600):
            rows.append((group, int(rng.poisson(math.exp(rng.normal(mu, sigma) + 0.2 * c + 0.5))), float(c)))
    df = spark.createDataFrame(rows, "seg long, x long, c double")
    fits = {r.seg: r for r in regression.fit_lnp_groups(df, ["seg"], "x", ["c"], [0.2], exposure=0.5).collect()}
    assert fits[0].mu == pytest.approx(3.0, abs=0.06) and math.exp(fits[0].log_sigma) == pytest.approx(0.3, abs=0.05)
    assert fits[1].mu == pytest.approx(4.5, abs=0.03) and math.exp(fits[1].log_sigma) == pytest.approx(0.15, abs=0.03)
    assert regression.laplace_evidence(fits[0].loglik, np.array(fits[0].hessian).reshape(2, 2)) < fits[0].loglik + 5


def test_poisson_regression_recovers_planted_values(spark):
    rng = np.random.default_rng(6)
    rows = []
    for seg, mu in enumerate((1.0, 2.0, 3.5)):
        for a, b in rng.normal(0, 0.5, (800, 2)):
            rows.append((seg, int(rng.poisson(math.exp(mu + 0.7 * a - 0.4 * b + 0.3))), float(a), float(b)))
    fit = regression.poisson_regression(spark.createDataFrame(rows, "seg int, x long, a double, b double"), "seg", "x", ["a", "b"], exposure=0.3)
    assert fit.gradient < 1e-5 and fit.beta == pytest.approx([0.7, -0.4], abs=0.03)
    assert [r.mu for r in fit.mu.orderBy("seg").collect()] == pytest.approx([1.0, 2.0, 3.5], abs=0.06)


def test_poisson_regression_equals_plain_newton(spark):
    """The mode under the priors, by Newton steps over the whole design; one
    segment of few counts, where the prior of mu has a say."""
    rng = np.random.default_rng(12)
    seg = np.repeat([0, 1, 2], [40, 25, 3])
    x = rng.normal(0, 0.4, (len(seg), 2))
    r = np.array([*rng.poisson(np.exp(2 + x[:65] @ [0.5, -0.3])), 0, 0, 1], dtype=float)
    design = np.column_stack([np.eye(3)[seg], x])
    prior = np.array([0.1] * 3 + [1 / math.sqrt(10)] * 2)
    w = np.zeros(5)
    for _ in range(200):
        rate = np.exp(design @ w)
        move = np.linalg.solve(design.T @ (design * rate[:, None]) + np.diag(prior), design.T @ (r - rate) - prior * w)
        w += move / max(1.0, np.abs(move).max())
    rows = spark.createDataFrame([(int(s), float(n), float(a), float(b)) for s, n, (a, b) in zip(seg, r, x)], "seg int, x double, a double, b double")
    fit = regression.poisson_regression(rows, "seg", "x", ["a", "b"])
    assert fit.beta == pytest.approx(w[3:], abs=1e-6)
    assert [m.mu for m in fit.mu.orderBy("seg").collect()] == pytest.approx(w[:3].tolist(), abs=1e-6)


def test_outliers(spark):
    rng = np.random.default_rng(7)
    values = rng.negative_binomial(20, 0.2, 3000).tolist() + [5000, 9000]
    df = spark.createDataFrame([(int(v),) for v in values], "x long")
    assert regression.negative_binomial_outliers(df, "x").filter("nb_outlier").count() == 2
    mean, size = regression.negative_binomial_fit([(v, 1) for v in values[:-2]])
    assert mean == pytest.approx(80, rel=0.05) and size == pytest.approx(20, rel=0.2)
    with_mean = df.withColumn("g", F.lit(1)).withColumn("m", F.lit(80.0)).filter("x < 100 or x > 1000")
    assert regression.poisson_outliers(with_mean.filter("x > 50 or x > 1000"), ["g"], "x", "m").filter("x > 1000").count() == 0
