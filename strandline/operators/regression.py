"""Regressions of counts: Poisson over all rows, log-normal Poisson by group."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.written import written
from strandline.functions.special import beta_logcdf, beta_logsf, legendre, logsumexp, np_lgamma, poisson_logpmf, wright_omega


@dataclass
class PoissonFit:
    """Coefficients, segment means, and how the iteration ended."""

    beta: np.ndarray
    mu: DataFrame
    iterations: int
    gradient: float


def poisson_regression(rows: DataFrame, segment: str, count: str, covariates: list[str], exposure: float = 0.0, offset: str | None = None, prior_variance: float = 10.0, prior_precision: float = 1 / math.sqrt(10), rounds: int = 100, tolerance: float = 1e-5) -> PoissonFit:
    """log E[count] = mu of the segment + covariates beta + exposure + offset.

    Normal priors: of variance ``prior_variance`` on mu, of precision
    ``prior_precision`` on beta. Newton steps: one pass gives, for each
    segment, sums of residuals and of expectations (with covariates), and for
    all rows the covariance sums. The Hessian is diagonal in the segments, so
    they are eliminated, again by sums: one row of the size of beta squared
    comes to the driver, which solves for beta. Segments stay a table, written
    down each round, and so are the rows once. Steps are clipped to 1.
    """
    p = len(covariates)
    base = written(rows.select(
        F.col(segment).alias("__s"), F.col(count).cast("double").alias("__r"), *[F.col(c).cast("double").alias(f"__c{k}") for k, c in enumerate(covariates)],
        (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("__o"),
    ), "poisson-rows")
    mu = written(base.groupBy("__s").agg((F.log(F.avg("__r") + 1e-3) - exposure).alias("m")), "poisson-means")
    beta, gradient, step = np.zeros(p), math.inf, 0
    inverse = 1.0 / prior_variance
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    e, d, c = F.col("__e"), F.col("__d"), [F.col(f"__c{k}") for k in range(p)]
    sums = [F.sum(d).alias("d"), F.sum(e).alias("e"), *[F.sum(e * c[k]).alias(f"ec{k}") for k in range(p)], *[F.sum(d * c[k]).alias(f"dc{k}") for k in range(p)], *[F.sum(e * c[j] * c[k]).alias(f"ecc{j}_{k}") for j, k in pairs]]
    g, h = F.col("d") - F.col("m") * inverse, F.col("e") + inverse
    ec = [F.col(f"ec{k}") for k in range(p)]
    schur = [F.sum(g * g).alias("gg"), *[F.sum(f"dc{k}").alias(f"d{k}") for k in range(p)], *[F.sum(ec[k] * g / h).alias(f"g{k}") for k in range(p)], *[F.sum(F.col(f"ecc{j}_{k}") - ec[j] * ec[k] / h).alias(f"h{j}_{k}") for j, k in pairs]]
    for step in range(1, rounds + 1):
        linear = F.col("m") + F.col("__o") + F.lit(float(exposure))
        for k in range(p):
            linear = linear + F.lit(float(beta[k])) * c[k]
        found = base.join(mu, "__s").withColumn("__e", F.exp(F.least(linear, F.lit(700.0)))).withColumn("__d", F.col("__r") - e)
        found = written(found.groupBy("__s").agg(F.first("m").alias("m"), *sums), "poisson-sums")
        total = found.agg(*schur).first()
        if total["gg"] is None:  # no rows
            break
        g_beta = np.array([total[f"d{k}"] for k in range(p)]) - prior_precision * beta
        gradient = float(np.sqrt(total["gg"] + (g_beta**2).sum()))
        if gradient < tolerance:
            break
        h_beta = np.eye(p) * prior_precision
        for j, k in pairs:
            h_beta[j, k] += total[f"h{j}_{k}"]
            h_beta[k, j] = h_beta[j, k]
        d_beta = np.linalg.solve(h_beta, g_beta - np.array([total[f"g{k}"] for k in range(p)])) if p else np.zeros(0)
        d_mu = g
        for k in range(p):
            d_mu = d_mu - ec[k] * F.lit(float(d_beta[k]))
        moves = found.select("__s", "m", (d_mu / h).alias("move"))
        largest = max([1.0, *np.abs(d_beta), moves.agg(F.max(F.abs("move"))).first()[0]])
        beta = beta + d_beta / largest
        mu = written(moves.select("__s", (F.col("m") + F.col("move") / F.lit(float(largest))).alias("m")), "poisson-means")
    return PoissonFit(beta, mu.select(F.col("__s").alias(segment), F.col("m").alias("mu")), step, gradient)


# -- log-normal Poisson -------------------------------------------------------------


@dataclass(frozen=True)
class LnpPrior:
    """Normal-inverse-gamma prior of (mu, sigma)."""

    mean: float = 0.0
    alpha: float = 1e-5
    beta: float = 4e-3
    strength: float = 1e-10


def _terms(x: np.ndarray, base: np.ndarray, mu: float, log_sigma: float, nodes: int, radius: float):
    """(log likelihood, E-weighted pieces) by quadrature around the mode.

    The integrand over a standard normal e of Poisson(exp(base + mu + sigma
    e)) is centred where it peaks, which the Wright omega function gives.
    """
    sigma = math.exp(log_sigma)
    peak = sigma * x - wright_omega(mu + base + 2 * log_sigma + sigma * sigma * x) / sigma
    rate = np.exp(np.clip(base + mu + sigma * peak, -700, 700))
    sd = 1 / np.sqrt(1 + sigma * sigma * rate)
    t, w = legendre(nodes)
    e = peak[:, None] + radius * sd[:, None] * t
    lam = np.exp(np.clip(base[:, None] + mu + sigma * e, -700, 700))
    log_f = x[:, None] * (base[:, None] + mu + sigma * e) - lam - e * e / 2 + np.log(w) + np.log(radius * sd)[:, None]
    total = logsumexp(log_f, axis=1)
    weight = np.exp(log_f - total[:, None])
    log_p = total - np_lgamma(x + 1) - 0.5 * math.log(2 * math.pi)
    return log_p, weight, lam, sigma * e


def lnp_loglik(x, base, mu: float, log_sigma: float, prior: LnpPrior | None = None, nodes: int = 25, radius: float = 6.0) -> float:
    """Log likelihood of counts, with the log prior density if given."""
    out = float(_terms(np.asarray(x, float), np.asarray(base, float), mu, log_sigma, nodes, radius)[0].sum())
    return out + _log_prior(mu, log_sigma, prior)


def _log_prior(mu: float, log_sigma: float, prior: LnpPrior | None) -> float:
    if prior is None:
        return 0.0
    s2 = math.exp(2 * log_sigma)
    return -(2 * prior.alpha + 3) * log_sigma - (2 * prior.beta + prior.strength * (mu - prior.mean) ** 2) / (2 * s2)


def prior_constant(prior: LnpPrior) -> float:
    """What makes the prior density whole; evidences of different numbers of
    segments are comparable only with it."""
    return 0.5 * math.log(prior.strength / (2 * math.pi)) + prior.alpha * math.log(prior.beta) - math.lgamma(prior.alpha)


def lnp_derivatives(x, base, mu: float, log_sigma: float, prior: LnpPrior | None = None, nodes: int = 25, radius: float = 6.0):
    """(log likelihood, gradient, Hessian) in (mu, log sigma)."""
    x, base = np.asarray(x, float), np.asarray(base, float)
    log_p, w, lam, s = _terms(x, base, mu, log_sigma, nodes, radius)
    xs = x[:, None]
    mean = lambda v: (w * v).sum(axis=1)
    e_lam, cross = mean(lam), mean(s * (xs - lam))
    grad = np.array([(x - e_lam).sum(), cross.sum()])
    h_mm = (mean(lam * (lam - 1)) - e_lam**2).sum()
    h_ms = (mean(-s * lam * (1 + xs - lam)) + e_lam * cross).sum()
    h_ss = (mean(s * (xs - lam - s * lam + s * (xs - lam) ** 2)) - cross**2).sum()
    hess = np.array([[h_mm, h_ms], [h_ms, h_ss]])
    if prior is not None:
        s2, d = math.exp(2 * log_sigma), mu - prior.mean
        grad += [-prior.strength * d / s2, -(2 * prior.alpha + 3) + (2 * prior.beta + prior.strength * d * d) / s2]
        hess += np.array([[-prior.strength / s2, 2 * prior.strength * d / s2], [2 * prior.strength * d / s2, -2 * (2 * prior.beta + prior.strength * d * d) / s2]])
    return float(log_p.sum()) + _log_prior(mu, log_sigma, prior), grad, hess


def lnp_fit(x, base, prior: LnpPrior | None = LnpPrior(), rounds: int = 200, tolerance: float = 5e-5, nodes: int = 25, radius: float = 6.0):
    """(mu, log sigma, Hessian, log likelihood) at the mode; None if none.

    Starts at the moments; steps go uphill, halved until they do.
    """
    x, base = np.asarray(x, float), np.asarray(base, float)
    ratio = x / np.exp(base)
    mean = max(float(ratio.mean()), 1e-6)
    extra = max(float(ratio.var()) - float((mean / np.exp(base)).mean()), 0.0) / mean**2
    log_sigma = 0.5 * math.log(max(math.log1p(extra), 1e-4))
    mu = math.log(mean) - math.exp(2 * log_sigma) / 2
    value, grad, hess = lnp_derivatives(x, base, mu, log_sigma, prior, nodes, radius)
    for _ in range(rounds):
        if not np.isfinite(value):
            return None
        if np.linalg.norm(grad) < tolerance * max(1.0, len(x) / 100):
            break
        try:
            step = -np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError:
            step = grad
        if step @ grad <= 0:
            step = grad / max(1.0, float(np.abs(np.diag(hess)).max()))
        step = step / max(1.0, float(np.abs(step).max()))
        for _ in range(40):
            new = lnp_derivatives(x, base, mu + step[0], log_sigma + step[1], prior, nodes, radius)
            if np.isfinite(new[0]) and new[0] >= value - 1e-9:
                break
            step = step / 2
        else:
            break
        mu, log_sigma = mu + float(step[0]), log_sigma + float(step[1])
        value, grad, hess = new
    return mu, log_sigma, hess, value


def laplace_evidence(value: float, hess: np.ndarray) -> float:
    """Log marginal likelihood of two parameters from the mode."""
    sign, logdet = np.linalg.slogdet(-hess)
    return value + math.log(2 * math.pi) - 0.5 * logdet if sign > 0 else -math.inf


def fit_lnp_groups(rows: DataFrame, keys: list[str], count: str, covariates: list[str], beta: list[float], exposure: float = 0.0, prior: LnpPrior | None = LnpPrior()) -> DataFrame:
    """(keys, n, mu, log_sigma, hessian, loglik) of each group's fit.

    A group's rows come to one task; groups without a mode are left out.
    """
    kinds = dict(rows.dtypes)
    base = F.lit(float(exposure))
    for c, b in zip(covariates, beta):
        base = base + F.lit(float(b)) * F.col(c)
    ready = rows.select(*keys, F.col(count).cast("double").alias("__x"), base.alias("__base"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n bigint, mu double, log_sigma double, hessian array<double>, loglik double"
    names = [*keys, "n", "mu", "log_sigma", "hessian", "loglik"]

    def fit(key, p: pd.DataFrame) -> pd.DataFrame:
        found = lnp_fit(p["__x"].to_numpy(), p["__base"].to_numpy(), prior)
        return pd.DataFrame([(*key, len(p), found[0], found[1], found[2].ravel().tolist(), found[3])] if found else [], columns=names)

    return ready.groupBy(*keys).applyInPandas(fit, schema)


# -- outliers ---------------------------------------------------------------------------


def poisson_outliers(rows: DataFrame, keys: list[str], count: str, expected: str, most: float = 0.05) -> DataFrame:
    """``rows`` without the least likely of each group, at most ``most`` of
    it (two at least) and only those under a log probability of -25."""
    w = Window.partitionBy(*keys)
    scored = rows.withColumn("__l", poisson_logpmf(F.col(count).cast("double"), F.col(expected)))
    ranked = scored.withColumn("__k", F.row_number().over(w.orderBy("__l", count))).withColumn("__n", F.count(F.lit(1)).over(w))
    out = (F.col("__l") < -25) & (F.col("__k") <= F.greatest(F.lit(2.0), F.col("__n") * most))
    return ranked.filter(~out).drop("__l", "__k", "__n")


def negative_binomial_fit(histogram: list[tuple[int, int]]) -> tuple[float, float]:
    """(mean, size) by maximum likelihood from (value, count) pairs."""
    x = np.array([h[0] for h in histogram], float)
    n = np.array([h[1] for h in histogram], float)
    mean = float((x * n).sum() / n.sum())

    def loglik(log_r: float) -> float:
        r = math.exp(log_r)
        return float((n * (np_lgamma(x + r) - np_lgamma(np.array(r)) + r * math.log(r / (r + mean)) + x * math.log(mean / (r + mean) if mean else 1))).sum())

    low, high = -7.0, 15.0
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(120):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loglik(a) > loglik(b) else (a, high)
    return mean, math.exp((low + high) / 2)


def negative_binomial_outliers(rows: DataFrame, count: str, limit: float = -25.0, most: float = 0.05) -> DataFrame:
    """``rows`` with ``nb_outlier``: log tail probability under ``limit``.

    One distribution is fitted to the histogram of all counts; its distinct
    values are scored on the driver and only their bounds go back. More than
    ``most`` outliers are an error.
    """
    hist = [(int(r[0]), r[1]) for r in rows.filter(F.col(count).isNotNull()).groupBy(F.col(count).cast("long")).count().collect()]
    if not hist:
        return rows.withColumn("nb_outlier", F.lit(False))
    mean, size = negative_binomial_fit(hist)
    prob = size / (size + mean)
    x = np.array(sorted(h[0] for h in hist), float)
    upper = np.where(x > 0, beta_logsf(prob, size, np.maximum(x, 1e-9)), 0.0)  # P(X >= x)
    lower = beta_logcdf(prob, size, x + 1)  # P(X <= x)
    high, low = x[upper < limit], x[lower < limit]
    bad = F.lit(False)
    if len(high):
        bad = bad | (F.col(count) >= F.lit(int(high.min())))
    if len(low):
        bad = bad | (F.col(count) <= F.lit(int(low.max())))
    share = sum(n for v, n in hist if (len(high) and v >= high.min()) or (len(low) and v <= low.max())) / sum(n for _, n in hist)
    if share > most:
        raise ValueError(f"{share:.1%} of the bins are outliers")
    return rows.withColumn("nb_outlier", bad)
