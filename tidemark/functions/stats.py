"""Statistics as column expressions, and the few that are settled on the driver over a bounded number of groups."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_REPORTABLE_N, MAX_CI_RATIO = 30, 0.5


def z(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Interval of a rate, within [0, 1]; without trials it says nothing."""
    return wilson_at(k, n, F.lit(z(confidence)))


def wilson_at(k: Column, n: Column, q: Column) -> tuple[Column, Column]:
    """The same at a quantile that may differ by row."""
    k, n = k.cast("double"), n.cast("double")
    p, d = F.try_divide(k, n), 1 + F.try_divide(q * q, n)
    mid = (p + F.try_divide(q * q, 2 * n)) / d
    half = q * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(q * q, 4 * n * n)) / d
    return F.coalesce(F.greatest(mid - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(mid + half, F.lit(1.0)), F.lit(1.0))


def mean_interval(mean: Column, sd: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    half = F.when((n > 1) & (sd > 0), z(confidence) * sd / F.sqrt(n.cast("double"))).otherwise(0.0)
    return mean - half, mean + half


def cohens_d(ma: Column, sa: Column, na: Column, mb: Column, sb: Column, nb: Column) -> Column:
    var = F.try_divide((na - 1) * sa * sa + (nb - 1) * sb * sb, (na + nb - 2).cast("double"))
    return F.when((na >= 2) & (nb >= 2) & (var > 0), (ma - mb) / F.sqrt(var)).otherwise(0.0)


def d_interval(d: Column, na: Column, nb: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    se = F.sqrt(F.try_divide((na + nb).cast("double"), (na * nb).cast("double")) + F.try_divide(d * d, 2.0 * (na + nb)))
    return d - z(confidence) * se, d + z(confidence) * se


def magnitude(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def quality(n: Column) -> Column:
    return F.when(n == 0, "abstain").when(n < MIN_REPORTABLE_N, "low_sample").otherwise("ok")


def corr(x: Column, y: Column) -> Column:
    """Pearson, null without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def effective_n(n: Column, rho: Column) -> Column:
    """Sample size that independent samples would need, under lag-one correlation."""
    r = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))
    return F.greatest(n * (1 - r) / (1 + r), F.lit(1.0))


def first_passage(margin: Column, rate: Column, sigma: Column) -> tuple[Column, Column]:
    """Mean and deviation of the inverse-Gaussian time for a drift to use up a margin."""
    mu = F.try_divide(margin, rate)
    lam = F.try_divide(margin * margin, sigma * sigma)
    return mu, F.sqrt(F.try_divide(mu * mu * mu, lam))


def permutation_spread(groups: list[tuple[int, int]], draws: int = 2000, seed: int = 7) -> tuple[float, float, float]:
    """(observed spread of rates, median spread by chance, add-one p) of (failures, n) groups: labels dealt to the groups at random."""
    k = np.array([g[0] for g in groups])
    n = np.array([g[1] for g in groups])
    spread = lambda x: (x / n).max(axis=-1) - (x / n).min(axis=-1)
    seen = float(spread(k))
    null = spread(np.random.default_rng(seed).multivariate_hypergeometric(n, int(k.sum()), size=draws, method="marginals"))
    return seen, float(np.median(null)), float((1 + (null >= seen - 1e-12).sum()) / (draws + 1))


def isotonic(values: list[float], weights: list[float]) -> list[float]:
    """Non-decreasing weighted least-squares fit by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, c2 = pools.pop()
            v1, w1, c1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, c1 + c2])
    return [v for v, _, c in pools for _ in range(int(c))]


def chi2_quantile(p: float, k: float) -> float:
    """By bisection on the regularised lower incomplete gamma function's series."""

    def cdf(x: float) -> float:
        s, t, a = 0.0, 1.0 / (k / 2), k / 2
        while t > 1e-17 * max(s, 1e-300):
            s += t
            a += 1
            t *= (x / 2) / a
        return s * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0

    lo, hi = 1e-12, 10.0 * k + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def cusum_threshold(arl0: float, slack: float = 0.5) -> float:
    """Decision level of a two-sided CUSUM whose in-control run length is arl0 (Siegmund's approximation)."""

    def arl(h: float) -> float:
        b = h + 1.166
        return (math.exp(2 * slack * b) - 2 * slack * b - 1) / (2 * slack * slack) / 2

    lo, hi = 0.0, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if arl(mid) < arl0 else (lo, mid)
    return (lo + hi) / 2
