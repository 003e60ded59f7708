"""Statistics of opinion counts: Beta quantiles, pooled priors, design effects, intervals."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring method.
PRIOR_STRENGTH = 10
PRIOR_SMOOTHING = 10
PRIOR_POOL_MIN = 30
SCORE_QUANTILE = 0.10
ICC_FLOOR = 0.10
BOOTSTRAP_ROUNDS = 1999
INTERVAL_LEVEL = 0.90
N_MIN = {"deep": 600, "standard": 400, "thin": 200}
AUTHORS_MIN = 50
COMMUNITIES_MIN = 5
THREAD_SHARE_MAX = 0.20
AUTHOR_SHARE_MAX = 0.05

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(x), dtype=float)


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta, element by element.

    The continued fraction is evaluated from its far end inwards, at a depth that grows with the
    root of the larger parameter, on whichever side of the mean it converges fast.
    """
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1)
    z = np.where(inside, z, 0.5)
    depth = int(80 + 8 * math.sqrt(max(1.0, float(np.max(p + q, initial=1.0)))))
    f = np.ones_like(z)
    for m in range(depth, 0, -1):
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        f = 1 + even / (1 + odd / f)
    f = 1 - (p + q) * z / (p + 1) / f
    log = _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
    tail = np.exp(log) / p / f
    tail = np.where(inside, tail, 0.0)
    return np.clip(np.where(flip, 1 - tail, tail), 0, 1)


def beta_quantile_array(a: np.ndarray, b: np.ndarray, q: float, steps: int = 60) -> np.ndarray:
    """The q-quantile of Beta(a, b) by halving the interval for all rows at once."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = beta_cdf(a, b, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def beta_quantile(a: Column, b: Column, q: float = SCORE_QUANTILE) -> Column:
    """Column form; null where either parameter is null or not positive."""

    @F.pandas_udf("double")
    def quantile(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = ((x > 0) & (y > 0)).to_numpy()
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = beta_quantile_array(x.to_numpy()[ok], y.to_numpy()[ok], q)
        return pd.Series(out).where(ok, None)

    return quantile(a.cast("double"), b.cast("double"))


def pooled_prior(pos_others: Column, n_others: Column, strength: float = PRIOR_STRENGTH, smoothing: float = PRIOR_SMOOTHING, least: int = PRIOR_POOL_MIN) -> tuple[Column, Column, Column]:
    """Beta parameters from the others' pooled positive rate, and whether the pool is small."""
    p0 = (pos_others + F.lit(smoothing / 2)) / (n_others + F.lit(smoothing))
    return p0 * strength, (F.lit(1.0) - p0) * strength, n_others < least


def icc(n: Column, pos: Column, k: Column, sq: Column, between: Column) -> tuple[Column, Column]:
    """One-way random-effects ICC of a binary opinion, from cluster sums, and whether it was estimated.

    ``n`` opinions, ``pos`` of them positive, ``k`` clusters, ``sq`` = sum of n_j^2, ``between`` =
    sum of pos_j^2 / n_j. Fewer than 5 clusters or opinions give the floor.
    """
    msb = (between - pos * pos / n) / (k - 1)
    msw = F.when(n > k, (pos - between) / (n - k)).otherwise(1e-9)
    n0 = (n - sq / n) / (k - 1)
    below = msb + (n0 - 1) * msw
    value = F.when(below > 0, F.least(F.greatest((msb - msw) / below, F.lit(0.0)), F.lit(1.0))).otherwise(ICC_FLOOR)
    enough = (k >= 5) & (n >= 5)
    return F.when(enough, value).otherwise(ICC_FLOOR), F.coalesce(enough & (below > 0), F.lit(False))


def design_effect(n: Column, sq: Column, rho: Column) -> Column:
    """Kish's design effect with the size-weighted mean cluster size; 1 without opinions."""
    return F.when(n > 0, 1 + (sq / n - 1) * rho).otherwise(1.0)


@functools.lru_cache(64)
def poisson_cdf(power: int) -> tuple[int, np.ndarray]:
    """Cumulative probabilities of a Poisson variable of mean 2^power, from the first count that matters, and that count."""
    mean = 2.0**power
    wide = int(12 * math.sqrt(mean)) + 30
    first = max(0, int(mean) - wide)
    n = np.arange(first, int(mean) + wide + 1, dtype=float)
    log_p = np.concatenate([[first * math.log(mean) - mean - math.lgamma(first + 1)], math.log(mean) - np.log(n[1:])]).cumsum()
    return first, np.exp(log_p).cumsum()


def hashed_uniform(seed: np.ndarray, rounds: int) -> np.ndarray:
    """For each seed (32 bits) a uniform number in (0, 1) a round: an integer hash of the seed and the round's multiple of a golden step."""
    mask = np.uint64(0xFFFFFFFF)
    x = (seed.astype(np.uint64)[:, None] + np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B9)) & mask
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        x ^= x >> np.uint64(shift)
        if factor:
            x = (x * np.uint64(factor)) & mask
    return (x + 0.5) / 4294967296.0


def poisson_weights(seed: np.ndarray, power: np.ndarray, rounds: int = BOOTSTRAP_ROUNDS) -> np.ndarray:
    """One row a (seed, power): in each round how often 2^power equal clusters are drawn in sum, by the inverse of the distribution."""
    out = np.empty((len(seed), rounds), np.int64)
    for p in np.unique(power).tolist():
        own = power == p
        first, cdf = poisson_cdf(p)
        out[own] = first + np.searchsorted(cdf, hashed_uniform(seed[own], rounds))
    return out


def weighted_interval(size: np.ndarray, good: np.ndarray, alpha: float, beta: float, level: float = INTERVAL_LEVEL) -> tuple[float, float]:
    """Interval of the posterior mean from each round's resampled opinions and positive ones."""
    means = np.where(size < 2, 0.5, (good + alpha) / (size + alpha + beta))
    lo, hi = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
    return round(float(lo), 4), round(float(hi), 4)


def bootstrap_interval(n: np.ndarray, pos: np.ndarray, alpha: float, beta: float, rounds: int = BOOTSTRAP_ROUNDS, level: float = INTERVAL_LEVEL, seed: int = 42) -> tuple[float | None, float | None]:
    """Interval of the posterior mean over resamples of whole clusters, from cluster sums; under 3 clusters none."""
    k = len(n)
    if k < 3:
        return None, None
    rng = np.random.default_rng(seed)
    means = np.empty(rounds)
    for at in range(0, rounds, 64):
        draw = rng.integers(0, k, size=(min(64, rounds - at), k))
        size, good = n[draw].sum(1), pos[draw].sum(1)
        means[at : at + len(draw)] = np.where(size < 2, 0.5, (good + alpha) / (size + alpha + beta))
    lo, hi = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
    return round(float(lo), 4), round(float(hi), 4)
