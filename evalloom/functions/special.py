"""Tails of the binomial, hypergeometric, chi-squared, normal and t distributions on arrays, right for counts to 1e9.

Chances come from Stirling's error and the deviance, so no large logarithms are subtracted. Tails are a continued fraction, or
a quadrature where both shapes are large, or a sum that starts at its largest term: none of them is longer for larger counts than
some standard deviations. Column functions send batches of counts to these, since Spark has no log-gamma.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
SMALL = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - HALF_LOG_2PI for n in range(1, 16)])
#: Shapes from which the tail of a beta distribution is a quadrature.
LARGE = 3000
NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)
lgamma = np.vectorize(math.lgamma, otypes=[float])


def stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! less Stirling's approximation."""
    x = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return np.where(n < 16, SMALL[np.minimum(n, 15).astype(int)], series)


def deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x ln(x / m) + m - x for m > 0, without loss where x is near m."""
    d, s = x - m, x + m
    v = d / s
    near = d * v + 2 * x * sum(v ** (2 * j + 1) / (2 * j + 1) for j in range(1, 9))
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / m), 0.0) - d
    return np.where(np.abs(d) < 0.1 * s, near, far)


def log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln of the chance of k of n, for 0 < p < 1 and 0 <= k <= n."""
    inside = (k > 0) & (k < n)
    a, b = np.where(inside, k, 1.0), np.where(inside, n - k, 1.0)
    mid = stirling_error(a + b) - stirling_error(a) - stirling_error(b) - deviance(a, (a + b) * p) - deviance(b, (a + b) * (1 - p)) - HALF_LOG_2PI - 0.5 * (np.log(a) + np.log(b) - np.log(a + b))
    return np.where(inside, mid, np.where(k <= 0, n * np.log1p(-p), n * np.log(p)))


def fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method, until nothing changes."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 20_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + top * d), guard(1 + top / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return out


def binomial_tail(n: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) of n trials with chance p: the incomplete beta function I_p(k, n - k + 1)."""
    n, k, p = (np.asarray(v, float) for v in np.broadcast_arrays(n, k, p))
    out = np.where(k <= 0, 1.0, 0.0)
    live = (k > 0) & (k <= n) & (p > 0) & (p < 1)
    out = np.where((k > 0) & (k <= n) & (p >= 1), 1.0, out)
    if not live.any():
        return out
    n, k, p = n[live], k[live], p[live]
    a, b = k, n - k + 1
    found = np.empty_like(p)
    big = np.minimum(a, b) > LARGE
    if big.any():
        A, B, x = a[big], b[big], p[big]
        mean, sd = A / (A + B), np.sqrt(A * B / (A + B) / (A + B) / (A + B + 1))
        up = x > mean
        end = np.where(up, np.minimum(1, np.maximum(mean + 12 * sd, x + 6 * sd)), np.maximum(0, np.minimum(mean - 12 * sd, x - 6 * sd)))
        t = x[:, None] + (end - x)[:, None] * (NODES + 1) / 2
        inner = np.exp(log_binomial((A - 1)[:, None], (n[big] - 1)[:, None], np.clip(t, 1e-300, 1 - 1e-16))) * n[big][:, None]
        area = (inner * WEIGHTS).sum(1) * np.abs(end - x) / 2
        found[big] = np.where(up, 1 - area, area)
    if not big.all():
        A, B, x, m, j = a[~big], b[~big], p[~big], n[~big], k[~big]
        low = x < (A + 1) / (A + B + 2)
        front = np.where(low, np.exp(log_binomial(j, m, x)) * (1 - x), np.exp(log_binomial(j - 1, m, x)) * x)
        rest = front * fraction(np.where(low, A, B), np.where(low, B, A), np.where(low, x, 1 - x))
        found[~big] = np.where(low, rest, 1 - rest)
    out[live] = np.clip(found, 0.0, 1.0)
    return out


def clopper_pearson_ends(k: np.ndarray, n: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The exact interval of a share by 60 bisections of the tail; 0 and 1 at the ends, nan without trials."""
    k, n, alpha = np.asarray(k, float), np.asarray(n, float), (1 - level) / 2

    def bisected(at: np.ndarray, goal: float) -> np.ndarray:
        lo, hi = np.zeros_like(n), np.ones_like(n)
        for _ in range(60):
            mid = (lo + hi) / 2
            big = binomial_tail(n, at, mid) > goal
            lo, hi = np.where(big, lo, mid), np.where(big, mid, hi)
        return lo

    low, high = np.where(k <= 0, 0.0, bisected(k, alpha)), np.where(k >= n, 1.0, bisected(k + 1, 1 - alpha))
    return np.where(n > 0, low, np.nan), np.where(n > 0, high, np.nan)


def log_hypergeometric(x: np.ndarray, row: float, col: float, n: float) -> np.ndarray:
    """ln of the chance of x in a table of margins row and col of n."""
    if not 0 < col < n:
        return np.zeros_like(x)
    p = np.full_like(x, col / n)
    return log_binomial(x, np.full_like(x, row), p) + log_binomial(col - x, np.full_like(x, n - row), p) - log_binomial(np.array(float(col)), np.array(float(n)), np.array(col / n))


def upper_sum(x: float, row: float, col: float, n: float) -> float:
    """Sum of chances from x up, which lies above the mode: terms fall, and end where they no longer count."""
    total, term, i, most = 0.0, math.exp(float(log_hypergeometric(np.array(float(x)), row, col, n))), float(x), min(row, col)
    while term > 0 and i <= most:
        at = i + np.arange(4096.0)
        ratio = np.where(at < most, (row - at) * (col - at) / ((at + 1) * (n - row - col + at + 1)), 0.0)
        terms = term * np.concatenate([[1.0], np.cumprod(ratio)])
        total += float(terms[:-1].sum())
        term, i = float(terms[-1]), i + 4096
        if term < 1e-17 * total:
            break
    return total


def fisher_p(a: float, b: float, c: float, d: float) -> tuple[float, float]:
    """(two-sided, greater) of [[a, b], [c, d]]. Chances fall on both sides of the mode, so a tail is a sum from its inner end."""
    row, col, n = a + b, a + c, a + b + c + d
    least, most = max(0.0, row + col - n), min(row, col)
    mode = math.floor((row + 1) * (col + 1) / (n + 2))

    def above(x: float) -> float:
        if x <= least:
            return 1.0
        if x > most:
            return 0.0
        if x > mode:
            return upper_sum(x, row, col, n)
        return 1.0 - upper_sum(row - x + 1, row, n - col, n)  # the same table seen from its cell b

    own = float(log_hypergeometric(np.array(float(a)), row, col, n))
    seen = lambda x: float(log_hypergeometric(np.array(float(x)), row, col, n)) <= own + 1e-7
    lo, hi = (mode, most + 1) if a <= mode else (least - 1, mode)
    while hi - lo > 1:  # the far side's first value that is as unlikely
        mid = math.floor((lo + hi) / 2)
        if a <= mode:
            lo, hi = (lo, mid) if seen(mid) else (mid, hi)
        else:
            lo, hi = (mid, hi) if seen(mid) else (lo, mid)
    two = 1.0 if seen(mode) else 1.0 - above(a + 1) + above(hi) if a <= mode else above(a) + 1.0 - above(lo + 1)
    return min(1.0, two), min(1.0, above(a))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x); terms in logarithms."""
    if not x > 0:
        return 1.0 if x <= 0 else math.nan
    half, odd = x / 2, df % 2
    total = math.erfc(math.sqrt(half)) if odd else 0.0
    return min(1.0, total + sum(math.exp(-half + k * math.log(half) - math.lgamma(k + 1)) for k in (j + odd / 2 for j in range(df // 2))))


def t_tail(t: float, df: float) -> float:
    """Two-sided p of a t statistic."""
    if not df > 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    arr = lambda *v: [np.array([float(y)]) for y in v]
    low = x < (a + 1) / (a + b + 2)
    rest = front * float(fraction(*(arr(a, b, x) if low else arr(b, a, 1 - x)))[0]) / (a if low else b)
    return min(1.0, rest if low else 1 - rest)


def numbers(*columns: Column) -> list[Column]:
    return [c.cast("double") for c in columns]


def tail_of_binomial(n: Column, k: Column, p: Column) -> Column:
    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(binomial_tail(n.to_numpy(), k.to_numpy(), p.to_numpy()))

    return F.when(n.isNotNull() & k.isNotNull() & p.isNotNull(), tail(*numbers(F.coalesce(n, F.lit(0)), F.coalesce(k, F.lit(0)), F.coalesce(p, F.lit(0)))))


def interval_of_share(k: Column, n: Column, level: float) -> Column:
    """struct(lo, hi), null without trials."""

    @F.pandas_udf("lo double, hi double")
    def ends(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        lo, hi = clopper_pearson_ends(k.to_numpy(), n.to_numpy(), level)
        return pd.DataFrame({"lo": lo, "hi": hi})

    found = ends(*numbers(F.coalesce(k, F.lit(0)), F.coalesce(n, F.lit(0))))
    return F.when((n > 0) & k.isNotNull(), found)


def table_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(two_sided, greater) of a 2 x 2 table."""

    @F.pandas_udf("two_sided double, greater double")
    def both(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fisher_p(*row) for row in zip(a, b, c, d, strict=True)], columns=["two_sided", "greater"], dtype=float)

    return both(*numbers(a, b, c, d))


def p_of_chi2(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(v, int(k)) for v, k in zip(x, df, strict=True)], dtype=float)

    return F.when(x.isNotNull(), tail(*numbers(F.coalesce(x, F.lit(0)), df)))


def p_of_normal(z: Column) -> Column:
    """Two-sided p of a standard score."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype=float)

    return F.when(z.isNotNull(), tail(*numbers(F.coalesce(z, F.lit(0)))))


def p_of_correlation(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, by the t distribution; null for fewer than three."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        found = [t_tail(v * math.sqrt((m - 2) / (1 - v * v)) if abs(v) < 1 else math.inf, m - 2) for v, m in zip(r, n, strict=True)]
        return pd.Series(found, dtype=float)

    return F.when(r.isNotNull() & (n > 2), tail(*numbers(F.coalesce(r, F.lit(0)), F.greatest(n, F.lit(3)))))
