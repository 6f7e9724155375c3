"""Aggregates and tail probabilities for association tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def corr(x: str, y: str) -> Column:
    """Pearson correlation; null where either side doesn't vary or has no rows. Give rows without nulls."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, elementwise."""
    from math import lgamma

    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.empty_like(x)
    for i in np.ndindex(x.shape):
        p, q, z = a[i], b[i], x[i]
        if not np.isfinite(p + q + z):
            out[i] = np.nan
            continue
        if z <= 0 or z >= 1:
            out[i] = 0.0 if z <= 0 else 1.0
            continue
        swap = z > (p + 1) / (p + q + 2)
        if swap:
            p, q, z = q, p, 1 - z
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = 1.0, 1 - (p + q) * z / (p + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        f = d
        for m in range(1, 400):
            num = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            for num in (num, -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
                f *= c * d
            if abs(c * d - 1) < 1e-13:
                break
        out[i] = 1 - front * f if swap else front * f
    return out


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper tail probability of the F distribution."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def pearson_p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided p of a correlation ``r`` over ``n`` rows (n may be an effective size)."""
    for r, n in batches:
        r, n = r.astype(float), n.astype(float)
        df = n - 2
        with np.errstate(all="ignore"):
            t = r * np.sqrt(df / np.maximum(1 - r * r, 1e-300))
        p = pd.Series(t_tail(t.to_numpy(), df.to_numpy()), index=r.index)
        yield p.where((df > 0) & r.notna(), None)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail probability of a standard normal."""
    from math import erfc

    return z.astype(float).map(lambda v: None if pd.isna(v) else erfc(abs(v) / 2**0.5))


def max_stat_counts(x: np.ndarray, y: np.ndarray, block: int, reps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column of ``x``: its |r| with ``y``, and in how many block resamples of ``y`` the greatest
    |r| of all columns, and the column's own, reach that.

    Resampling ``y`` alone breaks its tie with ``x`` and keeps its own dependence. Columns that don't
    vary have r = 0.
    """
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
    r_of = lambda v: np.abs(z.T @ ((v - v.mean()) / (v.std() or 1.0))) / len(v)
    seen = r_of(y)
    family, own = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
    for i in block_indices(len(y), block, reps, rng):
        r = r_of(y[i])
        family += r.max() >= seen
        own += r >= seen
    return seen, family, own


def block_indices(n: int, block: int, reps: int, rng: np.random.Generator) -> np.ndarray:
    """``reps`` circular block resamples of ``range(n)``: blocks of fixed length from random starts."""
    k = -(-n // block)
    starts = rng.integers(0, n, size=(reps, k, 1))
    return ((starts + np.arange(block)) % n).reshape(reps, -1)[:, :n]


def granger_min_p(y: np.ndarray, x: np.ndarray, maxlag: int = 4) -> float:
    """Least p over lags 1..maxlag of the F test that lags of x help to predict y; nan if none applies."""
    best = np.nan
    for lag in range(1, maxlag + 1):
        n = len(y) - lag
        if n <= 3 * lag + 1:
            break
        past = lambda v: np.column_stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)])
        target, own = y[lag:], np.column_stack([past(y), np.ones(n)])
        both = np.column_stack([own, past(x)])
        ssr = [float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        free = n - both.shape[1]
        if ssr[1] <= 0 or free <= 0:
            continue
        p = float(f_tail(np.array((ssr[0] - ssr[1]) / lag / (ssr[1] / free)), np.array(lag), np.array(free)))
        best = p if np.isnan(best) else min(best, p)
    return best


def ridge_walk(features: np.ndarray, y: np.ndarray, horizon: int, min_train: int = 104, alpha: float = 10.0) -> tuple[float, int]:
    """Correlation of expanding-window ridge forecasts with outcomes, and their number.

    Forecast i is trained on rows that were known by then: up to i - horizon.
    """
    got, want = [], []
    for i in range(min_train + horizon, len(y)):
        end = i - horizon
        past = features[:end]
        mu, sd = past.mean(axis=0), past.std(axis=0)
        sd[sd == 0] = 1
        z, level = (past - mu) / sd, y[:end].mean()
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y[:end] - level))
        got.append(float((features[i] - mu) / sd @ beta + level))
        want.append(y[i])
    if len(got) < 2 or np.std(got) == 0 or np.std(want) == 0:
        return float("nan"), len(got)
    return float(np.corrcoef(got, want)[0, 1]), len(got)
