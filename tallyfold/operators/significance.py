"""P-values of t scores and their correction for many tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..session import materialize
from .joins import null_safe_join
from .ranked import running_weight

# Rows of a group within which a window runs.
CHUNK = 100_000
_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int = 20_000) -> np.ndarray:
    """The continued fraction of the incomplete beta integral, from its front until no value changes."""
    c, d, value = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for k in range(most):
        m = k // 2
        if k == 0:
            term = np.ones_like(x)
        elif k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 + term * d
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + term / np.where(np.abs(c) < _TINY, _TINY, c)
        value = value * c * d
        if k > 2 and (np.abs(c * d - 1.0) < 1e-15).all():
            break
    return value - 1.0


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Probability of a t score at least as far from zero with `df` degrees of freedom."""
    a, b, x = df / 2, np.full_like(df, 0.5), df / (df + t * t)
    near = x >= (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    a1, b1, x1 = np.where(near, b, a), np.where(near, a, b), np.where(near, t * t / (df + t * t), x)
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = (log_gamma(a + b) - log_gamma(a) - log_gamma(b)).astype(float)
    with np.errstate(divide="ignore"):
        front = front + a1 * np.log(x1) + b1 * np.where(near, np.log(x), np.log1p(-x))
    part = np.where(x1 > 0, np.exp(front) / a1 * _fraction(a1, b1, x1), 0.0)
    return np.clip(np.where(near, 1.0 - part, part), 0.0, 1.0)


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; 1 where the score or the degrees of freedom are missing."""
    out = np.ones(len(t))
    known = (t.notna() & df.notna() & np.isfinite(t) & (df > 0)).to_numpy()
    if known.any():
        out[known] = two_sided(t[known].to_numpy(float), df[known].to_numpy(float))
    return pd.Series(out)


def adjusted_p(df: DataFrame, by: Sequence[str], order: Sequence[str], p: str = "p", name: str = "p_adjusted",
               chunk: int = CHUNK) -> DataFrame:
    """Adds the p-values corrected per group by the false discovery rate (Benjamini and Hochberg).

    `order` with the keys names a row. A null p counts as 1. The least of
    `p * rows / rank` from a row's rank on: within chunks of the ranks by a
    window, beyond them by the minima of the later chunks of the group.
    """
    kept = df.columns
    ranked = running_weight(df.withColumn("_p", F.coalesce(p, F.lit(1.0))), ["_p", *order], by=by)
    rows = materialize(ranked.select(
        *kept, F.col("_before"), F.floor(F.col("_before") / chunk).alias("_chunk"),
        F.least(F.lit(1.0), F.col("_p") * F.col("_total") / (F.col("_before") + 1)).alias("_q")), "ranked")
    minima = rows.groupBy(*by, "_chunk").agg(F.min("_q").alias("_least"))
    after = W.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    later = minima.select(*by, "_chunk", F.min("_least").over(after).alias("_later"))
    within = W.partitionBy(*by, "_chunk").orderBy(F.desc("_before")).rowsBetween(W.unboundedPreceding, 0)
    joined = null_safe_join(rows, later, [*by, "_chunk"], "inner")
    return joined.select(*kept, F.least(F.min("_q").over(within), "_later").alias(name))
