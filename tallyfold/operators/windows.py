"""Windows over tables that are already summed to one row per (label, period)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import change_percent


def running_total(df: DataFrame, by: Sequence[str], period: str, value: str, name: str) -> DataFrame:
    """Running sum per label; one row per label and period, so a label has as many rows as periods."""
    frame = W.partitionBy(*by).orderBy(period).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(value).over(frame))


def period_change(df: DataFrame, by: Sequence[str], period: str, value: str, name: str = "change_percent",
                  zero_prev: str = "inf") -> DataFrame:
    """Per-cent change from the period before; null for a label's first period."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(period))
    return (
        df.withColumn("_prev", before)
        .withColumn(name, F.when(F.col("_prev").isNotNull(), change_percent(value, "_prev", zero_prev)))
        .drop("_prev")
    )


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per group. Spark trims each group before the shuffle, so groups may be any size."""
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def top_labels(df: DataFrame, label: str, value: str, n: int, exclude: Sequence[str] = (),
               how: str = "sum") -> DataFrame:
    """The n labels with the largest total (or largest single row); ties by label."""
    measure = {"sum": F.sum, "max": F.max}[how](value)
    kept = df.where(F.col(label).isNotNull())
    if exclude:
        kept = kept.where(~F.col(label).isin(list(exclude)))
    return kept.groupBy(label).agg(measure.alias("_m")).orderBy(F.desc("_m"), label).limit(n).select(label)


def keep_top(df: DataFrame, label: str, value: str, n: int, exclude: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """Rows of the top labels only."""
    return df.join(top_labels(df, label, value, n, exclude, how), label, "left_semi")


def head(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Each row is kept with the given probability, so the size varies a little.

    A hash of seed and keys decides, so a task that runs again keeps the same rows.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction is between 0 and 1")
    if fraction == 1:
        return df
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.where(mark < f"{int(fraction * 2**32):08x}")
