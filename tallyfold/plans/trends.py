"""Trends over release dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import period as period_of
from ..operators.aggregate import append_totals, group_sum, share_within
from ..operators.grid import complete
from ..operators.windows import keep_top, period_change, running_total, top_labels


def summed_by_period(df: DataFrame, date: str, by: str, value: str, period: str = "year") -> DataFrame:
    """Sum per period and label, completed with zeros; undated and unlabelled rows are left out."""
    dated = df.withColumn("period", period_of(date, period))
    return complete(group_sum(dated, ["period", by], **{value: value}), ["period", by])


def cumulative_trend(df: DataFrame, date: str, by: str, value: str, period: str = "year",
                     total_label: str | None = None, top_n: int | None = None, rank_on: str = "total",
                     exclude: Sequence[str] = ("other",)) -> DataFrame:
    """Running totals per label over periods: `(period, by, value, cumulative)`.

    `total_label` adds rows for all labels together. `top_n` keeps the labels
    with the largest totals; `rank_on='cumulative'` ranks by the sum of the
    running totals instead, which favours labels that started early.
    """
    if rank_on not in ("total", "cumulative"):
        raise ValueError("rank_on is total or cumulative")
    sums = running_total(summed_by_period(df, date, by, value, period), [by], "period", value, "cumulative")
    out = sums
    if top_n:
        measure = value if rank_on == "total" else "cumulative"
        out = out.join(top_labels(sums, by, measure, top_n, exclude), by, "left_semi")
    out = out.select("period", by, value, "cumulative")
    if total_label is None:
        return out
    totals = sums.groupBy("period").agg(F.sum(value).alias(value), F.sum("cumulative").alias("cumulative"))
    return out.unionByName(totals.withColumn(by, F.lit(total_label)))


def proportion_trend(df: DataFrame, date: str, by: str, value: str, period: str = "year",
                     zero_prev: str = "inf") -> DataFrame:
    """Share of each label within its period and the per-cent change of that share."""
    shares = share_within(summed_by_period(df, date, by, value, period), ["period"], value, "share")
    return period_change(shares, [by], "period", "share", zero_prev=zero_prev)


def period_totals(df: DataFrame, date: str, by: str, value: str, period: str = "year",
                  total_label: str = "Total") -> DataFrame:
    """Sums per period and label with one `Total` row per period."""
    return append_totals(summed_by_period(df, date, by, value, period), ["period"], by, value, total_label)


def collapse_rare(df: DataFrame, label: str, value: str, threshold: float, other: str = "Other") -> DataFrame:
    """Labels whose total stays under the threshold become `other`; unlabelled rows are dropped."""
    totals = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(value).alias("_total"))
    return df.join(totals, label).withColumn(
        label, F.when(F.col("_total") < threshold, F.lit(other)).otherwise(F.col(label))
    ).select(df.columns)


def top_share_trend(df: DataFrame, date: str, by: str, value: str, top_n: int, periods: Sequence[int],
                    exclude: Sequence[str] = ("other",)) -> DataFrame:
    """Shares in chosen years of the labels whose shares add up to the most."""
    shares = proportion_trend(df, date, by, value)
    return keep_top(shares, by, "share", top_n, exclude).where(F.col("period").isin(list(periods)))
