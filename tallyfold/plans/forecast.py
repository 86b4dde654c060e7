"""Yields, costs and storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from ..functions.text import size_text
from ..operators.aggregate import flag_counts

# Price of outgoing data in USD per TB, agent cost in USD and tokens per dataset,
# minutes a person needs per dataset, processor minutes per run and organism.
EGRESS_PRICE, COST_PER_DATASET, TOKENS_PER_DATASET, MINUTES_PER_DATASET, CPU_MINUTES = 120, 0.08, 63_000, 1, 8


def extrapolate_yield(df: DataFrame, value: str, processed: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells to expect once everything is processed.

    Mean yield of the datasets with cells × datasets to go × share of datasets
    that did not come back empty, plus the cells there are. Groups without any
    yield have no estimate and are left out.
    """
    cells, done = F.col(value), F.col(processed)
    out = df.groupBy(*by).agg(
        F.avg(F.when(cells > 0, cells)).alias("cells_per_dataset"),
        F.count_if(done & (cells == 0)).alias("_empty"), F.count(F.lit(1)).alias("_all"),
        F.count_if(~done).alias("to_process"), F.coalesce(F.sum(cells), F.lit(0)).alias("processed_cells"),
    ).withColumn("fraction_with_cells", 1 - ratio("_empty", "_all"))
    total = F.col("cells_per_dataset") * F.col("to_process") * F.col("fraction_with_cells") + F.col("processed_cells")
    return (
        out.withColumn("estimated_cells", total).where(F.col("estimated_cells").isNotNull())
        .withColumn("delta", F.col("estimated_cells") - F.col("processed_cells")).drop("_empty", "_all")
    )


def project_costs(n: Column, rates: Mapping[str, float]) -> list[Column]:
    """Constant rates per dataset times a number of datasets."""
    return [(n * F.lit(rate)).alias(name) for name, rate in rates.items()]


def funnel(df: DataFrame, stages: Mapping[str, Column], results: DataFrame, key: str) -> DataFrame:
    """One row: datasets that meet each condition, and distinct ones that have results."""
    finished = df.select(key).where(F.col(key).isNotNull()).distinct().join(
        results.select(F.col(results.columns[0]).alias(key)), key, "left_semi")
    n_done = finished.agg(F.count(F.lit(1)).alias("n")).scalar()
    return flag_counts(df, stages).withColumn("with_results", n_done)


def storage_usage(objects: DataFrame, traffic: DataFrame, price: float = EGRESS_PRICE, copies: int = 1,
                  window: Column | None = None) -> DataFrame:
    """Per bucket: size, objects, outgoing bytes, downloads and cost.

    `objects` is `(bucket, length)`, `traffic` the metric points `(bucket, bytes)`
    with a time if a `window` over it is given (`in_days`, `in_last_days`); points
    outside the window, or without a time, do not count. `copies` is the number
    of variants the size covers.
    """
    if window is not None:
        traffic = traffic.where(window)
    size = objects.groupBy("bucket").agg(F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("n_objects"))
    sent = traffic.groupBy("bucket").agg(F.sum("bytes").alias("egress_bytes"))
    return size.join(sent, "bucket", "left").fillna({"egress_bytes": 0}).select(
        "bucket", "size_bytes", "n_objects", "egress_bytes", size_text("size_bytes").alias("size_text"),
        (ratio("egress_bytes", "size_bytes") * copies).alias("downloads"),
        (F.col("egress_bytes") / float(1024**4) * price).alias("cost"),
    )
