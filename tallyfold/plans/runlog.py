"""Agent run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import seconds_between
from ..functions.numeric import ratio
from ..functions.text import truncate_text
from ..operators.aggregate import known_keys
from ..operators.ranked import column_quantiles, group_quantiles, running_weight

KINDS = {"tool": "tool_name", "model": "model_name"}


def flatten_runs(runs: DataFrame, kind: str = "tool") -> DataFrame:
    """Nested run records as flat rows: times, status, key lists, sizes, summaries, usage."""
    if kind not in KINDS:
        raise ValueError("kind is tool or model")
    seconds = seconds_between("start_time", "end_time")
    cols = [
        F.col("id").cast("string").alias("run_id"), F.col("trace_id").cast("string").alias("trace_id"),
        "run_type", "start_time", "end_time", seconds.alias("duration_seconds"),
        (seconds * 1000).alias("duration_ms"), F.col("error").isNotNull().alias("has_error"),
        F.col("error").alias("error_message"),
        F.when(F.col("error").isNotNull(), "error").otherwise("success").alias("status"),
    ]
    for side in ("inputs", "outputs"):
        name, text = side[:-1], F.to_json(F.col(side))
        some = F.size(F.map_keys(side)) > 0
        cols += [
            F.when(some, F.map_keys(side)).alias(f"{name}_keys"), F.when(some, F.length(text)).alias(f"{name}_size_chars"),
            F.when(some, truncate_text(text, 200)).alias(f"{name}_summary"),
        ]
    cols += ["tags", F.col("metadata").alias("custom_metadata"), "total_tokens", "prompt_tokens", "completion_tokens"]
    if kind == "tool":
        cols.insert(2, F.col("name").alias("tool_name"))
    else:
        params = F.col("invocation_params")
        cols.insert(2, F.col("name").alias("run_name"))
        cols.insert(3, F.coalesce(F.nullif(params["model_name"], F.lit("")), params["model"]).alias("model_name"))
        cols += [params[p].try_cast("double").alias(p) for p in
                 ("temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty")]
        cols += ["prompt_cost", "completion_cost", "total_cost"]
    return runs.select(*cols)


def filter_runs(flat: DataFrame, include_errors: bool = False, min_duration: float | None = None,
                max_duration: float | None = None, names: Sequence[str] = (), kind: str = "tool") -> DataFrame:
    """Runs without errors, inside the duration bounds, of the given names.

    A missing or zero duration fails any bound.
    """
    if min_duration is not None and max_duration is not None and min_duration > max_duration:
        raise ValueError("min_duration is greater than max_duration")
    if (min_duration or 0) < 0 or (max_duration or 0) < 0:
        raise ValueError("durations must be positive")
    out = flat if include_errors else flat.where(~F.col("has_error"))
    seconds = F.col("duration_seconds")
    if min_duration:
        out = out.where((seconds != 0) & (seconds >= min_duration))
    if max_duration:
        out = out.where((seconds != 0) & (seconds <= max_duration))
    return out.where(F.col(KINDS[kind]).isin(list(names))) if names else out


def name_sequence(flat: DataFrame, kind: str = "tool") -> DataFrame:
    """`(trace_id, position, name, length)` in start order, for traces of any length."""
    named = flat.where(F.col(KINDS[kind]).isNotNull() & F.col("start_time").isNotNull()).select(
        "trace_id", "start_time", "run_id", F.col(KINDS[kind]).alias("name"))
    ranked = running_weight(named, ["start_time", "run_id", "trace_id"], by=["trace_id"])
    return ranked.select("trace_id", (F.col("_before") + 1).alias("position"), "name", F.col("_total").alias("length"))


def workflow_summary(flat: DataFrame, kind: str = "tool") -> DataFrame:
    """One row per trace: counts, durations, errors, first and last run.

    The mean duration divides by all runs, those without a duration included.
    """
    name = KINDS[kind]
    shown = "tool_name" if kind == "tool" else "run_name"
    order = F.when(F.col("start_time").isNotNull(), F.struct("start_time", "run_id"))
    aggs = [
        F.count(F.lit(1)).alias("run_count"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_duration"),
        F.count_if("has_error").alias("error_count"),
        F.count_distinct(name).alias("unique_names"),
        F.min_by(shown, order).alias("first_name"), F.max_by(shown, order).alias("last_name"),
        F.min("start_time").alias("workflow_start"), F.max_by("end_time", order).alias("workflow_end"),
    ]
    if kind == "model":
        aggs += [F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
                 F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost")]
    out = flat.groupBy("trace_id").agg(*aggs)
    return out.withColumn("avg_duration", ratio("total_duration", "run_count")).withColumn(
        "success_rate", 1 - ratio("error_count", "run_count"))


def workflow_overview(summary: DataFrame) -> DataFrame:
    """One row: traces, runs and runs per trace."""
    return summary.agg(F.count(F.lit(1)).alias("total_workflows"), F.sum("run_count").alias("total_runs")).withColumn(
        "avg_runs_per_workflow", ratio("total_runs", "total_workflows"))


def _usage(kind: str) -> list:
    if kind == "tool":
        return []
    return [F.sum("total_tokens").alias("total_tokens"), F.avg("total_tokens").alias("avg_tokens"),
            F.sum("total_cost").alias("total_cost"), F.avg("total_cost").alias("avg_cost")]


def run_stats(flat: DataFrame, kind: str = "tool") -> DataFrame:
    """Performance per tool or model, most calls first."""
    name = KINDS[kind]
    known = known_keys(flat, [name]).withColumnRenamed(name, "name")
    base = [
        F.count(F.lit(1)).alias("call_count"), F.count_if("has_error").alias("error_count"),
        F.avg(F.col("has_error").cast("double")).alias("error_rate"), F.avg("duration_seconds").alias("avg_duration"),
        F.min("duration_seconds").alias("min_duration"), F.max("duration_seconds").alias("max_duration"),
        F.stddev_samp("duration_seconds").alias("std_duration"), *_usage(kind),
    ]
    stats = column_quantiles(known, ["name"], {"duration_seconds": {"median_duration": 0.5}}, also=base)
    return stats.orderBy(F.desc("call_count"), "name")


def overall_stats(flat: DataFrame, kind: str = "tool") -> DataFrame:
    """One row over all runs."""
    median = group_quantiles(flat, [], "duration_seconds", {"m": 0.5})
    return flat.agg(
        F.count(F.lit(1)).alias("total_calls"), F.avg(F.col("has_error").cast("double")).alias("error_rate"),
        F.avg("duration_seconds").alias("avg_duration"), F.count_distinct(KINDS[kind]).alias("unique_names"),
        *_usage(kind),
    ).withColumn("median_duration", median.scalar())
