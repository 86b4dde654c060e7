"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from ..session import materialize
from .joins import all_combinations, null_safe_join
from .ranked import column_quantiles, group_quantiles, running_weight


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with every key present: grouping leaves the others out."""
    return df.dropna(subset=list(keys))


def group_sum(df: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """`group_sum(df, ['year', 'organism'], cells='n_cells')`; null keys are left out."""
    return known_keys(df, keys).groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def mean_and_std(df: DataFrame, keys: Sequence[str], value: str, single_std: float | None = None) -> DataFrame:
    """Mean and sample deviation; `single_std` stands in for a group of one row."""
    std = F.stddev_samp(value)
    if single_std is not None:
        std = F.coalesce(std, F.lit(float(single_std)))
    return known_keys(df, keys).groupBy(*keys).agg(F.avg(value).alias("mean"), std.alias("std"))


def frequent(df: DataFrame, keys: Sequence[str], at_least: int = 1, name: str = "n") -> DataFrame:
    """Rows per key, for keys that reach the threshold."""
    counted = known_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return counted.where(F.col(name) >= at_least)


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, quartiles and max of a column."""
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    base = [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"), F.max(value).alias("max")]
    out = column_quantiles(df, by, {value: names}, also=base)
    return out.select(*by, "count", "mean", "std", "min", *names, "max")


def box_stats(df: DataFrame, by: Sequence[str], value: str, method: str = "nearest") -> DataFrame:
    """Quartiles, extremes and whiskers that end inside the data."""
    by, names = list(by), {"q1": 0.25, "med": 0.5, "q3": 0.75}
    ends = [F.min(value).alias("min"), F.max(value).alias("max")]
    if method == "approx":
        stats = null_safe_join(df.groupBy(*by).agg(*ends), group_quantiles(df, by, value, names, method), by, "inner")
    else:
        stats = column_quantiles(df, by, {value: names}, method, also=ends).where("q1 is not null")
    iqr = F.col("q3") - F.col("q1")
    return stats.withColumn("iqr", iqr).select(
        *by, "q1", "med", "q3", "min", "max", "iqr",
        F.greatest(F.col("q1") - 1.5 * F.col("iqr"), F.col("min")).alias("whislo"),
        F.least(F.col("q3") + 1.5 * F.col("iqr"), F.col("max")).alias("whishi"),
    )


def ratio_of_sums(df: DataFrame, part: str, whole: str, by: Sequence[str] = (), name: str = "ratio") -> DataFrame:
    return df.groupBy(*by).agg(ratio(F.sum(part), F.sum(whole)).alias(name))


def with_group_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the group total to each row. A join, so no group is sorted in one task."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return null_safe_join(df, totals, keys, "inner")


def share_within(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Value as a share of its group's total; the whole table with no keys."""
    if not keys:
        total = df.agg(F.sum(value).alias("t")).scalar()
        return df.withColumn(name, ratio(F.col(value), total))
    return with_group_total(df, keys, value, "_total").withColumn(name, ratio(value, "_total")).drop("_total")


def append_totals(df: DataFrame, keys: Sequence[str], label: str, value: str, total_label: str = "Total") -> DataFrame:
    """Adds one row per `keys` with the sum over all labels."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn(label, F.lit(total_label))
    return df.select(*keys, label, value).unionByName(totals)


def row_of_max(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """The row with the group's largest value; the smallest `tie` wins a tie."""
    rest = [c for c in df.columns if c not in (*by, value, tie)]
    best = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min(F.struct((-F.col(value)).alias("_v"), F.col(tie).alias(tie), *rest, value)).alias("_row"))
    return best.select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns])


def share_change(df: DataFrame, period: str, label: str, value: str, first: int, second: int) -> DataFrame:
    """Per-cent share of each label in two periods and the difference; both must have it."""
    at = {"first": first, "second": second}
    sums = (
        df.where(F.col(period).isin(list(at.values())) & F.col(label).isNotNull())
        .groupBy(label)
        .agg(*[F.sum(F.when(F.col(period) == p, F.col(value))).alias(n) for n, p in at.items()])
    )
    sums = materialize(sums, "sums")
    totals = sums.agg(*[F.sum(n).alias(n) for n in at]).select(F.struct(*at)).scalar()
    shares = {f"{n}_percent": ratio(F.col(n), totals[n]) * 100 for n in at}
    return (
        sums.where(F.col("first").isNotNull() & F.col("second").isNotNull())
        .select(label, *[c.alias(n) for n, c in shares.items()])
        .withColumn("delta_percent", F.col("second_percent") - F.col("first_percent"))
    )


def shared_categories(df: DataFrame, group: str, category: str, at_least: int) -> DataFrame:
    """Categories seen in at least so many groups."""
    return (
        df.groupBy(category).agg(F.count_distinct(group).alias("n_groups")).where(F.col("n_groups") >= at_least)
    )


def pivot_top(df: DataFrame, row: str, category: str, value: str, top: Sequence[str],
              other: str = "other") -> DataFrame:
    """One row per `row`, a column for each top category and one for the rest, 0 where absent."""
    label = F.when(F.col(category).isin(list(top)), F.col(category)).otherwise(F.lit(other))
    return (
        df.withColumn("_label", label).groupBy(row).pivot("_label", [*top, other]).agg(F.sum(value)).fillna(0)
    )


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Key/value rows as one row per key."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def nested_counts(df: DataFrame, outer: str, counts: str) -> DataFrame:
    """A map of counts per row as rows `(outer, label, n)`, labels of the same outer key added up."""
    return (
        df.select(outer, F.explode(counts).alias("label", "n")).groupBy(outer, "label").agg(F.sum("n").alias("n"))
    )


def mapped_counts(counts: DataFrame, outer: str, mapping: DataFrame) -> DataFrame:
    """Counts per broader category; labels the mapping does not know are dropped."""
    return counts.join(mapping, "label").groupBy(outer, "category").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, bin_column: Column, cumulative: bool = False, name: str = "bin") -> DataFrame:
    """Rows per bin; `cumulative` adds the share of rows up to each bin."""
    counts = df.select(bin_column.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"))
    if not cumulative:
        return counts
    ranked = running_weight(counts, [name], weight="n")
    return ranked.select(name, "n", ((F.col("_before") + F.col("n")) / F.col("_total")).alias("cumulative_share"))


def histogram_2d(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return (
        df.select(x.alias("x_bin"), y.alias("y_bin")).dropna().groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def flag_counts(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One row: the number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def _found_items(tables: Mapping[str, DataFrame], group: str, item: str) -> DataFrame:
    """Each (group, item) once, with a flag per table that has it."""
    rows = reduce(DataFrame.unionByName, [
        df.select(group, item, *[F.lit(name == other).alias(other) for other in tables]) for name, df in tables.items()
    ])
    return rows.groupBy(group, item).agg(*[F.bool_or(name).alias(name) for name in tables])


def recovered_fraction(ranked: DataFrame, markers: DataFrame, group: str, item: str) -> DataFrame:
    """Share of each group's markers among its ranked items.

    Groups without ranked items or without markers are left out.
    """
    found = _found_items({"_marker": markers, "_ranked": ranked}, group, item)
    return (
        found.groupBy(group)
        .agg(F.count_if("_marker").alias("n_markers"), F.count_if(F.col("_marker") & F.col("_ranked")).alias("n_found"),
             F.bool_or("_ranked").alias("_any"))
        .where(F.col("_any") & (F.col("n_markers") > 0))
        .select(group, "n_markers", "n_found", ratio("n_found", "n_markers").alias("fraction"))
    )


def set_recovery(left: DataFrame, right: DataFrame, markers: DataFrame, group: str, item: str) -> DataFrame:
    """Markers found by two rankings: shares, shared share and Jaccard similarity.

    Only groups ranked on both sides that have markers; an empty union has similarity 0.
    """
    found = _found_items({"_marker": markers, "_left": left, "_right": right}, group, item)
    a, b = F.col("_marker") & F.col("_left"), F.col("_marker") & F.col("_right")
    counts = found.groupBy(group).agg(
        F.count_if("_marker").alias("n_markers"), F.count_if(a).alias("n_left"), F.count_if(b).alias("n_right"),
        F.count_if(a & b).alias("n_shared"), F.count_if(a | b).alias("_union"),
        (F.bool_or("_left") & F.bool_or("_right")).alias("_both"),
    )
    return counts.where(F.col("_both") & (F.col("n_markers") > 0)).select(
        group, "n_markers",
        ratio("n_left", "n_markers").alias("left_fraction"),
        ratio("n_right", "n_markers").alias("right_fraction"),
        ratio("n_shared", "n_markers").alias("shared_fraction"),
        F.coalesce(ratio("n_shared", "_union"), F.lit(0.0)).alias("jaccard"),
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows, mismatches and accuracy in per cent; two nulls agree."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("n_mismatch"),
    ).withColumn("accuracy", (1 - ratio("n_mismatch", "n_rows")) * 100)


def mismatches(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Cells of the matrix over all labels of both columns.

    `share` is normalised per predicted label and 0 where that label was never predicted.
    """
    known = known_keys(df, [predicted, actual])
    counts = known.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "counts")
    labels = counts.select(F.col("actual").alias("l")).union(counts.select("predicted")).distinct()
    cells = all_combinations(labels.select(F.col("l").alias("actual")), labels.select(F.col("l").alias("predicted")))
    full = cells.join(counts, ["actual", "predicted"], "left").fillna({"n": 0})
    shares = with_group_total(full, ["predicted"], "n", "_column")
    return shares.select("actual", "predicted", "n", F.coalesce(ratio("n", "_column"), F.lit(0.0)).alias("share"))
