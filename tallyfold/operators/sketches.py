"""Sets of ids as sketches of bounded size, which merge without reading the ids again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from .aggregate import known_keys

#: log2 of the ids a sketch holds. Sets up to that size are exact; the relative error of larger ones is about 0.8 %.
SKETCH_SIZE = 14


def id_sketches(df: DataFrame, keys: Sequence[str], item: str, size: int = SKETCH_SIZE) -> DataFrame:
    """`(keys, ids)`: a theta sketch of the distinct items per group.

    Rows without a key are left out, null items are not counted. Tasks build
    partial sketches, so the shuffle grows with the groups, not with the rows.
    """
    return known_keys(df, keys).groupBy(*keys).agg(F.theta_sketch_agg(item, size).alias("ids"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups, such as all periods of a tissue, from finer ones."""
    return known_keys(sketches, keys).groupBy(*keys).agg(F.theta_union_agg("ids", size).alias("ids"))


def _size(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def sketch_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Sizes of both sets, of what they share and of their union, and the Jaccard similarity, per group.

    A group on one side only has an empty set on the other. The error of
    `n_shared` goes with the union, so a tiny overlap of huge sets is uncertain.
    An empty union has similarity 0.
    """
    both = left.withColumnRenamed("ids", "_a").join(right.withColumnRenamed("ids", "_b"), list(keys), "full")
    a, b = F.col("_a"), F.col("_b")
    union = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.theta_union(a, b, size))
    out = both.select(
        *keys, _size(a).alias("n_left"), _size(b).alias("n_right"),
        _size(F.theta_intersection(a, b)).alias("n_shared"), _size(union).alias("n_union"))
    return out.withColumn("jaccard", F.coalesce(ratio("n_shared", "n_union"), F.lit(0.0)))


def sketch_recovery(left: DataFrame, right: DataFrame, markers: DataFrame, group: str, size: int = SKETCH_SIZE) -> DataFrame:
    """`aggregate.set_recovery` from three tables of sketches `(group, ids)`: same columns, same groups, estimated counts."""
    a, b, m = F.col("_a"), F.col("_b"), F.col("_m")
    joined = markers.withColumnRenamed("ids", "_m").join(left.withColumnRenamed("ids", "_a"), group).join(
        right.withColumnRenamed("ids", "_b"), group)
    found = joined.withColumns({"_a": F.theta_intersection(m, a), "_b": F.theta_intersection(m, b)})
    counts = found.select(
        group, _size(m).alias("n_markers"), _size(a).alias("_left"), _size(b).alias("_right"),
        _size(F.theta_intersection(a, b)).alias("_shared"), _size(F.theta_union(a, b, size)).alias("_union"))
    return counts.where("n_markers > 0").select(
        group, "n_markers", ratio("_left", "n_markers").alias("left_fraction"),
        ratio("_right", "n_markers").alias("right_fraction"), ratio("_shared", "n_markers").alias("shared_fraction"),
        F.coalesce(ratio("_shared", "_union"), F.lit(0.0)).alias("jaccard"))
