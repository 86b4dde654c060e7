"""Completing a table to all combinations of its keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .joins import all_combinations, null_safe_join


def key_grid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All combinations of the distinct values of each key."""
    return reduce(all_combinations, [df.select(k).distinct() for k in keys])


def complete(df: DataFrame, keys: Sequence[str], fill: float = 0,
             fill_cols: Mapping[str, object] | None = None) -> DataFrame:
    """Every combination of the keys, with missing values filled.

    `fill_cols=None` fills every other column with `fill`; a mapping fills only
    its columns. Values that were null before are filled as well. The table is
    written out first, as it is read once per key and once for the values.
    """
    keys = list(keys)
    df = materialize(df, "sums")
    joined = null_safe_join(key_grid(df, keys), df, keys, "left").select(df.columns)
    if fill_cols is not None:
        return joined.fillna(dict(fill_cols))
    out = joined
    for field in df.schema:
        if field.name not in keys:
            out = out.withColumn(field.name, F.coalesce(field.name, F.lit(fill).cast(field.dataType)))
    return out
