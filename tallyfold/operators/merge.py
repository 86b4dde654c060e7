"""Upsert and update of a keyed table, as a new version of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from ..functions.numeric import within_int32
from .joins import first_row


def incoming_rows(base: DataFrame, incoming: DataFrame, keys: Sequence[str],
              order_by: Sequence[Column | str], skip: Sequence[str]) -> DataFrame:
    """One row per key, with the base's columns only, in the base's types."""
    picked = first_row(incoming, keys, order_by)
    cols = []
    for field in base.schema:
        if field.name in picked.columns and (field.name in keys or field.name not in skip):
            c = F.col(field.name)
            if isinstance(field.dataType, (ByteType, ShortType, IntegerType)):
                c = within_int32(c)
            cols.append(c.cast(field.dataType).alias(field.name))
    return picked.select(cols)


def _merged(base: DataFrame, new: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    a = base.withColumn("_in_base", F.lit(True)).alias("a")
    b = new.withColumn("_in_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], how)
    cols = []
    for name in base.columns:
        if name in keys:
            cols.append(F.coalesce(f"a.{name}", f"b.{name}").alias(name))
        elif name in new.columns:
            cols.append(F.when(F.col("b._in_new"), F.col(f"b.{name}")).otherwise(F.col(f"a.{name}")).alias(name))
        else:
            cols.append(F.col(f"a.{name}"))
    return joined.select(cols)


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str],
           order_by: Sequence[Column | str] = (), skip: Sequence[str] = ("id",)) -> DataFrame:
    """Base with incoming rows inserted or written over the rows of the same key.

    An incoming null overwrites. Columns unknown to the base and those in `skip`
    are ignored. Of several incoming rows with one key the first by `order_by` counts.
    """
    return _merged(base, incoming_rows(base, incoming, keys, order_by, skip), keys, "full")


def update(base: DataFrame, incoming: DataFrame, keys: Sequence[str],
           order_by: Sequence[Column | str] = (), skip: Sequence[str] = ("id",)) -> DataFrame:
    """Like `upsert`, but keys the base does not have are ignored."""
    return _merged(base, incoming_rows(base, incoming, keys, order_by, skip), keys, "left")
