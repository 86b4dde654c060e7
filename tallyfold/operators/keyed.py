"""Tables kept in hash buckets of their key, so that lookups and upserts touch the buckets they need."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import materialize
from .merge import incoming_rows

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A table at `path`, one folder for each of `buckets` hash buckets of its key.

    Choose `buckets` so that one of them is a few hundred MB; a bucket is
    written by one task. Path, key and number of buckets belong together and do
    not change later. Rows of a bucket are sorted by key, so a lookup skips row
    groups too. A null key is a key like any other in merges; lookups never
    find it.

    A merge replaces whole folders after its result has been written out, so
    lost executors do no harm and the same rows can be merged again. Folders
    are moved one by one: let nobody read or write the table meanwhile, and
    restore it if the driver itself is lost in that moment.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str]
    buckets: int

    def __post_init__(self):
        if BUCKET in self.schema.names:
            raise ValueError(f"a column may not be called {BUCKET}")

    def create(self, rows: DataFrame) -> None:
        """Write the first version. The path must be new."""
        self._write(self._placed(rows.select(self.schema.names)), "errorifexists")

    def rows(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """Rows whose key is in `ids`, which holds the key columns; other buckets are not opened."""
        wanted = materialize(self._placed(ids.select(*self.keys).dropna().distinct()), "ids")
        return self._only(self._stored(), wanted).join(wanted, [BUCKET, *self.keys], "left_semi").select(self.schema.names)

    def upsert(self, incoming: DataFrame, order_by: Sequence[Column | str] = (), skip: Sequence[str] = ("id",)) -> int:
        """Insert incoming rows or write them over the rows of the same key, by the rules of `merge.upsert`.

        Returns how many buckets were written again: those in which a row is new or differs.
        """
        return self._merge(incoming, order_by, skip, "full")

    def update(self, incoming: DataFrame, order_by: Sequence[Column | str] = (), skip: Sequence[str] = ("id",)) -> int:
        """Like `upsert`, but keys the table does not have are ignored."""
        return self._merge(incoming, order_by, skip, "left")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        # the hash of a number depends on its type
        typed = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int"))

    def _only(self, rows: DataFrame, like: DataFrame) -> DataFrame:
        """Rows in the buckets that `like` has. The list is no longer than the number of buckets."""
        hit = [r[0] for r in like.select(BUCKET).distinct().collect()]
        return rows if len(hit) == self.buckets else rows.where(F.col(BUCKET).isin(hit))

    def _write(self, rows: DataFrame, mode: str) -> None:
        sorted_rows = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        sorted_rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _merge(self, incoming: DataFrame, order_by: Sequence[Column | str], skip: Sequence[str], how: str) -> int:
        new = materialize(self._placed(incoming_rows(self.rows(), incoming, self.keys, order_by, skip)), "incoming")
        base = self._only(self._stored(), new)
        a, b = base.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
        same = F.col(f"a.{BUCKET}") == F.col(f"b.{BUCKET}")
        for k in self.keys:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        differs, cols = F.col("a._old").isNull(), []
        for name in self.schema.names:
            old, given = F.col(f"a.{name}"), F.col(f"b.{name}") if name in new.columns else None
            if given is None:
                cols.append(old)
                continue
            cols.append(F.when(F.col("b._new"), given).otherwise(old).alias(name))
            differs = differs | ~old.eqNullSafe(given)
        changed = F.coalesce(F.col("b._new") & differs, F.lit(False)).alias("_changed")
        merged = materialize(a.join(b, same, how).select(*cols, F.coalesce(f"a.{BUCKET}", f"b.{BUCKET}").alias(BUCKET), changed), "merged")
        touched = [r[0] for r in merged.where("_changed").select(BUCKET).distinct().collect()]
        if touched:
            self._write(merged.where(F.col(BUCKET).isin(touched)).drop("_changed"), "overwrite")
        return len(touched)
