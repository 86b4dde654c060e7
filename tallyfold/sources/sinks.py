"""Writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_delimited(df: DataFrame, path: str, separator: str = ",", gzip: bool = False, mode: str = "errorifexists") -> None:
    """CSV or TSV with a header line."""
    writer = df.write.mode(mode).option("header", True).option("sep", separator).option("escape", '"')
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, sort_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; `sort_by` range-partitions and sorts, so that later filters on it skip row groups."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    out.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    nested = (ArrayType, MapType, StructType)
    return df.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                      for f in df.schema])


def write_report(parts: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, str]:
    """Several tables of one report below a folder; returns where each went."""
    places = {}
    for name, df in parts.items():
        places[name] = f"{folder}/{name}"
        if kind == "json":
            write_json(df, places[name])
        else:
            write_delimited(flat_for_csv(df), places[name])
    return places


def write_per_dataset(df: DataFrame, path: str, key: str, done: DataFrame | None = None,
                      rows_per_file: int = 5_000_000) -> None:
    """One folder per dataset; datasets in `done` are skipped.

    A small dataset is one file. A large one is spread by a hash of its row
    numbers over as many files as its size asks for, each written by a task of
    its own. A null key is a dataset like any other.
    """
    todo = df
    if done is not None:
        seen = done.select(F.col(key).alias("_seen")).distinct()
        todo = df.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
    sizes = todo.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    numbered = todo.withColumn("_row", F.monotonically_increasing_id())
    salted = numbered.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_file", F.pmod(F.xxhash64("_row"), F.col("_files")))
    salted.repartition(F.col(key), F.col("_file")).select(df.columns).write.mode("append").partitionBy(key).parquet(path)
