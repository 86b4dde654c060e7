"""Process what is new, keep what is done."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.joins import first_row
from ..session import materialize


def pending(df: DataFrame, done: DataFrame, key: str, retry_failed: bool = True) -> DataFrame:
    """One row per key that is not done yet.

    With a `status` column in `done`, failed keys stay pending unless told otherwise.
    """
    finished = done
    if retry_failed and "status" in done.columns:
        finished = done.where("status = 'ok'")
    return first_row(df, [key], [key]).join(finished.select(key).distinct(), key, "left_anti")


def results_at(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows written by `carry_on`, with the run that wrote them in `_run`; empty if there are none yet."""
    full = StructType([*schema.fields, StructField("_run", LongType())])
    return _read(spark, path, full).fillna(0, ["_run"])


def carry_on(df: DataFrame, path: str, schema: StructType, key: str, work: Callable[[DataFrame], DataFrame],
             chunk_rows: int = 100_000) -> DataFrame:
    """Runs `work` on the keys that have no result at `path` yet, and returns the newest result of every key.

    The pending keys are written out and fall into chunks of about `chunk_rows`
    by the hash of the key. Each chunk is worked on once and its results are
    appended before the next one starts, so a run that is cut off loses one
    chunk at most and the next run goes on behind it.
    """
    spark = df.sparkSession
    done = results_at(spark, path, schema)
    run = done.agg(F.coalesce(F.max("_run"), F.lit(0)) + 1).first()[0]
    todo = materialize(pending(df, newest_results(done, key), key), "pending")
    chunks = -(-todo.count() // chunk_rows)
    for chunk in range(chunks):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == chunk)
        work(part).select(schema.names).withColumn("_run", F.lit(run).cast("long")).write.mode("append").parquet(path)
    return newest_results(results_at(spark, path, schema), key).drop("_run")


def newest_results(results: DataFrame, key: str) -> DataFrame:
    return first_row(results, [key], ["_run"], last=True)


def isolated(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType,
             timeout: float | None = None) -> DataFrame:
    """Runs `work` on Arrow batches; a row that makes it fail gets nulls and its error.

    `work` returns one row per row it gets, with the columns of `schema`;
    `status` and `error` are added. A failing batch, or one that returns another
    number of rows, is halved until the rows at fault stand alone, so the others
    cost little more than without failures. What the pieces of a batch return
    goes on as few frames, however many failed. With a `timeout`, rows are worked
    on one by one and a row that takes more seconds has failed. Rows are dealt
    evenly over the tasks first, since a small file may hold a lot of work.
    """
    spark = df.sparkSession
    full = StructType([*schema.fields, StructField("status", StringType()), StructField("error", StringType())])
    names = [f.name for f in schema.fields]

    def attempt(pdf: pd.DataFrame, good: dict[tuple, list[pd.DataFrame]], bad: list[tuple]) -> None:
        try:
            with _time_limit(timeout):
                out = work(pdf)[names]
            if len(out) != len(pdf):
                raise ValueError(f"{len(out)} rows returned for {len(pdf)}")
            good.setdefault(tuple(map(str, out.dtypes)), []).append(out)
        except Exception as e:  # whatever one item raises must not end the others
            if len(pdf) > 1:
                half = len(pdf) // 2
                attempt(pdf.iloc[:half], good, bad)
                attempt(pdf.iloc[half:], good, bad)
            else:
                kept = (pdf[n].to_list()[0] if n in pdf.columns else None for n in names)
                bad.append((*kept, "failed", f"{type(e).__name__}: {e}"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            # frames of unlike types stay apart, so that none of them changes its values
            good: dict[tuple, list[pd.DataFrame]] = {}
            bad: list[tuple] = []
            step = len(pdf) if timeout is None else 1
            for i in range(0, len(pdf), step or 1):
                attempt(pdf.iloc[i:i + step], good, bad)
            for pieces in good.values():
                yield pd.concat(pieces, ignore_index=True).assign(status="ok", error=None)
            if bad:
                yield pd.DataFrame(dict(zip(full.names, map(list, zip(*bad)))))

    dealt = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(dealt).mapInPandas(run, full)


@contextmanager
def _time_limit(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError inside the block once the time is over. Tasks run in the main thread of their worker."""
    if seconds is None:
        yield
        return

    def over(*_):
        raise TimeoutError(f"more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _found(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """Parquet rows below a path, None if nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet rows below a path, none if nothing was written there."""
    found = _found(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


class VersionedTable:
    """A keyed parquet table that grows by batches: the newest row of a key counts.

    Rows lie in one partition per batch. A batch overwrites its own partition
    only, so one that runs again after a failure changes nothing. The checkpoint
    that numbers the batches belongs to the table and lies beside its rows.

    `fold` writes the newest rows of all batches as a base, once some batches
    have come in since the last one. Batches that a base covers are not read
    again. A base counts when its number is noted, after it has been written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.schema, self.keys = spark, schema, list(keys)
        self.rows, self.checkpoint = f"{path}/rows", f"{path}/checkpoint"
        self.bases, self.folded = f"{path}/bases", f"{path}/folded"

    def read(self) -> DataFrame:
        """One row per key, that of its last batch."""
        base = self._base()
        rows = self._rows_after(base)
        if base is not None:
            folded = self.spark.read.schema(self.schema).parquet(f"{self.bases}/{base}")
            rows = rows.unionByName(folded.withColumn("_version", F.lit(base).cast("long")))
        return first_row(rows, self.keys, ["_version"], last=True).select(self.schema.names)

    def _base(self) -> int | None:
        """The last batch that the newest base covers."""
        noted = _found(self.spark, self.folded, StructType([StructField("version", LongType())]))
        return noted.agg(F.max("version")).first()[0] if noted is not None else None

    def _rows_after(self, base: int | None) -> DataFrame:
        """Rows of the batches after the base. The others' partitions are pruned."""
        rows = _read(self.spark, self.rows, StructType([*self.schema.fields, StructField("_version", LongType())]))
        return rows if base is None else rows.where(F.col("_version") > base)

    def fold(self, after: int) -> bool:
        """Write the next base if `after` batches or more have come in since the last one. Not while a batch is merged."""
        seen = self._rows_after(self._base()).agg(F.count_distinct("_version").alias("n"), F.max("_version").alias("last")).first()
        if seen.n < after or not seen.n:
            return False
        self.read().write.mode("overwrite").parquet(f"{self.bases}/{seen.last}")
        noted = self.spark.createDataFrame([(seen.last,)], "version long")
        noted.coalesce(1).write.mode("append").parquet(self.folded)
        return True

    def merge(self, incoming: DataFrame, version: int, order_by: Sequence[str]) -> None:
        """Adds the first row by `order_by` of each key of a batch; it replaces what the key had."""
        rows = first_row(incoming, self.keys, order_by).select(*self.schema.names, F.lit(version).cast("long").alias("_version"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version").parquet(self.rows)

    def check(self) -> None:
        """Rows without a checkpoint would be overwritten by batches that count from zero again."""
        kept = StructType([StructField("value", StringType())])
        try:
            self.spark.read.schema(kept).text(f"{self.checkpoint}/metadata")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if not self.read().isEmpty():
                raise ValueError(f"{self.rows} has rows, but its checkpoint {self.checkpoint} is missing") from e


def follow_files(spark: SparkSession, folder: str, schema: StructType, table: VersionedTable,
                 order_by: Sequence[str], pattern: str = "*.parquet",
                 prepare: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int | None = None,
                 fold_after: int = 8) -> DataFrame:
    """Upserts every file that has arrived since the last call, then stops. Returns the table after the last batch.

    After `fold_after` batches the table is folded, so a call reads a base and a few batches however many there were.
    """
    table.check()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(prepare(batch), batch_id, order_by)

    query = (
        reader.parquet(folder).writeStream.foreachBatch(write)
        .option("checkpointLocation", table.checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table.fold(fold_after)
    return table.read()
