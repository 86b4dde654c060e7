"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


# folders made for local sessions without a setting, by application id; they go when the process ends
_own_folders: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tallyfold") -> SparkSession:
    """A session with the settings the operators rely on.

    Nothing here sizes the cluster: leave `shuffle_partitions` unset there and
    let the submit configuration decide.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir` of the session.

    A local session without the setting gets a fresh folder of its own; on a
    cluster a missing setting is an error, since a machine-local folder would
    be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.TemporaryDirectory(prefix="tallyfold-", ignore_cleanup_errors=True)
    return _own_folders[app].name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never handed out twice."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs one file read instead of the
    whole plan, and gives later joins real size statistics.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them ends, for queries whose results are written or collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_measured(df: DataFrame, path: str, **measures: Column) -> dict[str, object]:
    """Write `df` and return aggregates over it, taken while it is written."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in measures.items()]).write.parquet(path)
    return seen.get
