"""Approximate nearest neighbours by refining a graph, with work per row that does not grow with the table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession, size: int = 16 << 20):
    """Arrow batches of bounded size while rows hold groups of vectors; a limit that the session sets itself stays."""
    before = spark.conf.get(_BATCH, None)
    if before is not None and 0 < int(before) <= size:
        yield
        return
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _share(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the values only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _groups(points: DataFrame, n: int, leaf: int, trees: int, seed: int) -> DataFrame:
    """`(members)`: groups of about `leaf` rows on the same sides of random planes, `trees` times, and once at random.

    A side that holds too many rows, as of copies, is cut by a hash.
    """
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    centre = points.agg(Summarizer.mean(array_to_vector(F.col("v").cast("array<double>"))).alias("m")).first().m.toArray()
    planes = np.random.default_rng(seed).normal(size=(trees, depth, len(centre)))
    shared = points.sparkSession.sparkContext.broadcast((centre, planes))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, planes = shared.value
        for batch in source:
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) - centre
            codes = [((x @ p.T > 0) @ (1 << np.arange(len(p), dtype=np.int64))).astype(np.int64) for p in planes]
            codes = np.stack(codes, axis=1) if len(codes) else np.zeros((batch.num_rows, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["row", "codes"])

    coded = points.select("row", "v").mapInArrow(place, "row long, codes array<long>")
    at_random = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(max(1, n // leaf)))
    placed = materialize(coded.select("row", F.posexplode(F.array_append("codes", at_random)).alias("tree", "code")), "leaves")
    cuts = placed.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("cuts"))
    cut = placed.join(cuts, ["tree", "code"]).select("row", "tree", "code", F.pmod(F.xxhash64("row", "tree"), F.col("cuts")).alias("cut"))
    return cut.join(points.select("row", "v"), "row").groupBy("tree", "code", "cut").agg(
        F.collect_list(F.struct("row", "v")).alias("members")).select("members")


def _compared(groups: DataFrame, best: int) -> DataFrame:
    """`(row, other, far)`: for each member of a group the `best` nearest other members."""
    schema = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("far", pa.float64())])

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            flat, sizes = batch.column(0).flatten(), batch.column(0).value_lengths().to_numpy()
            if not len(flat):
                continue
            rows = flat.field(0).to_numpy()
            vectors = flat.field(1).flatten().to_numpy().astype(float).reshape(len(rows), -1)
            found: list[list[np.ndarray]] = [[], [], []]
            start = 0
            for size in sizes:
                ids, x = rows[start:start + size], vectors[start:start + size]
                start += size
                if size < 2:
                    continue
                far = np.stack([((x - q) ** 2).sum(axis=1) for q in x])
                np.fill_diagonal(far, np.inf)
                at = np.argsort(far, axis=1, kind="stable")[:, :min(best, size - 1)]
                found[0].append(np.repeat(ids, at.shape[1]))
                found[1].append(ids[at.ravel()])
                found[2].append(np.sqrt(np.take_along_axis(far, at, axis=1).ravel()))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], schema=schema)

    return groups.mapInArrow(compare, "row long, other long, far double")


def _nearest(edges: DataFrame, width: int) -> DataFrame:
    """The `width` nearest others of each row; `fresh` is 1 on edges that were not there before. Proposals of a row are few."""
    once = edges.groupBy("row", "other").agg(F.min("far").alias("far"), F.min("fresh").alias("fresh"))
    lists = once.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other", "fresh"))), 1, width).alias("near"))
    return lists.select("row", F.explode("near").alias("e")).select("row", "e.other", "e.far", "e.fresh")


def _local_groups(graph: DataFrame, points: DataFrame, sample: int, turn: int, width: int) -> DataFrame:
    """`(members)`: each row with about `sample` of its neighbours and about `sample` rows that have it as a neighbour.

    Edges are thinned by the number that end at a row, so that a row that is
    near to very many others is in a bounded number of groups on average.
    """
    asked = graph.groupBy("other").agg(F.count(F.lit(1)).alias("asked"))
    kept = graph.join(asked, "other").where(
        _share("row", "other", F.lit(turn)) < F.least(F.lit(1.0), sample / F.col("asked"), F.lit(sample / width)))
    kept = kept.select("row", "other")
    pairs = kept.unionByName(kept.select(F.col("other").alias("row"), F.col("row").alias("other"))).unionByName(
        kept.select("row", F.col("row").alias("other"))).distinct()
    return pairs.withColumnsRenamed({"row": "centre", "other": "row"}).join(points.select("row", "v"), "row").groupBy("centre").agg(
        F.collect_list(F.struct("row", "v")).alias("members")).select("members")


def neighbour_graph(df: DataFrame, id_col: str, vector: str, k: int, width: int | None = None, leaf: int = 128,
                    trees: int = 6, sample: int = 15, turns: int = 12, least_change: float = 0.005,
                    seed: int = 42) -> DataFrame:
    """Approximate k nearest neighbours `(id, neighbour, distance, rank)`.

    Each row starts with neighbours from groups of about `leaf` rows cut by
    random planes. Then, turn by turn, the neighbours of a row in both
    directions, `sample` each way, are compared with one another, and each
    keeps the `width` nearest it has met (3 k and 30 at least, if not given).
    It ends when less than `least_change` of the edges are new. A turn costs a
    bounded number of comparisons and vectors per row, whatever the table's
    size; every turn is written out, so lost executors cost one of them.

    Each row of the table is a row of the graph, also repeated ones. Rows with a
    null id, or with a vector that is null, empty, not finite or of another width
    than most, take no part. Ties go to the row first read.
    """
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # single precision stays as it is while vectors travel; distances are computed in double precision
    kept = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast(kept).alias("v"))
    points = materialize(rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & usable).withColumn("row", F.monotonically_increasing_id()), "points")
    widths = points.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    names = points.select("row", "id")
    if widths is None:
        return names.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    points = points.where(F.size("v") == widths.width)
    width = width or max(30, 3 * k)
    with _small_batches(df.sparkSession):
        first = _compared(_groups(points, widths["count"], leaf, trees, seed), width).withColumn("fresh", F.lit(1))
        graph = materialize(_nearest(first, width), "graph")
        for turn in range(turns):
            proposed = _compared(_local_groups(graph, points, sample, seed + turn, width), sample).withColumn("fresh", F.lit(1))
            graph = materialize(_nearest(graph.withColumn("fresh", F.lit(0)).unionByName(proposed), width), "graph")
            change = graph.agg(F.coalesce(F.avg("fresh"), F.lit(0.0))).first()[0]
            if change < least_change:
                break
    lists = graph.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k).alias("near"))
    best = lists.select("row", F.posexplode("near").alias("at", "e")).select("row", F.col("e.other").alias("other"), F.col("e.far").alias("distance"), (F.col("at") + 1).alias("rank"))
    return best.join(names, "row").join(names.select(F.col("row").alias("other"), F.col("id").alias("neighbour")), "other").select(
        "id", "neighbour", "distance", "rank")
