"""Embeddings: checks, classifiers per tissue, neighbours, cluster quality."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.text import map_label
from ..session import materialize
from .ranked import column_quantiles
from .windows import first_n

# Fixed value: columns of the published cell embedding.
EMBEDDING_WIDTH = 2058

# Refuse to ship more model weights than this to every executor.
MAX_WEIGHT_BYTES = 512 * 1024 * 1024


def wrong_width(df: DataFrame, column: str, width: int = EMBEDDING_WIDTH) -> DataFrame:
    """Rows whose vector is missing or not `width` long; empty when all is well."""
    return df.where(F.col(column).isNull() | (F.size(column) != width))


def unmatched_cells(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of keys that only one side has, per side."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def dataset_facts(datasets: DataFrame, metadata: DataFrame, key: str, tissue_map: Mapping[str, str] | None = None) -> DataFrame:
    """Organism and tissue of each dataset, with human and mouse flags; null if unknown."""
    out = datasets.select(key).distinct().join(metadata.select(key, "organism", "tissue"), key, "left")
    if tissue_map:
        out = out.withColumn("tissue", map_label("tissue", tissue_map))
    return out.withColumn("is_human", F.col("organism") == "Homo sapiens").withColumn(
        "is_mouse", F.col("organism") == "Mus musculus")


@dataclass(frozen=True)
class TissueModel:
    """A fitted classifier as plain arrays: scale, then one weight row per label."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    labels: tuple[str, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.asarray(self.labels, dtype=object)[np.argmax(z @ self.weights.T + self.bias, axis=1)]


def train_model(cells: DataFrame, features: str, label: str, max_iter: int = 1000) -> TissueModel:
    """Standardised multinomial logistic regression on one set of cells.

    The penalty on the weights is a sum over cells, hence 1/n in Spark's averaged objective.
    """
    data = cells.select(array_to_vector(features).alias("_raw"), F.col(label).cast("string").alias("_label"))
    indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(data)
    labels = tuple(indexer.labels)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(data)
    n = data.count()
    # the fit scales by the sample deviation, the penalty is meant for the population one
    shrink = np.sqrt((n - 1) / n) if n > 1 else 1.0
    mean, scale = scaler.mean.toArray(), scaler.std.toArray() * shrink
    scale = np.where(scale > 0, scale, 1.0)
    if len(labels) == 1:
        width = len(mean)
        return TissueModel(mean, scale, np.zeros((1, width)), np.zeros(1), labels)
    ready = scaler.transform(indexer.transform(data))
    fitted = LogisticRegression(
        featuresCol="_x", labelCol="_y", maxIter=max_iter, regParam=shrink**2 / n, elasticNetParam=0.0,
        standardization=False, family="multinomial",
    ).fit(ready)
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    return TissueModel(mean, scale, weights * shrink, bias, labels)


def train_by(df: DataFrame, part: str, features: str, label: str, parts: Sequence[str] | None = None,
             max_iter: int = 1000) -> dict[str, TissueModel]:
    """One model per tissue; every fit is itself a distributed job."""
    names = parts or [r[0] for r in df.where(F.col(part).isNotNull()).select(F.col(part).cast("string")).distinct().collect()]
    return {p: train_model(df.where(F.col(part).cast("string") == p), features, label, max_iter) for p in sorted(names)}


def annotate(df: DataFrame, part: str, features: str, models: Mapping[str, TissueModel],
             name: str = "cell_type") -> DataFrame:
    """Adds the predicted label; rows of tissues without a model are left out.

    A row whose vector is null, of another width or not finite has no label. One pass over the cells in Arrow batches, each batch scored per tissue.
    """
    size = sum(m.weights.nbytes + m.mean.nbytes * 2 for m in models.values())
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of model weights are too many to ship; annotate fewer tissues at once")
    rows = df.where(F.col(part).cast("string").isin(sorted(models)))
    shipped = df.sparkSession.sparkContext.broadcast(dict(models))
    columns = df.columns
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf[name] = None
            for tissue, at in pdf.groupby(pdf[part].astype(str)).groups.items():
                model = shipped.value[tissue]
                usable = [i for i in at if _is_vector(pdf.at[i, features], len(model.mean))]
                if usable:
                    x = np.stack([np.asarray(pdf.at[i, features], np.float64) for i in usable])
                    pdf.loc[usable, name] = model.predict(x)
            yield pdf[[*columns, name]]

    return rows.mapInPandas(score, schema)


def _is_vector(value, width: int) -> bool:
    """Whether a value has `width` finite components."""
    if value is None or np.ndim(value) != 1 or len(value) != width or any(x is None for x in value):
        return False
    return bool(np.isfinite(np.asarray(value, np.float64)).all())


def nearest_mean_models(df: DataFrame, part: str, features: str, label: str) -> dict[str, TissueModel]:
    """One model per tissue that names the label with the nearest mean vector; one aggregate for all tissues.

    The driver receives one row per (tissue, label).
    """
    parts = df.where(F.col(part).isNotNull() & F.col(label).isNotNull()).select(
        F.col(part).cast("string").alias("p"), F.col(label).cast("string").alias("l"), F.posexplode(features).alias("i", "x"))
    means = parts.groupBy("p", "l", "i").agg(F.avg("x").alias("m")).groupBy("p", "l").agg(
        F.sort_array(F.collect_list(F.struct("i", "m"))).alias("mean"))
    found: dict[str, list[tuple[str, list[float]]]] = {}
    for r in means.orderBy("p", "l").collect():
        found.setdefault(r.p, []).append((r.l, [x.m for x in r["mean"]]))
    models = {}
    for tissue, labels in found.items():
        m = np.array([mean for _, mean in labels])
        width = m.shape[1]
        models[tissue] = TissueModel(np.zeros(width), np.ones(width), 2 * m, -(m * m).sum(axis=1), tuple(l for l, _ in labels))
    return models


def _nearest_in_block(k: int, products: int = 1 << 22, gaps: int = 1 << 17):
    """The k rows of a block that lie nearest to each row that asks; ties go to the smaller id.

    Products of matrices tell which rows may be among them, with room for
    their rounding, and the distances of these are computed one by one.
    """

    def usable(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        finite = np.isfinite(x).all(axis=1)
        return pdf["id"].to_numpy()[finite], x[finite]

    def compare(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": asking["id"].iloc[:0], "neighbour": held["id"].iloc[:0], "distance": np.zeros(0)})
        if not len(held) or not len(asking):
            return empty
        (ids, x), (asked, y) = usable(held.sort_values("id", ignore_index=True)), usable(asking)
        if not len(ids) or not len(asked):
            return empty
        first, last = np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")
        with np.errstate(over="ignore", invalid="ignore"):
            squares, own = (x * x).sum(axis=1), (y * y).sum(axis=1)
            slack = 1e-15 * (x.shape[1] + 2) * (own + 2 * squares.max())
        told = np.isfinite(slack)
        # columns that stand for no row fill up the ranges, whose minima bound the k-th smallest product
        ranges = min(len(ids), max(128, 4 * k))
        width = -(-len(ids) // ranges)
        columns = np.zeros((x.shape[1] + 1, ranges * width))
        columns[:-1, :len(ids)], columns[-1] = -2 * x.T, np.inf
        columns[-1, :len(ids)] = squares
        parts = []
        for i in range(0, len(asked), max(1, products // columns.shape[1])):
            part = slice(i, i + max(1, products // columns.shape[1]))
            some = y[part]
            if told[part].all():
                far = np.column_stack([some, np.ones(len(some))]) @ columns
            else:
                far = np.tile(np.where(np.arange(columns.shape[1]) < len(ids), 0.0, np.inf), (len(some), 1))
            for row in np.flatnonzero(last[part] > first[part]):
                far[row, first[i + row]:last[i + row]] = np.inf
            bound = np.full(len(some), np.inf)
            if ranges >= k:
                bound = np.partition(far.reshape(len(some), ranges, width).min(axis=2), k - 1, axis=1)[:, k - 1] + slack[part]
            row, at = np.divmod(np.flatnonzero(far <= np.where(bound < np.inf, bound, np.finfo(float).max)[:, None]), columns.shape[1])
            exact = np.zeros(len(row))
            for j in range(0, len(row), gaps):
                gap = some[row[j:j + gaps]] - x[at[j:j + gaps]]
                exact[j:j + gaps] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            order = np.lexsort((at, exact, row))
            row, at, exact = row[order], at[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append(pd.DataFrame({"id": asked[part][row[best]], "neighbour": ids[at[best]], "distance": exact[best]}))
        near = pd.concat(parts)
        return near[np.isfinite(near["distance"])]

    return compare


def _probes_for(points: DataFrame, centres: np.ndarray, k: int, least: int, recall: float, asked: int, seed: int) -> int:
    """How many cells a row must look into to find the share `recall` of its k nearest rows, `least` or more.

    Measured on about `asked` rows, which are compared with all rows. Each task
    keeps the k best of its rows for each, with the place of their cells in the
    order in which that row looks into the cells.
    """
    some = points.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(asked).collect()
    ids, x = np.array([r.id for r in some], object), np.array([r.v for r in some], np.float64)
    squares = (centres * centres).sum(axis=1)
    places = np.argsort(np.argsort(squares - 2 * x @ centres.T, axis=1, kind="stable"), axis=1)
    shared = points.sparkSession.sparkContext.broadcast((ids, x, centres, places))

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, c, places = shared.value
        squares = (c * c).sum(axis=1)
        best, place = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int32)
        for pdf in parts:
            for i in range(0, len(pdf), 1024):
                held, v = pdf["id"].iloc[i:i + 1024].to_numpy(object), np.stack(pdf["v"].iloc[i:i + 1024].to_numpy()).astype(np.float64)
                home = np.argmin(squares - 2 * v @ c.T, axis=1)
                far = np.stack([np.sqrt(((v - q) ** 2).sum(axis=1)) for q in x])
                far[ids[:, None] == held[None]] = np.inf
                far, at_home = np.hstack([best, far]), np.hstack([place, places[:, home]])
                at = np.argsort(far, axis=1, kind="stable")[:, :k]
                best, place = np.take_along_axis(far, at, axis=1), np.take_along_axis(at_home, at, axis=1)
        kept = pd.DataFrame({"row": np.repeat(np.arange(len(x)), k), "far": best.ravel(), "place": place.ravel()})
        yield kept[np.isfinite(kept["far"])]

    found = points.select("id", "v").mapInPandas(nearest, "row int, far double, place int")
    true = first_n(found, ["row"], [F.col("far"), F.col("place")], k, "rank")
    by_place = np.zeros(len(centres), np.int64)
    for r in true.groupBy("place").count().collect():
        by_place[r.place] = r["count"]
    if not by_place.any():
        return least
    return max(least, int(np.searchsorted(np.cumsum(by_place), recall * by_place.sum())) + 1)


def _cells(points: DataFrame, cells: int, k: int, probes: int, recall: float, asked: int, sample: int, seed: int, n: int,
           regions: int) -> tuple[DataFrame, bool]:
    """`(id, v, home, near)`: the nearest centre of each row and its nearest ones, `probes` or as many as the recall takes.

    Where these are more than `regions`, cells are put together to so many
    regions; true if they are. Rows then look into whole regions.
    """
    if cells == 1:
        return points.select("id", "v", F.lit(0).alias("home"), F.array(F.lit(0)).alias("near")), False
    share = min(1.0, sample / n)
    picked = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    fitted = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="x").fit(picked.select(array_to_vector("v").alias("x")))
    found = np.array(fitted.clusterCenters())
    if len(found) > probes:
        probes = min(len(found), _probes_for(points, found, k, probes, recall, asked, seed))
    centres, wide = points.sparkSession.sparkContext.broadcast(found), probes > regions

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        squares = (c * c).sum(axis=1)
        region = np.arange(len(c)) * regions // len(c) if wide else np.arange(len(c))
        for pdf in parts:
            near = []
            for i in range(0, len(pdf), 256):
                x = np.stack(pdf["v"].iloc[i:i + 256].to_numpy()).astype(np.float64)
                at = region[np.argsort(squares - 2 * x @ c.T, axis=1, kind="stable")[:, :probes]]
                near += [list(dict.fromkeys(r)) for r in at.tolist()]
            yield pdf.assign(home=[r[0] for r in near], near=near)

    return points.mapInPandas(place, StructType([*points.schema.fields, StructField("home", IntegerType()),
                                                 StructField("near", ArrayType(IntegerType()))])), wide


def neighbours(df: DataFrame, id_col: str, vector: str, k: int, cell_rows: int = 1024, probes: int = 8,
               block: int = 2048, sample: int = 200_000, max_cells: int = 16_384, seed: int = 42,
               recall: float = 0.95, asked: int = 512) -> DataFrame:
    """Approximate k nearest neighbours `(id, neighbour, distance, rank)`.

    Rows fall into cells around centres, about `cell_rows` in each, so there are
    more cells as the table grows; a row is compared with all rows of its
    nearest cells. These are `probes` or as many as it takes to find the share
    `recall` of the true neighbours of about `asked` rows, which are compared
    with all rows first; a little more than the 0.9 that is wanted of all rows.
    Tables of up to `cell_rows * probes` rows are compared in full. The centres (at most `max_cells`, which bounds what is
    sent to the tasks) are fitted on about `sample` rows. Large cells are split
    into blocks, and so are the rows that ask them: a task holds one block of
    each, and every block is met. Where cells tell little, so that a row has to
    look into more cells than there would be regions of up to 8 blocks, it looks
    into whole regions: it travels once for each, and finds no fewer rows; the
    comparisons, by products of matrices, grow with the square of the table.
    Rows with a null id or vector take no part.
    """
    points = materialize(df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null"), "points")
    n = points.count()
    cells = max(1, min(max_cells, round(n / cell_rows)))
    region = min(8 * block, max(block, n // 12))
    placed, wide = _cells(points, cells, k, min(probes, cells), recall, asked, sample, seed, n, max(1, math.ceil(n / region)))
    placed, block = materialize(placed, "placed"), region if wide else block
    sizes = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = placed.select("id", "v", F.explode("near").alias("cell"))
    loads = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces"))
    plan = materialize(sizes.join(loads, "cell"), "cells")
    held = placed.select("id", "v", F.col("home").alias("cell")).join(plan, "cell").select(
        "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "id", "v")
    asking = asked.join(plan, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int").alias("piece"),
        F.col("id").alias("id"), F.col("v").alias("v"))
    schema = StructType([StructField("id", points.schema["id"].dataType), StructField("neighbour", points.schema["id"].dataType),
                         StructField("distance", DoubleType())])
    keys = ["cell", "block", "piece"]
    near = held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(_nearest_in_block(k), schema)
    return first_n(near, ["id"], [F.col("distance"), F.col("neighbour")], k, "rank")


def silhouette(df: DataFrame, vector: str, cluster: str) -> float:
    """Mean silhouette (squared Euclidean) of an assignment."""
    data = df.select(array_to_vector(vector).alias("features"), F.col(cluster).cast("int").alias("prediction"))
    return ClusteringEvaluator().evaluate(data)


def label_positions(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Median coordinates per label, where its name would be drawn."""
    known = df.where(F.col(label).isNotNull())
    return column_quantiles(known, [label], {x: {x: 0.5}, y: {y: 0.5}}).where(F.col(x).isNotNull() & F.col(y).isNotNull())


def trim_outliers(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    """Rows inside the low..high percentiles of every column."""
    names = {c: {f"lo_{i}": low, f"hi_{i}": high} for i, c in enumerate(columns)}
    ends = column_quantiles(df, [], names).select(F.struct("*")).scalar()
    return df.where(reduce(and_, [F.col(c).between(*(ends[n] for n in names[c])) for c in columns], F.lit(True)))


def cell_identifier(dataset: str, barcode: str) -> Column:
    """Dataset name without its sample and feature parts, joined to the barcode."""
    name = F.regexp_replace(F.col(dataset), r"_S\d+_", "_")
    name = F.regexp_replace(name, r"_GeneFull_Ex50pAS$", "")
    return F.concat(name, F.lit("_"), F.col(barcode))


def tissue_from_name(dataset: str) -> Column:
    """Second part of the dataset name without digits, in lower case."""
    return F.lower(F.regexp_replace(F.split(F.col(dataset), "_").getItem(1), r"\d+", ""))
