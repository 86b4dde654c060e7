"""Cell type classifiers of all tissues, trained side by side, and their storage."""

from __future__ import annotations

from collections.abc import Generator, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .embed import MAX_WEIGHT_BYTES, TissueModel

# Largest component of the mean gradient at which a fit ends, steps and shortest step of the line search.
TOLERANCE, MAX_STEPS, LEAST_STEP = 1e-5, 1000, 2.0**-30

MODEL_SCHEMA = "part string, place int, label string, mean array<double>, scale array<double>, weights array<double>, bias double"

Descent = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _newton_like(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last moves suggest."""
    q, weights = gradient.copy(), []
    for s, y in reversed(pairs):
        weights.append((s @ q) / (s @ y))
        q -= weights[-1] * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), w in zip(pairs, reversed(weights)):
        q += s * (w - (y @ q) / (s @ y))
    return q


def _descent(x: np.ndarray, tolerance: float, max_steps: int, memory: int = 10) -> Descent:
    """Minimise a smooth convex function: yields points, is sent value and gradient at each, returns the last good point."""
    value, gradient = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_steps):
        if np.abs(gradient).max() <= tolerance:
            break
        move = -_newton_like(gradient, pairs)
        step = 1.0 if pairs else min(1.0, 1.0 / float(np.linalg.norm(gradient)))
        while True:
            there, gradient_there = yield x + step * move
            if there <= value + 1e-4 * step * (gradient @ move) + 1e-13 * abs(value):
                break
            step /= 2
            if step < LEAST_STEP:
                return x
        s, y = step * move, gradient_there - gradient
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-(memory - 1):], (s, y)]
        x, value, gradient = x + s, there, gradient_there
    return x


def _slopes(cells: DataFrame, points: Mapping[int, tuple[np.ndarray, ...]]) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient of each tissue at its point `(mean, scale, weights with bias)`, in one job.

    Tasks add up what they read; sums per (tissue, class) are made before and in the shuffle.
    """
    shared = cells.sparkSession.sparkContext.broadcast(dict(points))
    schema = pa.schema([("p", pa.int32()), ("y", pa.int32()), ("loss", pa.float64()), ("g", pa.list_(pa.float64()))])

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses = {p: 0.0 for p in shared.value}
        sums = {p: np.zeros_like(w) for p, (_, _, w) in shared.value.items()}
        for batch in source:
            tissue, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(tissue), -1)
            for p in np.unique(tissue):
                mean, scale, w = shared.value[p]
                at = np.flatnonzero(tissue == p)
                z = np.column_stack([(x[at] - mean) / scale, np.ones(len(at))])
                logits = z @ w.T
                logits -= logits.max(axis=1, keepdims=True)
                e = np.exp(logits)
                rows = np.arange(len(at))
                losses[p] += float((np.log(e.sum(axis=1)) - logits[rows, label[at]]).sum())
                e /= e.sum(axis=1, keepdims=True)
                e[rows, label[at]] -= 1.0
                sums[p] += e.T @ z
        for p, g in sums.items():
            yield pa.RecordBatch.from_pylist(
                [{"p": int(p), "y": i, "loss": losses[p] if i == 0 else 0.0, "g": row.tolist()} for i, row in enumerate(g)], schema=schema)

    wanted = cells.where(F.col("p").isin(sorted(points)))
    parts = wanted.mapInArrow(add, "p int, y int, loss double, g array<double>")
    total = parts.groupBy("p", "y").agg(F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("g")).alias("g"))
    out = {p: (0.0, np.zeros_like(w)) for p, (_, _, w) in points.items()}
    for r in total.collect():
        out[r.p][1][r.y] = r.g.toArray()
        out[r.p] = out[r.p][0] + r.loss, out[r.p][1]
    shared.destroy()
    return out


def train_together(df: DataFrame, part: str, features: str, label: str, max_steps: int = MAX_STEPS,
                   tolerance: float = TOLERANCE) -> dict[str, TissueModel]:
    """A standardised multinomial logistic regression per tissue, as `embed.train_by`, all tissues in one job a step.

    Each job adds up losses and gradients of all tissues that are not done
    yet; the driver holds one weight matrix and a few moves per tissue and
    takes a quasi-Newton step for each. The number of jobs is that of the
    slowest tissue, whatever the number of tissues.

    Rows without a tissue, label or vector, of another width than most vectors
    or with components that are not finite are left out. A tissue with one
    label always gets it. No usable rows: no models.
    """
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(part).cast("string").alias("part"), F.col(label).cast("string").alias("label"),
                     F.col(features).cast("array<double>").alias("v"))
    rows = materialize(rows.where(F.col("part").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & usable), "cells")
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return {}
    rows = rows.where(F.size("v") == widths.width)
    known: dict[str, list[str]] = {}
    for r in rows.select("part", "label").distinct().orderBy("part", "label").collect():
        known.setdefault(r.part, []).append(r.label)
    if sum(map(len, known.values())) * widths.width * 8 > MAX_WEIGHT_BYTES:
        raise ValueError("too many labels for models of this size; train fewer tissues at once")
    names = list(known)
    codes = df.sparkSession.createDataFrame(
        [(t, l, p, y) for p, t in enumerate(names) for y, l in enumerate(known[t])], "part string, label string, p int, y int")
    cells = materialize(rows.join(codes, ["part", "label"]).select("p", "y", "v"), "cells")

    moments = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("v")).alias("m")
    scales, sizes = {}, {}
    for r in cells.groupBy("p").agg(moments).collect():
        n = r.m["count"]
        scale = np.sqrt(r.m["variance"].toArray() * (n - 1) / n)
        scales[r.p], sizes[r.p] = (r.m["mean"].toArray(), np.where(scale > 0, scale, 1.0)), n

    shapes = {p: (len(known[t]), widths.width + 1) for p, t in enumerate(names)}
    done = {p: np.zeros(shapes[p]) for p in scales if shapes[p][0] == 1}
    running = {p: _descent(np.zeros(shapes[p]).ravel(), tolerance * sizes[p], max_steps) for p in scales if p not in done}
    points = {p: next(fit) for p, fit in running.items()}
    while running:
        found = _slopes(cells, {p: (*scales[p], points[p].reshape(shapes[p])) for p in running})
        for p, (loss, gradient) in found.items():
            penalty = points[p].reshape(shapes[p]).copy()
            penalty[:, -1] = 0.0
            try:
                points[p] = running[p].send((loss + 0.5 * float((penalty**2).sum()), (gradient + penalty).ravel()))
            except StopIteration as end:
                done[p] = end.value.reshape(shapes[p])
                del running[p]
    models = {}
    for p, t in enumerate(names):
        bias = done[p][:, -1] - done[p][:, -1].mean()
        models[t] = TissueModel(*scales[p], done[p][:, :-1], bias, tuple(known[t]))
    return models


def write_models(spark: SparkSession, models: Mapping[str, TissueModel], path: str) -> None:
    """Models as Parquet, one row per (tissue, label). The path must be new."""
    rows = [(t, i, l, m.mean.tolist(), m.scale.tolist(), m.weights[i].tolist(), float(m.bias[i]))
            for t, m in models.items() for i, l in enumerate(m.labels)]
    spark.createDataFrame(rows, MODEL_SCHEMA).write.parquet(path)


def read_models(spark: SparkSession, path: str, parts: list[str] | None = None) -> dict[str, TissueModel]:
    """The models at `path`, of the given tissues or all."""
    rows = spark.read.schema(MODEL_SCHEMA).parquet(path)
    if parts is not None:
        rows = rows.where(F.col("part").isin(parts))
    found: dict[str, list] = {}
    for r in rows.orderBy("part", "place").collect():
        found.setdefault(r.part, []).append(r)
    return {t: TissueModel(np.array(of[0]["mean"]), np.array(of[0].scale), np.array([r.weights for r in of]),
                           np.array([r.bias for r in of]), tuple(r.label for r in of)) for t, of in found.items()}
