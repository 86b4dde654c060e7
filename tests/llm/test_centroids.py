"""Centroid clusters against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm.centroids import cluster
from tallyfold.llm.queries import ORACLES, QUERIES


def plain(rows, width, k=16, rounds=3, scale=64.0):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashes = [("g" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept]
    centroids = [list(v) for _, v in sorted(hashes)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = {j: sum(d for _, c, d in found if c == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, of[c], sum(of.values()), sha[c]) for i, c, d in found)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_query(spark, sf, db):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = got(QUERIES["op12_centroid_clusters"](spark, sf))
    assert found == plain(rows, 64)
    assert found == sorted((str(r[0]), *r[1:]) for r in db.execute(ORACLES["op12_centroid_clusters"]).fetchall())


@pytest.mark.parametrize("k", [1, 4, 40])
def test_clusters_of_all_sizes(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 4 - 2 * (i % 3)]) for i in range(120)] + [(500 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(cluster(df, width=3, k=k)) == plain(exact, 3, k)


def test_rows_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [-3.0, 1.0]), (None, [5.0, 5.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]),
            (5, [1.0, -inf]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit(9)).withColumn("vector", F.lit(1))
    assert got(cluster(df, width=2, k=3)) == plain(rows, 2, 3)
    assert len(got(cluster(df, width=2, k=3))) == 4
    empty = cluster(df.limit(0), width=2)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


def test_hot_ids_start_clusters_only_by_hash(spark):
    rows = [(7, [float(i % 5), 1.0]) for i in range(300)] + [(i, [float(i), 0.0]) for i in range(100, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(cluster(df, width=2)) == plain(rows, 2)


def test_only_column_expressions(spark, sf):
    plan = QUERIES["op12_centroid_clusters"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
