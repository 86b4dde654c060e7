"""Clustering by centroids over whole vectors, in column expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path, write_measured, materialize
from .common import whole_parts

#: Rows that are looked at for each first centroid, about; the smallest hashes are always among them.
LOOKED_AT = 64


def _array(values: list[int]) -> str:
    return f"array({','.join(f'{v}L' for v in values)})"


def _first_centroids(kept: DataFrame, rows: int, k: int, seed: str) -> list[list[int]]:
    """The vectors with the k smallest hashes of `seed:id`; ties by vector, rows without an id last.

    Only hashes below a cut take part in the ordering, so that few rows reach
    the driver however many tasks there are; the cut rises until k rows lie below.
    """
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256).alias("hash"), "vector")
    share, wanted, found = LOOKED_AT * k / max(1, rows), min(k, rows), []
    while len(found) < wanted:
        near = hashed.where(F.col("hash") < f"{int(share * 2 ** 32):08x}") if share < 1 else hashed
        found = near.orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
        share *= LOOKED_AT
    return [list(r.vector) for r in found]


def _nearest(centroids: list[list[int]]) -> Column:
    """`(distance, cluster)` of the nearest centroid: squared distances to literal arrays, ties to the smaller number."""
    return F.expr("array_min(array(" + ",".join(
        f"named_struct('distance', aggregate(zip_with(vector, {_array(c)}, (x, y) -> (x - y) * (x - y)), 0L, (s, x) -> s + x), 'cluster', {i})"
        for i, c in enumerate(centroids)) + "))")


def _moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: the floors of the mean components of their vectors; those without vectors stay.

    Sums are kept per cluster and component, and tasks add up what they read, so
    k rows leave each task and k rows reach the driver.
    """
    width = len(centroids[0])
    assigned = kept.select("vector", _nearest(centroids).alias("best")).groupBy("best.cluster")
    sums = assigned.agg(F.count("*").alias("n"), *[F.expr(f"sum(vector[{i}])").alias(f"s{i}") for i in range(width)])
    after = list(centroids)
    for row in sums.collect():
        after[row.cluster] = [row[f"s{i}"] // row.n for i in range(width)]
    return after


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 16,
            rounds: int = 3, scale: float = 64.0, seed: str = "1") -> DataFrame:
    """`(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)` of every vector of `width` components.

    Components become `floor(scale * x)`, so all sums and distances are exact
    and do not depend on the order of rows. The first centroids are the vectors
    with the smallest hashes of `seed:id`; each round puts every vector to the
    nearest centroid and moves the centroids to the floor of the mean; a last
    pass assigns the vectors to the final ones. `distance` is squared;
    `cluster_inertia` and `inertia` are its sums over the cluster and over all;
    the hash is that of the final centroid's components joined by commas.

    Vectors that are null, of another width or hold null or non-finite
    components are left out. Repeated rows count each; a row without an id is
    clustered like any other but becomes a first centroid only where there are
    fewer others than k. Fewer vectors than k make fewer clusters; an empty
    table gives no rows. Numbers beyond a long raise an arithmetic error.
    Other columns are not read.
    """
    spark = df.sparkSession
    usable, vector = whole_parts(vector_col, scale)
    path = scratch_path(spark, "whole")
    whole = df.where(usable & (F.size(vector_col) == width)).select(F.col(id_col).alias("_id"), vector.alias("vector"))
    rows = write_measured(whole, path, n=F.count("*"))["n"]
    kept = spark.read.schema(whole.schema).parquet(path)
    # without vectors the one centroid is never met
    centroids = _first_centroids(kept, rows, k, seed) or [[0] * width]
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    found = materialize(kept.select("_id", _nearest(centroids).alias("best")).select("_id", "best.*"), "clusters")
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = F.expr(f"{_array([sums.get(i, 0) for i in range(len(centroids))])}[cluster]")
    return found.select(
        F.col("_id").alias(id_col), "cluster", "distance", of_cluster.alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.expr("array(" + ",".join(f"'{h}'" for h in hashes) + ")[cluster]").alias("centroid_sha256"))


def cluster_sql(rounds: int = 3, k: int = 16, width: int = 64) -> str:
    """The clustering of the table `embeddings` in SQL."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {width} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept
  ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(kept.v) AS v,
         min({{'d': CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c}}) AS best
  FROM kept, c{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {width + 1}) t(i) GROUP BY 1, 2) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c"""
