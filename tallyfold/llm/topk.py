"""Exact search for the largest inner products, in blocks of vectors of like length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import whole_parts

#: Rows of a block of candidates and of a block of queries; a task holds one of each.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Long vectors, about, which give each query its first threshold.
HEAD = 4096
#: Vectors whose lengths differ by less than this factor share a bucket.
SPREAD = 1.25
#: From this cosine on, a bucket is pruned by coordinates, else by length.
COORDINATES_FROM = 0.3
#: Coordinates of a query, its largest, of which the most selective one is used.
FOCUS = 4
_SLACK = 1e-9


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 1024.0) -> DataFrame:
    """`(row, id, vector, norm)` with components `floor(scale * x)` and a number for each row; write it out before it is used twice.

    Rows with a null id or vector, or with a null or non-finite component, take
    no part. Rows that share an id are rows of their own.
    """
    usable, vector = whole_parts(vector_col, scale)
    whole = df.where(F.col(id_col).isNotNull() & usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), vector.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return whole.select("row", "id", "vector", F.sqrt(square).alias("norm"))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: in floating point where all sums stay below 2^53, else with Python integers."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if rows.shape[1] * float(np.abs(rows).max()) * max(1.0, float(np.abs(query).max())) < 2.0 ** 53:
        return np.rint(rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -2 ** 63), 2 ** 63 - 1) for x in exact], np.int64)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), -1)


class Block:
    """Candidates of one block, sorted by falling length, with their directions sorted by each coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, numbers: np.ndarray | None = None):
        numbers = ids if numbers is None else numbers
        order = np.lexsort((numbers, ids, -norms))
        self.ids, self.numbers, self.vectors, self.norms = ids[order], numbers[order], vectors[order], norms[order]
        self.longest = float(self.norms[0])
        self.orders: np.ndarray | None = None

    def _sort_coordinates(self) -> None:
        with np.errstate(invalid="ignore", divide="ignore"):
            directions = np.where(self.norms[:, None] > 0, self.vectors / self.norms[:, None], 0.0)
        self.orders = np.argsort(directions, axis=0, kind="stable")
        self.sorted = np.take_along_axis(directions, self.orders, axis=0)

    def survivors(self, query: np.ndarray, norm: float, threshold: float) -> np.ndarray:
        """Rows that can reach the threshold, and some that cannot.

        The local cosine threshold is what a row of the greatest length needs.
        If it is high, the direction of a row must lie close to that of the
        query, which bounds each of its coordinates; the query's largest
        coordinates are tried and the narrowest range is taken. Otherwise only
        the length counts: rows are sorted by it, so a prefix survives.
        """
        if threshold <= 0 or norm == 0 or self.longest == 0:
            return np.arange(len(self.ids))
        cosine = threshold / (norm * self.longest) - _SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        long_enough = int(np.searchsorted(-self.norms, -(threshold / norm) * (1 - _SLACK), side="right"))
        if cosine < COORDINATES_FROM:
            return np.arange(long_enough)
        if self.orders is None:
            self._sort_coordinates()
        direction, best = query / norm, None
        for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
            reach = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - min(1.0, direction[f] ** 2)))) + _SLACK
            middle = cosine * direction[f]
            low = -1.0 if direction[f] < -cosine else middle - reach
            high = 1.0 if direction[f] > cosine else middle + reach
            a, b = np.searchsorted(self.sorted[:, f], low - _SLACK), np.searchsorted(self.sorted[:, f], high + _SLACK, side="right")
            if best is None or b - a < best[0]:
                best = b - a, f, a, b
        _, f, a, b = best
        rows = self.orders[a:b, f]
        return rows[rows < long_enough] if long_enough < len(self.ids) else rows

    def top(self, number: int, query: np.ndarray, norm: float, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, numbers and products of the best rows other than row `number` that reach the threshold; ties to smaller ids."""
        rows = self.survivors(query, norm, threshold)
        rows = rows[self.numbers[rows] != number]
        scores = products(self.vectors[rows], query)
        if threshold > -math.inf:
            reached = scores >= threshold
            rows, scores = rows[reached], scores[reached]
        best = np.lexsort((self.numbers[rows], self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], self.numbers[rows[best]], scores[best]


def top_products(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
                 scale: float = 1024.0, block: int = BLOCK, query_block: int = QUERY_BLOCK, head: int = HEAD) -> DataFrame:
    """`(query_id, rank, id, score)`: for each query row the k largest inner products with all other rows; ties to smaller ids.

    Vectors are put into buckets of like length and each bucket is cut into
    blocks. The products with some `head` of the longest vectors give each query
    a first threshold, the k-th of them. A query meets a bucket only if the
    longest vector there could reach its threshold, and a block only in pieces of
    `query_block` queries, so a task holds one block of each; a block is copied
    only to the pieces that ask for its bucket. Within the block coordinates or
    lengths prune by the local cosine threshold, and the rest is multiplied out.
    Only products at the threshold or above, k per query and block at most, go
    to the last ranking.

    Rows are told apart by a number, so rows that share an id are candidates and
    queries of their own; among equal products and ids the order is arbitrary.
    Only vectors of as many components are compared. See `whole_vectors` for
    the rows that take part. `is_query` is a condition on the column `id`. Other
    columns are not read; an empty table gives no rows.
    """
    rows = materialize(whole_vectors(df, id_col, vector_col, scale).select(
        "*", F.size("vector").alias("width"),
        F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(SPREAD))).otherwise(F.lit(-1)).cast("int").alias("bucket")), "vectors")
    # one row per width and power of SPREAD: a few hundred for any table
    buckets = rows.groupBy("width", "bucket").agg(F.max("norm").alias("longest"), F.count("*").alias("n")).select(
        "width", "bucket", "longest", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    buckets = materialize(buckets, "buckets")
    pieces = max(1, math.ceil(rows.where(is_query).count() / query_block))
    queries = _with_thresholds(rows.where(is_query), _longest(rows, buckets, head, k), k)
    queries = materialize(queries.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int")), "queries")

    can_reach = (F.col("threshold") <= 0) | (F.col("norm") * F.col("longest") * (1 + _SLACK) >= F.col("threshold"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    reached = queries.join(buckets, "width").where(can_reach)
    sent = reached.select("width", "bucket", all_blocks, "piece", "row", "id", "vector", "norm", "threshold")
    asked = reached.select("width", "bucket", "blocks", "piece").distinct().select("width", "bucket", all_blocks, F.col("piece").alias("piece"))
    held = rows.join(buckets.select("width", "bucket", "blocks"), ["width", "bucket"]).select(
        "width", "bucket", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "id", "vector", "norm")
    held = held.join(asked, ["width", "bucket", "block"])

    def meet(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(asking):
            held = Block(candidates["id"].to_numpy(np.int64), _matrix(candidates["vector"]), candidates["norm"].to_numpy(float),
                         candidates["row"].to_numpy(np.int64))
            for number, q, vector, norm, threshold in asking[["row", "id", "vector", "norm", "threshold"]].itertuples(index=False):
                ids, numbers, scores = held.top(number, np.asarray(vector, np.int64), norm, threshold, k)
                found.append(pd.DataFrame({"query": np.full(len(ids), number, np.int64), "query_id": np.full(len(ids), q, np.int64),
                                           "id": ids, "number": numbers, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("query", "query_id", "id", "number", "score")}).astype("int64")

    keys = ["width", "bucket", "block", "piece"]
    near = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(meet, "query long, query_id long, id long, number long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "number")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")


def _longest(rows: DataFrame, buckets: DataFrame, head: int, k: int) -> DataFrame:
    """About `head` of the longest vectors: by a hash, so many rows of the buckets of greatest length of each width.

    The products with any rows are a threshold that cannot be too high, so only
    their number matters, and it does not grow with the number of tasks.
    """
    cuts, by_width = [], {}
    for r in buckets.orderBy("width", F.desc("bucket")).collect():
        by_width.setdefault(r.width, []).append((r.bucket, r.n))
    wanted = max(4 * k, head // max(1, len(by_width)))
    for width, found in by_width.items():
        least, n = found[0][0], 0
        for bucket, size in found:
            if n >= wanted:
                break
            least, n = bucket, n + size
        cuts.append((width, least, int(min(1.0, wanted / n) * 2 ** 20) + 1))
    cuts = rows.sparkSession.createDataFrame(cuts, "width int, _least int, _share int")
    return rows.join(cuts, "width").where((F.col("bucket") >= F.col("_least")) & (F.pmod(F.xxhash64("row", F.lit(1)), F.lit(2 ** 20)) < F.col("_share")))


def _with_thresholds(queries: DataFrame, longest: DataFrame, k: int) -> DataFrame:
    """Queries with their k-th largest product among the longest vectors; minus infinity where there are fewer than k."""
    longest = longest.select("row", "vector").toArrow()
    longest = list(zip(longest["row"].to_pylist(), (np.array(v, np.int64) for v in longest["vector"].to_pylist())))
    shared = queries.sparkSession.sparkContext.broadcast(longest)

    def run(source):
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {len(v) for _, v in shared.value}:
            same = [(i, v) for i, v in shared.value if len(v) == width]
            by_width[width] = np.array([i for i, _ in same], np.int64), _matrix([v for _, v in same])
        for frame in source:
            thresholds = []
            for q, vector in frame[["row", "vector"]].itertuples(index=False):
                ids, rows = by_width.get(len(vector), (np.zeros(0, np.int64), np.zeros((0, len(vector)), np.int64)))
                scores = products(rows, np.asarray(vector, np.int64))[ids != q]
                enough = len(scores) >= k
                # a little less than the product, which need not be a floating-point number
                thresholds.append(math.nextafter(float(np.partition(scores, -k)[-k]), -math.inf) if enough else -math.inf)
            yield frame.assign(threshold=thresholds)

    schema = "row long, id long, vector array<long>, norm double, width int, threshold double"
    return queries.select("row", "id", "vector", "norm", "width").mapInPandas(run, schema)
