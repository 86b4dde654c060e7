"""Top products against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tallyfold.llm.queries import QUERIES
from tallyfold.llm.topk import Block, products, top_products


def plain(vectors, queries, k=10):
    found = {}
    for q in queries:
        own = [(-sum(a * b for a, b in zip(v, vectors[q])), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        found[q] = [(i, -s) for s, i in sorted(own)[:k]]
    return found


def grouped(rows, name="vec_id"):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r[name], r.score))
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("block,piece,head", [(8192, 2048, 4096), (16, 3, 32), (7, 1, 5)])
def test_lengths_of_all_kinds(spark, block, piece, head):
    rng = np.random.default_rng(5)
    vectors = {i: np.floor(rng.normal(size=6) * rng.choice([0.01, 1, 30, 1000]) * 10).astype(int).tolist() for i in range(400)}
    vectors |= {400 + i: vectors[i] for i in range(30)} | {500: [0] * 6}
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, norm int")
    rows = top_products(df, F.col("id") % 20 == 0, scale=1.0, block=block, query_block=piece, head=head).collect()
    assert grouped(rows) == plain(vectors, [i for i in vectors if i % 20 == 0])


def test_survivors_hold_all_that_reach(spark):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-1000, 1000, (300, 8))
    block = Block(np.arange(300), vectors, np.sqrt((vectors ** 2).sum(axis=1).astype(float)))
    pruned = 0
    for q in rng.integers(-1000, 1000, (40, 8)):
        norm, scores = float(np.sqrt((q ** 2).sum())), block.vectors @ q
        for threshold in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            rows = block.survivors(q, norm, float(threshold))
            assert set(np.flatnonzero(scores >= threshold)) <= set(rows.tolist())
            pruned += 300 - len(rows)
    assert pruned > 0


def test_exact_beyond_floating_point():
    a, b = np.array([[2 ** 40 + 1, 3]]), np.array([2 ** 22 + 1, 1])
    assert products(a, b).tolist() == [(2 ** 40 + 1) * (2 ** 22 + 1) + 3]


def test_rows_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [3.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (None, [9.0, 9.0]), (5, [1.0]), (6, [-1.0, -0.5]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, unit, twice = top_products(df, F.col("id") % 100 == 0).collect(), 1024 * 1024, {0: []}
    got = grouped([r for r in found if r.query_id == 100])
    twice[0] = [(r.vec_id, r.score) for r in found if r.query_id == 0]
    assert got[100] == [(0, 5 * unit), (0, 5 * unit), (6, -3.5 * unit)]
    assert sorted(twice[0]) == [(0, 5 * unit)] * 2 + [(6, -2 * unit)] * 2 + [(100, 5 * unit)] * 2
    assert top_products(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 40)) * 5, [float(x) for x in rng.integers(-9, 9, 4)]) for _ in range(300)]
    rows += [(100, [1.0, 1.0, 0.0, 0.0]), (200, [-1.0, -1.0, 0.0, 0.0]), (1, [2.0, 2.0, 0.0, 0.0]), (1, [-9.0, -9.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), j) for n, (j, w) in enumerate(rows) if n != i)
            want += [(q, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:10])]
    for block, piece, head in ((8192, 2048, 4096), (16, 3, 50)):
        got = top_products(df, F.col("id") % 100 == 0, scale=1.0, block=block, query_block=piece, head=head).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_a_bucket_out_of_reach_is_not_copied(spark, monkeypatch):
    rows = [(i, [1000.0 + i, 0.0]) for i in range(100, 150)] + [(i, [0.001, 0.001]) for i in range(201, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    copied = []
    whole = PandasCogroupedOps.applyInPandas

    def seen(self, func, schema):
        copied.append(self._gd1._df.count())
        return whole(self, func, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", seen)
    top_products(df, F.col("id") == 100, block=20, query_block=1).collect()
    assert copied == [50]


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r.vec_id: [int(np.floor(1024 * float(x))) for x in r.embedding] for r in rows}
    assert grouped(QUERIES["op10_top_products"](spark, sf).collect()) == plain(vectors, [i for i in vectors if i % 100 == 0])
