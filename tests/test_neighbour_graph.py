"""The refined neighbour graph against brute force, its work per row, and odd rows."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import neighbour_graph as G

from test_cells import exact, vectors


def _recall(got, ids, x, k):
    near = exact(x, k)[0]
    true = {(ids[i], ids[j]) for i in range(len(ids)) for j in near[i]}
    return len(true & set(zip(got.id, got.neighbour))) / len(true)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall_on_given_embeddings(spark, table):
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    rows = spark.read.parquet(path)
    got = G.neighbour_graph(rows, "vec_id", "embedding", 5).toPandas()
    pdf = rows.select("vec_id", "embedding").toPandas()
    assert len(got) == 5 * len(pdf) and sorted(got["rank"].unique()) == [1, 2, 3, 4, 5]
    found = _recall(got, pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float), 5)
    print("recall", table, found)
    assert found >= 0.95


def _clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.5, (n, 12)) + rng.normal(0, 2, (n // 50, 12))[rng.integers(0, n // 50, n)]


def test_work_per_row_is_flat(spark, monkeypatch):
    """Pairs compared per row and turn, and recall, at n and 4n rows."""
    work, compared = [], G._compared

    def counted(groups, best):
        work.append(groups.agg(F.sum(F.size("members") * (F.size("members") - 1))).first()[0])
        return compared(groups, best)

    monkeypatch.setattr(G, "_compared", counted)
    per_row = []
    for n in (1500, 6000):
        work.clear()
        x = _clustered(n)
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": x.tolist()}))
        got = G.neighbour_graph(df, "id", "v", 5).toPandas()
        assert _recall(got, np.arange(n), x, 5) >= 0.95
        per_row.append((work[0] / n, max(work[1:]) / n))
    print("pairs per row", per_row)
    assert all(large <= small * 1.2 for small, large in zip(*per_row))


def test_distances_and_order(spark):
    pdf, df = vectors(spark, 200)
    got = G.neighbour_graph(df, "id", "v", 4).toPandas().sort_values(["id", "rank"])
    near, far = exact(np.stack(pdf.v), 4)
    assert (got.neighbour.to_numpy().reshape(200, 4) == near).mean() > 0.99
    assert np.allclose(got.distance.to_numpy().reshape(200, 4), far, atol=1e-3) and (got.id != got.neighbour).all()


def test_copies_hubs_and_odd_rows(spark):
    """A third of the rows are copies of one vector, to which the others are near; ids repeat or lack."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.0] * 5) for i in range(300)] + [(i, rng.normal(size=5).tolist()) for i in range(300, 900)]
    odd = [(None, [0.0] * 5), (1000, None), (1001, []), (1002, [1.0]), (1003, [float("nan")] * 5), (1004, [None] * 5), (1005, [float("inf")] * 5), (5, [0.0] * 5)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").withColumns({"row": F.lit("x"), "other": F.lit(1), "rank": F.lit(0)})
    got = G.neighbour_graph(df, "id", "v", 3, leaf=40).toPandas()
    sizes = got.groupby("id").size()
    assert set(sizes.index) == set(range(900)) and (sizes.drop(5) == 3).all() and sizes[5] == 6
    assert (got[got.id < 300].distance == 0).all()


def test_tiny_and_empty(spark):
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id int, v array<float>")
    assert sorted(tuple(r) for r in G.neighbour_graph(few, "id", "v", 5).collect()) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert G.neighbour_graph(few.limit(1), "id", "v", 5).count() == 0
    none = G.neighbour_graph(few.limit(0), "id", "v", 5)
    assert none.count() == 0 and none.columns == ["id", "neighbour", "distance", "rank"]


def test_single_precision_travels_as_it_is(spark, monkeypatch):
    """Vectors of single precision take half the room in groups, and give the graph of the same values in double precision."""
    seen, compared = [], G._compared
    monkeypatch.setattr(G, "_compared", lambda groups, best: seen.append(groups.dtypes[0][1]) or compared(groups, best))
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "id long, v array<float>").coalesce(1)
    single, double = ({(r.id, r.neighbour, r.distance, r["rank"]) for r in G.neighbour_graph(d, "id", "v", 3, turns=2).collect()}
                      for d in (df, df.withColumn("v", F.col("v").cast("array<double>"))))
    assert single == double and len(single) == 900
    assert {t for t in seen if "float" in t} and {t for t in seen if "double" in t}
