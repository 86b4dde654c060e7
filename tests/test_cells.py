"""Cells, genes and embeddings against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cells as C, embed as E
from tallyfold.session import materialize


def planted(n=60, genes=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.poisson(1.5, (n, genes)).astype(float)
    group = np.array(["u", "v", "w"])[np.arange(n) % 3]
    x[group == "u", 0] += 9
    x[group == "v", 1] += 9
    x[:, 11] += 1
    return x, group


def long_counts(spark, x):
    cell, gene = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({"cell_id": cell, "gene_id": gene, "count": x[cell, gene]}))


def test_ranked_genes_match_a_dense_computation(spark):
    x, group = planted()
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(len(group)), "kind": group}))
    got = C.rank_genes(long_counts(spark, x), cells, "kind").toPandas().set_index(["group", "gene"])
    total = x.sum(1)
    v = np.log1p(x * np.median(total) / total[:, None])
    for g in "uvw":
        a, b = v[group == g], v[group != g]
        t = (a.mean(0) - b.mean(0)) / np.sqrt(a.var(0, ddof=1) / len(a) + b.var(0, ddof=1) / len(b))
        lfc = np.log2((np.expm1(a.mean(0)) + 1e-9) / (np.expm1(b.mean(0)) + 1e-9))
        assert np.allclose(got.loc[g].sort_index().score, t) and np.allclose(got.loc[g].sort_index().log_fold_change, lfc)
    top = C.rank_genes(long_counts(spark, x), cells, "kind", top_n=1).toPandas().set_index("group").gene
    assert top["u"] == 0 and top["v"] == 1


def test_constant_gene_has_no_score_and_single_cells_are_dropped(spark):
    counts = spark.createDataFrame([(i, g, 2.0) for i in range(5) for g in (0, 1)], "cell_id int, gene_id int, count double")
    cells = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c")], "cell_id int, kind string")
    out = C.rank_genes(counts, cells, "kind").toPandas()
    assert set(out.group) == {"a", "b"} and out.score.isna().all()


def test_normalisation_reaches_the_median(spark):
    x, _ = planted()
    sums = C.normalize_counts(long_counts(spark, x)).groupBy("cell_id").agg(F.sum("value").alias("s")).toPandas().s
    assert np.allclose(sums, np.median(x.sum(1)))


def test_gate(spark, rows):
    cells = spark.createDataFrame([("s", "d1", 301, 501)] * 2 + [("s", "d1", 300, 999), ("s", "d2", 999, 501)],
                                  "species string, dataset string, gene_count int, umi_count int")
    assert rows(C.dataset_gate(cells, ["species", "dataset"], min_cells=2)) == [("s", "d1", 2, True), ("s", "d2", 1, False)]
    assert C.gated_cells(cells, ["species", "dataset"], min_cells=2).count() == 2
    assert tuple(C.retained_fractions(cells, ["species", "dataset"], min_cells=2).first()) == (2, 1, 2, 0.5, 0.5)


def test_alignment_and_coverage(spark):
    a = spark.createDataFrame([("d_1",), ("d_2",), ("d_3",)], "cell_id string")
    b = spark.createDataFrame([("d_1", "x"), ("d_2", "y")], "cell_id string, t string")
    c = spark.createDataFrame([("d_2", 5)], "cell_id string, n int")
    aligned = C.align_cells(a, b, c)
    assert [tuple(r) for r in aligned.collect()] == [("d_2", "y", 5)]
    assert tuple(C.coverage(a, aligned).first()) == (3, 1, pytest.approx(1 / 3))


def test_combined_datasets_share_columns(spark):
    a = spark.createDataFrame([("d1", "c", 1, 2)], "dataset string, cell string, x int, y int")
    b = spark.createDataFrame([("d2", "c", 3, 4)], "dataset string, cell string, x int, z int")
    out = C.combine_datasets([a, b])
    assert out.columns == ["dataset", "cell", "x", "cell_id"] and out.select("cell_id").distinct().count() == 2


def vectors(spark, n=240, width=8, seed=4):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 4, n)
    x = rng.normal(0, 0.4, (n, width)) + np.eye(width)[label] * 4
    df = pd.DataFrame({"id": np.arange(n), "v": x.tolist(), "label": label, "tissue": np.where(label < 2, "lung", "skin")})
    return df, spark.createDataFrame(df)


def exact(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d.argsort(1, kind="stable")[:, :k], np.sort(d, 1)[:, :k]


@pytest.mark.parametrize("block", [2048, 16, 7])
def test_neighbours_of_a_small_table_are_exact(spark, block):
    pdf, df = vectors(spark, 90)
    near, far = exact(np.stack(pdf.v), 4)
    got = E.neighbours(df, "id", "v", 4, block=block).toPandas().sort_values(["id", "rank"])
    assert (got.neighbour.to_numpy().reshape(90, 4) == near).all() and np.allclose(got.distance.to_numpy().reshape(90, 4), far)


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_does_not_fall_with_the_table(spark, n):
    pdf, df = vectors(spark, n)
    got = E.neighbours(df, "id", "v", 5, cell_rows=50, probes=8, block=64).toPandas()
    true = {(i, j) for i, r in enumerate(exact(np.stack(pdf.v), 5)[0]) for j in r}
    assert len(got) == 5 * n and len(true & set(zip(got.id, got.neighbour))) / len(true) > 0.9


@pytest.mark.parametrize("cell_rows", [50, 25])
def test_recall_on_given_embeddings_in_many_cells(spark, sf, cell_rows):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    pdf = rows.toPandas().sort_values("vec_id", ignore_index=True)
    got = E.neighbours(rows, "vec_id", "embedding", 5, cell_rows=cell_rows, probes=2).toPandas()
    near = exact(np.stack(pdf.embedding).astype(float), 5)[0]
    true = {(pdf.vec_id[i], pdf.vec_id[j]) for i, r in enumerate(near) for j in r}
    found = len(true & set(zip(got.id, got.neighbour))) / len(true)
    print("recall", cell_rows, found)
    assert found >= 0.9


def test_neighbours_of_copies_and_nulls(spark):
    copies = spark.range(120).select("id", F.when(F.col("id") < 110, F.array(*[F.lit(1.0)] * 8)).alias("v"))
    same = E.neighbours(copies, "id", "v", 3, cell_rows=20, probes=1, block=16).toPandas()
    assert (same.distance == 0).all() and len(same) == 330


def test_training_and_annotation(spark):
    pdf, df = vectors(spark)
    named = df.withColumn("kind", F.concat(F.lit("k"), F.col("label").cast("string")))
    models = E.train_by(named.where("tissue = 'lung'"), "tissue", "v", "kind", max_iter=100)
    out = E.annotate(named, "tissue", "v", models)
    assert out.where("tissue = 'skin'").count() == 0 and out.count() == int((pdf.tissue == "lung").sum())
    assert out.where("kind = cell_type").count() / out.count() > 0.97
    lung = pdf[pdf.tissue == "lung"]
    assert np.allclose(models["lung"].scale, np.stack(lung.v).std(0))


def test_annotation_of_odd_vectors(spark):
    _, df = vectors(spark)
    named = df.withColumn("kind", F.concat(F.lit("k"), F.col("label").cast("string")))
    models = E.nearest_mean_models(named, "tissue", "v", "kind")
    odd = spark.createDataFrame([(1, "lung", None), (2, "lung", [1.0]), (3, "lung", [float("nan")] * 8), (4, "lung", [None] * 8),
                                 (5, "none", [0.0] * 8)], "id long, tissue string, v array<double>")
    assert sorted(tuple(r) for r in E.annotate(odd, "tissue", "v", models).select("id", "cell_type").collect()) == [(i, None) for i in (1, 2, 3, 4)]
    out = E.annotate(named, "tissue", "v", models)
    assert out.count() == 240 and out.where("kind = cell_type").count() > 230


def test_training_minimises_the_summed_penalty(spark):
    pdf, df = vectors(spark, 120)
    named = df.withColumn("kind", F.col("label").cast("string"))
    model = E.train_model(named, "v", "kind", max_iter=500)
    z = (np.stack(pdf.v) - model.mean) / model.scale
    y = np.array([model.labels.index(str(v)) for v in pdf.label])

    def loss(w, b):
        s = z @ w.T + b
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).sum() + 0.5 * (w**2).sum()

    best, rng = loss(model.weights, model.bias), np.random.default_rng(1)
    for _ in range(20):
        assert best <= loss(model.weights + rng.normal(0, 0.02, model.weights.shape), model.bias) + 1e-9


def test_single_label_model(spark):
    _, df = vectors(spark, 30)
    model = E.train_model(df.withColumn("kind", F.lit("only")), "v", "kind")
    assert set(model.predict(np.zeros((3, 8)))) == {"only"}


def test_width_and_positions(spark, rows):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<double>")
    assert rows(E.wrong_width(df, "v", 2), "id") == [(2,), (3,)]
    pts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 5.0, 6.0), (None, 9.0, 9.0)], "l string, x double, y double")
    assert rows(E.label_positions(pts, "l", "x", "y")) == [("a", 2.0, 3.0), ("b", 5.0, 6.0)]


def test_silhouette_of_separated_clusters(spark):
    _, df = vectors(spark)
    assert E.silhouette(df, "v", "label") > 0.8


def test_identifiers(spark):
    df = spark.createDataFrame([("TSP4_Lung12_S3_x_GeneFull_Ex50pAS", "ACGT")], "d string, b string")
    assert tuple(df.select(E.cell_identifier("d", "b"), E.tissue_from_name("d")).first()) == ("TSP4_Lung12_x_ACGT", "lung")


def test_nearest_in_a_block_against_plain_distances():
    rng = np.random.default_rng(3)
    for trial in range(40):
        n, m, k, width = rng.integers(1, 300), rng.integers(1, 60), int(rng.integers(1, 9)), int(rng.integers(1, 6))
        x = rng.integers(0, 3, (n, width)) * 10.0 ** rng.integers(-3, 4) + (1e6 if trial % 3 == 0 else 0)
        if trial % 4 == 1:
            x[rng.integers(0, n)] = np.nan
        if trial % 8 == 3:
            x[0] = 1e200
        ids = rng.permutation(n) if trial % 5 else rng.integers(0, n, n)
        asked = rng.integers(0, n, m)
        held, asking = (pd.DataFrame({"id": ids[at], "v": list(x[at])}) for at in (np.arange(n), asked))
        got = E._nearest_in_block(k, products=1000, gaps=50)(held, asking)
        want = []
        with np.errstate(over="ignore", invalid="ignore"):
            for a in asked:
                far = np.sqrt(((x[a] - x) ** 2).sum(1))
                rows = sorted((d, j) for d, j in zip(far, ids) if np.isfinite(d) and j != ids[a])
                want += [(ids[a], j, d) for d, j in rows[:k]]
        assert sorted((r.id, r.neighbour, round(r.distance, 9)) for r in got.itertuples()) == sorted((i, j, round(d, 9)) for i, j, d in want)


def test_rows_travel_once_to_a_region_where_cells_tell_little(spark, sf, monkeypatch):
    rows, kept = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"), {}

    def noted(df, label):
        kept[label] = materialize(df, label)
        return kept[label]

    monkeypatch.setattr(E, "materialize", noted)
    found = E.neighbours(rows, "vec_id", "embedding", 5, cell_rows=20, probes=2, block=50)
    n = rows.count()
    assert found.count() == 5 * n and kept["placed"].agg(F.sum(F.size("near"))).first()[0] <= n * n / 50
