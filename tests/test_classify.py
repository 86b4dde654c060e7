"""Classifiers of all tissues trained side by side, against single fits and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import embed as E
from tallyfold.operators.classify import read_models, train_together, write_models
from tallyfold.session import scratch_path


def _cells(spark, tissues, seed=1, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for t, kinds in tissues.items():
        centres = rng.normal(0, 1, (kinds, 6))
        for i in range(n):
            k = i % kinds
            rows.append((t, f"{t} {k}", (centres[k] + rng.normal(0, 1, 6)).tolist() + [3.0]))
    return spark.createDataFrame(rows, "tissue string, kind string, v array<double>"), rows


def _objective(model, rows, tissue):
    """Summed loss and penalty, and the largest component of its gradient, by numpy."""
    x = np.array([v for t, _, v in rows if t == tissue])
    y = np.array([model.labels.index(k) for t, k, _ in rows if t == tissue])
    z = (x - model.mean) / model.scale
    logits = z @ model.weights.T + model.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[np.arange(len(y)), y]).sum() + 0.5 * (model.weights**2).sum()
    p[np.arange(len(y)), y] -= 1
    return loss, max(np.abs(p.T @ z + model.weights).max(), np.abs(p.sum(0)).max()) / len(y)


def test_same_fits_as_one_at_a_time(spark):
    df, rows = _cells(spark, {"lung": 2, "skin": 3, "eye": 5})
    both = train_together(df, "tissue", "v", "kind"), E.train_by(df, "tissue", "v", "kind", max_iter=200)
    assert sorted(both[0]) == sorted(both[1]) == ["eye", "lung", "skin"]
    for t in both[0]:
        (loss, slope), (single, _) = (_objective(models[t], rows, t) for models in both)
        assert loss <= single * (1 + 1e-5) and slope < 2e-5
        x = np.array([v for u, _, v in rows if u == t])
        assert np.allclose(both[0][t].mean, x.mean(0)) and np.allclose(both[0][t].scale[:6], x[:, :6].std(0))
        assert (both[0][t].predict(x) == both[1][t].predict(x)).mean() > 0.99


def test_jobs_do_not_grow_with_the_tissues(spark):
    one, _ = _cells(spark, {"a": 3})
    many = one.select(F.explode(F.array([F.lit(f"t{i:02}") for i in range(12)])).alias("tissue"), "kind", "v")
    jobs = []
    for name, df in (("one", one), ("many", many)):
        spark.sparkContext.setJobGroup(name, name)
        models = train_together(df, "tissue", "v", "kind")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(models) == 12 and jobs[1] <= jobs[0] * 1.3 + 5
    assert all(np.allclose(m.weights, models["t00"].weights, atol=1e-4) for m in models.values())


def test_odd_rows_do_not_count(spark):
    df, rows = _cells(spark, {"lung": 2})
    odd = spark.createDataFrame([
        (None, "lung 0", [0.0] * 7), ("lung", None, [0.0] * 7), ("lung", "lung 0", None), ("lung", "lung 0", [1.0]), ("lung", "lung 0", []),
        ("lung", "lung 0", [float("nan")] * 7), ("lung", "lung 0", [float("inf")] * 7), ("lung", "lung 0", [None] * 7),
        ("one", "only", [1.0] * 7)], df.schema)
    clean, mixed = train_together(df, "tissue", "v", "kind"), train_together(df.unionByName(odd).withColumns({"p": F.lit(1), "label": F.lit("x")}), "tissue", "v", "kind")
    assert sorted(mixed) == ["lung", "one"] and mixed["lung"].labels == clean["lung"].labels
    assert np.allclose(mixed["lung"].weights, clean["lung"].weights, atol=1e-4)
    assert mixed["one"].predict(np.zeros((2, 7))).tolist() == ["only", "only"]
    assert train_together(df.limit(0), "tissue", "v", "kind") == {}


def test_models_survive_storage(spark):
    df, _ = _cells(spark, {"lung": 2, "skin": 3})
    models, path = train_together(df, "tissue", "v", "kind"), scratch_path(spark, "models")
    write_models(spark, models, path)
    again = read_models(spark, path)
    for t, m in models.items():
        assert again[t].labels == m.labels
        assert all(np.array_equal(getattr(again[t], n), getattr(m, n)) for n in ("mean", "scale", "weights", "bias"))
    assert list(read_models(spark, path, ["skin"])) == ["skin"]
    out = E.annotate(df, "tissue", "v", again)
    assert out.where("cell_type = kind").count() / out.count() > 0.6


def test_given_embeddings(spark, sf):
    """The labels there are noisy; what counts is that fits together are as good as fits one at a time."""
    from tallyfold.queries import QUERIES
    from tallyfold.queries.cells import _embedded

    rows = QUERIES["l4_annotate_trained"](spark, sf).collect()
    cells = _embedded(spark, sf)
    single = E.annotate(cells, "tissue", "embedding", E.train_by(cells, "tissue", "embedding", "cell_type", max_iter=200), name="predicted")
    right = {r.vec_id: r.predicted for r in single.collect()}
    assert len(rows) == len(right) == cells.count()
    assert np.mean([right[r.vec_id] == r.predicted for r in rows]) > 0.99
    assert abs(sum(r.cell_type == r.predicted for r in rows) - sum(r.cell_type == right[r.vec_id] for r in rows)) <= 2
