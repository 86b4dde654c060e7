"""P-values against numeric integration, adjusted ones against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cells as C
from tallyfold.operators.significance import adjusted_p, t_p_value, two_sided


def _tail(t, df, n=400_000):
    """Two-sided tail by Simpson's rule, with t = tan(angle) * sqrt(df), which makes the range finite."""
    at = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, n + 1)
    y = np.cos(at) ** (df - 1)
    whole = np.cos(np.linspace(0, math.pi / 2, n + 1)) ** (df - 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((y * w).sum() * (at[1] - at[0]) / ((whole * w).sum() * (math.pi / 2 / n)))


@pytest.mark.parametrize("df", [1.0, 1.7, 5.0, 40.5, 900.0, 20_000.0, 3e6])
def test_p_values_by_integration(df):
    t = np.array([0.0, 1e-4, 0.3, 1.0, -1.7, 1.74, 2.5, 6.0])
    got = two_sided(t, np.full(len(t), df))
    want = [_tail(x, df) for x in t]
    assert got == pytest.approx(want, rel=2e-6, abs=1e-13)


def test_known_values():
    assert two_sided(np.array([1.0, 12.706204736]), np.array([1.0, 1.0])) == pytest.approx([0.5, 0.05], rel=1e-8)
    assert two_sided(np.array([1.959963985]), np.array([1e9])) == pytest.approx([0.05], rel=1e-6)
    assert 0 < two_sided(np.array([30.0]), np.array([100.0]))[0] < 1e-50


def test_missing_scores_have_p_one(spark):
    rows = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (float("nan"), 2.0), (float("inf"), 2.0), (0.0, 5.0), (1.0, 1.0)], "t double, df double")
    assert [round(r[0], 9) for r in rows.select(t_p_value("t", "df")).collect()] == [1, 1, 1, 1, 1, 1, 0.5]


def _plain(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, least = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        out[order[rank - 1]] = least
    return out


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_adjusted_against_a_loop(spark, chunk):
    rng = np.random.default_rng(3)
    values = {g: [round(float(x) ** 3, 3) for x in rng.random(n)] for g, n in (("a", 300), ("b", 41), ("c", 1), (None, 30))}
    rows = [(g, i, p if p > 0 else None, "x") for g, ps in values.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g string, gene int, p double, _total string").drop("_total")
    got = {(r.g, r.gene): r.p_adjusted for r in adjusted_p(df, ["g"], ["gene"], chunk=chunk).collect()}
    assert len(got) == len(rows)
    for g, ps in values.items():
        want = _plain([p if p > 0 else 1.0 for p in ps])
        assert [got[g, i] for i in range(len(ps))] == pytest.approx(want)
    assert adjusted_p(df.limit(0), ["g"], ["gene"]).count() == 0


def test_ranked_genes_have_p_values(spark):
    rng = np.random.default_rng(5)
    rows = [(c, g, float(rng.poisson(9 if g == 0 and c < 40 else 3))) for c in range(80) for g in range(6)]
    counts = spark.createDataFrame(rows, "cell_id long, gene_id long, count double")
    cells = spark.range(80).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 40, "x").otherwise("y").alias("kind"))
    plain, scored = C.rank_genes(counts, cells, "kind"), C.rank_genes(counts, cells, "kind", p_values=True)
    assert scored.columns == [*plain.columns, "p", "p_adjusted"]
    got = {(r.group, r.gene): r for r in scored.collect()}
    assert got["x", 0].p < 1e-6 and got["x", 0].score > 0 and got["y", 0].p == pytest.approx(got["x", 0].p)
    assert all(r.p <= r.p_adjusted <= 1 for r in got.values())
    x = np.log1p(np.array([[n for c, g, n in rows if g == k] for k in range(6)]) * np.median([sum(n for c, _, n in rows if c == i) for i in range(80)]) / np.array([sum(n for c, _, n in rows if c == i) for i in range(80)]))
    a, b = x[3, :40], x[3, 40:]
    v, w = a.var(ddof=1) / 40, b.var(ddof=1) / 40
    t, df = (a.mean() - b.mean()) / math.sqrt(v + w), (v + w) ** 2 / (v * v / 39 + w * w / 39)
    assert got["x", 3].score == pytest.approx(t) and got["x", 3].p == pytest.approx(_tail(t, df), rel=1e-6)
