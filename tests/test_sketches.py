"""Sketches of id sets against exact sets, and their merging."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.aggregate import set_recovery
from tallyfold.operators.sketches import id_sketches, merged_sketches, sketch_overlap, sketch_recovery


@pytest.fixture(scope="module")
def sides(spark):
    """300,000 ids a group, far more than a sketch holds; group and period follow from the id, half of one side is in the other."""
    rows = spark.range(900_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("year"), "id")
    return rows.where("id < 600000"), rows.where("id >= 300000")


def _exact(sides):
    a, b = ({(r.g, r.id) for r in s.select("g", "id").collect()} for s in sides)
    out = {}
    for g in range(3):
        x, y = ({i for k, i in s if k == g} for s in (a, b))
        out[g] = len(x), len(y), len(x & y), len(x | y)
    return out


def test_large_sets_within_three_per_cent(sides):
    got = {r.g: tuple(r)[1:] for r in sketch_overlap(*[id_sketches(s, ["g"], "id") for s in sides], ["g"]).collect()}
    for g, want in _exact(sides).items():
        assert got[g][:4] == pytest.approx(want, rel=0.03) and got[g][:4] != want
        assert got[g][4] == pytest.approx(want[2] / want[3], rel=0.03)


def test_periods_merge_without_the_ids(spark, sides, tmp_path):
    written = []
    for i, s in enumerate(sides):
        id_sketches(s, ["g", "year"], "id").write.parquet(f"{tmp_path}/{i}")
        written.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert written[i].count() == 30
        assert "id" not in written[i].columns
    merged = sketch_overlap(*[merged_sketches(w, ["g"]) for w in written], ["g"])
    for r in merged.collect():
        assert tuple(r)[1:5] == pytest.approx(_exact(sides)[r.g], rel=0.03)


def test_small_sets_are_exact(spark):
    def t(rows):
        return spark.createDataFrame(rows, "g string, id long")
    left, right = t([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 4), ("a", None)]), t([("a", 2), ("a", 3), ("c", 1)])
    got = {r.g: tuple(r)[1:] for r in sketch_overlap(id_sketches(left, ["g"], "id"), id_sketches(right, ["g"], "id"), ["g"]).collect()}
    assert got == {"a": (2, 2, 1, 3, 1 / 3), "b": (1, 0, 0, 1, 0.0), "c": (0, 1, 0, 1, 0.0)}


def test_recovery_equals_the_exact_form(spark, rows):
    def t(pairs):
        return spark.createDataFrame(pairs, "g string, id long")
    left, right = t([("a", i) for i in range(40)] + [("b", 1)]), t([("a", i) for i in range(20, 70)] + [("b", 7), ("c", 1)])
    markers = t([("a", i) for i in range(0, 60, 3)] + [("b", 2), ("c", 1), ("d", 4)])
    exact = set_recovery(left, right, markers, "g", "id")
    sketched = sketch_recovery(*[id_sketches(x, ["g"], "id") for x in (left, right, markers)], "g")
    assert sketched.columns == exact.columns and rows(sketched) == rows(exact) and exact.count() == 2


def test_empty(spark):
    none = spark.createDataFrame([], "g string, id long")
    sketched = id_sketches(none, ["g"], "id")
    assert sketch_overlap(sketched, sketched, ["g"]).count() == 0 and merged_sketches(sketched, ["g"]).count() == 0
