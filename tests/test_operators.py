"""Operators on hand-written frames and against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyfold.operators import aggregate as A, joins as J, ranked as R, windows as W
from tallyfold.operators.grid import complete, key_grid
from tallyfold.operators.merge import update, upsert

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_null_keys_are_left_out_of_groups(spark, rows):
    df = spark.createDataFrame([(2020, "a", 1), (2021, "b", 2), (None, "a", 3)], "y int, k string, v int")
    assert rows(A.group_sum(df, ["y", "k"], v="v")) == [(2020, "a", 1), (2021, "b", 2)]


def test_complete_keeps_null_keys_and_fills_old_nulls(spark, rows):
    df = spark.createDataFrame([(2020, "a", 1.0), (None, "b", None)], "y int, k string, v double")
    assert rows(complete(df, ["y", "k"])) == [(2020, "a", 1.0), (2020, "b", 0.0), (None, "a", 0.0), (None, "b", 0.0)]


def test_complete_fills_only_named_columns(spark, rows):
    df = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 2, 2)], "y int, k string, v int, w int")
    assert rows(complete(df, ["y", "k"], fill_cols={"v": -1})) == [(1, "a", 1, 1), (1, "b", -1, None), (2, "a", -1, None), (2, "b", 2, 2)]


@FEW
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=20))
def test_grid_has_every_combination(spark, data):
    df = spark.createDataFrame(data, "a int, b int, c int")
    expected = len({t[0] for t in data}) * len({t[1] for t in data}) * len({t[2] for t in data})
    grid = key_grid(df, ["a", "b", "c"])
    assert grid.count() == expected == grid.distinct().count()


def test_all_combinations_without_cross_join(spark):
    a, b = spark.range(50).select(F.col("id").alias("x")), spark.range(70).select(F.col("id").alias("y"))
    out = J.all_combinations(a, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert out.distinct().count() == 3500
    for slots in (1, 7, 200):
        some = J.all_combinations(b, a, slots)
        assert some.columns == ["y", "x"] and some.distinct().count() == some.count() == 3500
    assert J.all_combinations(a, b.limit(0)).count() == J.all_combinations(a.limit(0), b).count() == 0


def test_null_safe_join_matches_null(spark, rows):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, 7)], "k int, w int")
    assert rows(J.null_safe_join(a, b, ["k"])) == [(1, "x", None), (None, "y", 7)]


def test_anti_join_keeps_null_and_partitions(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert J.drop_in(a, b, "k").count() + J.keep_in(a, b, "k").count() == 3
    assert J.drop_in(a, b, "k").where("k is null").count() == 1


def test_recode_modes(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    mapping = spark.createDataFrame([("a", "A")], "old string, new string")
    assert rows(J.recode(df, "k", mapping)) == [(1, "A"), (2, None), (3, None)]
    assert rows(J.recode(df, "k", mapping, "replace")) == [(1, "A"), (2, "b"), (3, None)]
    assert rows(J.recode(df, "k", mapping, default="?")) == [(1, "A"), (2, "?"), (3, "?")]
    with pytest.raises(ValueError):
        J.recode(df, "k", mapping, "other")


def test_first_last_and_unique_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert rows(J.first_row(df, ["k"], ["n"])) == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(J.first_row(df, ["k"], ["n"], last=True)) == [("a", 2, "y"), ("b", 3, "z")]
    assert rows(J.drop_duplicated_keys(df, ["k"])) == [("b", 3, "z")]
    assert rows(J.drop_duplicated_keys(df.select("k"), ["k"])) == [("b",)]
    assert rows(J.first_row(df.select("k"), ["k"], ["k"])) == [("a",), ("b",)]


def test_flag_repeats(spark, rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 6)], "k string, n int")
    assert rows(J.flag_repeats(df, ["k"], ["n"], "again")) == [("a", 1, False), ("a", 2, True), (None, 5, False), (None, 6, True)]


def test_term_differences_counts_pairs(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"c": rng.integers(0, 4, 60), "t": rng.integers(0, 5, 60).astype(str)})
    right = pd.DataFrame({"c": rng.integers(1, 5, 50), "t": rng.integers(2, 7, 50).astype(str)})
    out = J.term_differences(spark.createDataFrame(left), spark.createDataFrame(right), "c", "t").toPandas()
    pairs = left.merge(right, on="c")
    brute = pairs[pairs.t_x != pairs.t_y].groupby(["c", "t_x"]).size()
    got = out[out.differing_pairs > 0].set_index(["c", "t"]).differing_pairs
    assert got.to_dict() == brute.to_dict()


def test_id_gap(spark, rows):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(J.id_gap(a, b, "k")) == [(1, "left"), (2, "both"), (3, "right")]


@pytest.mark.parametrize("method, expected", [("nearest", (3.0, 10.0, 10.0)), ("linear", (2.75, 6.5, 10.25))])
def test_quantiles(spark, method, expected):
    df = spark.createDataFrame([("g", v) for v in (2.0, 3.0, 10.0, 11.0)], "g string, v double")
    out = R.group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}, method).first()
    assert tuple(out)[1:] == expected


def test_quantiles_with_a_hot_group_and_ties(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.7, "hot", rng.integers(0, 9, 4000).astype(str)),
                        "v": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(0, 50, 4000))})
    pdf.loc[5, "v"] = None
    names = {"a": 0.05, "b": 0.5, "c": 0.95}
    got = R.group_quantiles(spark.createDataFrame(pdf), ["g"], "v", names).toPandas().set_index("g")
    want = pdf.groupby("g").v.quantile(list(names.values())).unstack()
    assert np.allclose(got.loc[want.index].to_numpy(), want.to_numpy())


QUARTERS = {"a": 0.05, "b": 0.5, "c": 0.95}


def two_columns(n=30_000):
    rng = np.random.default_rng(2)
    return pd.DataFrame({"g": np.where(rng.random(n) < 0.7, "hot", rng.integers(0, 4, n).astype(str)),
                         "v": np.where(rng.random(n) < 0.3, 7.0, rng.normal(0, 50, n)), "w": rng.lognormal(0, 3, n)})


def check_two_columns(spark, pdf):
    wanted = {c: {f"{c}_{k}": q for k, q in QUARTERS.items()} for c in "vw"}
    got = R.column_quantiles(spark.createDataFrame(pdf), ["g"], wanted, also=[F.max("v").alias("top")]).toPandas().set_index("g")
    for c in "vw":
        want = pdf.groupby("g")[c].quantile(list(QUARTERS.values())).unstack()
        assert np.allclose(got.loc[want.index, list(wanted[c])].to_numpy(), want.to_numpy())
    assert np.allclose(got["top"].sort_index(), pdf.groupby("g").v.max().sort_index())


def test_quantiles_of_two_columns_beyond_the_sketch(spark):
    pdf = two_columns()
    assert pdf.g.value_counts().min() > R.FEW_ROWS
    check_two_columns(spark, pdf)


def test_few_values_are_left_to_order(spark, monkeypatch):
    seen = []
    real = R.write_measured
    monkeypatch.setattr(R, "write_measured", lambda df, path, **m: seen.append(real(df, path, **m)) or seen[-1])
    spread = spark.range(400_000).select(F.rand(1).alias("v"))
    got = R.column_quantiles(spread, [], {"v": {"a": 0.5}}).first()["a"]
    assert abs(got - 0.5) < 0.01
    # one row for each value in the bracket, whose two ends may be off by the error of the sketch themselves
    assert seen[0]["n"] < 400_000 * (2 * R.RANK_SLACK + 2 * R.RANK_ERROR)


def test_a_missed_bracket_is_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(R, "_bracket", lambda s, n, q: (F.lit(1e9), F.lit(1e9)))
    check_two_columns(spark, two_columns(6_000))


def test_values_near_a_rank_may_be_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_RANGE", 50)
    check_two_columns(spark, two_columns(6_000))


@pytest.mark.parametrize("columns", [["v"], ["v", "w"]])
def test_quantiles_read_the_table_twice(spark, tmp_path, columns):
    pdf = two_columns(3_000)
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/t")
    reads = spark.sparkContext.accumulator(0)
    tagged = F.udf(lambda v: reads.add(1) or v, "double")
    df = spark.read.parquet(f"{tmp_path}/t").withColumn("v", tagged.asNondeterministic()("v"))
    R.column_quantiles(df, ["g"], {c: {f"{c}_m": 0.5} for c in columns}).collect()
    assert reads.value == 2 * len(pdf)


def test_quantiles_of_odd_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", -inf, 1.0), ("a", inf, None), ("a", 3.0, float("nan")), (None, 4.0, 2.0), ("c", None, None)], "g string, v double, w double")
    got = R.column_quantiles(df, ["g"], {"v": {"m": 0.5}, "w": {"k": 0.5}}).collect()
    assert {tuple(r) for r in got} == {("a", 3.0, 1.0), (None, 4.0, 2.0)}
    assert R.column_quantiles(df.where("false"), ["g"], {"v": {"m": 0.5}}).collect() == []
    assert R.column_quantiles(df.where("false"), [], {"v": {"m": 0.5}}).first()["m"] is None


def test_running_weight_is_exact_over_ranges(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900, p=[0.8, 0.1, 0.1]), "o": rng.permutation(900), "w": rng.integers(0, 9, 900)})
    got = R.running_weight(spark.createDataFrame(pdf), ["o"], ["g"], "w").toPandas().sort_values("o")
    pdf = pdf.sort_values("o")
    want = pdf.groupby("g", dropna=False).w.cumsum() - pdf.w
    assert (got._before.to_numpy() == want.to_numpy()).all()
    assert (got._total.to_numpy() == pdf.groupby("g", dropna=False).w.transform("sum").to_numpy()).all()


def test_budget_takes_the_row_that_crosses(spark):
    df = spark.createDataFrame([("t", i, 4) for i in range(5)], "t string, id int, size int")
    assert R.budget_sample(df, ["t"], "id", "size", 6).count() == 2
    first = {r[1] for r in R.budget_sample(df, ["t"], "id", "size", 6).collect()}
    assert first == {r[1] for r in R.budget_sample(df, ["t"], "id", "size", 6).collect()}


def test_batches_and_ranks(spark, rows):
    df = spark.createDataFrame([(c,) for c in "edcba"], "k string")
    assert rows(R.batches(df, ["k"], 2)) == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)]
    sums = spark.createDataFrame([("x", 5), ("y", 7), ("x", 2), (None, 99), ("z", 1)], "l string, v int")
    assert rows(R.label_ranks(sums, "l", "v"), ) == [("x", 7, 1), ("y", 7, 2), ("z", 1, 3)]


def test_empirical_cdf(spark, rows):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (None,), (5.0,)], "v double")
    assert rows(R.empirical_cdf(df, "v")) == [(1.0, 2, 0.5), (3.0, 1, 0.75), (5.0, 1, 1.0)]


def test_running_total_over_a_gap_year(spark, rows):
    df = spark.createDataFrame([(2020, "a", 5), (2022, "a", 2), (2021, "b", 1)], "y int, k string, v int")
    out = W.running_total(complete(df, ["y", "k"]), ["k"], "y", "v", "c").where("k = 'a'")
    assert rows(out, "y", "c") == [(2020, 5), (2021, 5), (2022, 7)]


def test_period_change_zero_rules(spark):
    df = spark.createDataFrame(list(zip(range(4), [0.0, 0.0, 4.0, 2.0], "aaaa")), "y int, v double, k string")
    out = [r[0] for r in W.period_change(df, ["k"], "y", "v").orderBy("y").select("change_percent").collect()]
    assert out == [None, None, float("inf"), -50.0]


def test_mean_and_std_of_one_row(spark, rows):
    df = spark.createDataFrame([("a", 2.0)], "k string, v double")
    assert rows(A.mean_and_std(df, ["k"], "v", single_std=0.0)) == [("a", 2.0, 0.0)]
    assert rows(A.mean_and_std(df, ["k"], "v")) == [("a", 2.0, None)]


def test_row_of_max_skips_null_and_breaks_ties(spark, rows):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 9.0), ("a", 2, 9.0), ("b", 1, None)], "k string, id int, v double")
    assert rows(A.row_of_max(df, ["k"], "v", "id")) == [("a", 1, 9.0)]


def test_share_change_needs_both_periods(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "a", 1), (2, "c", 1)], "y int, k string, v int")
    assert rows(A.share_change(df, "y", "k", "v", 1, 2)) == [("a", 25.0, 50.0, 25.0)]


def test_confusion_columns_sum_to_one_or_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("a", "c")], "p string, t string")
    out = A.confusion(df, "p", "t").toPandas()
    assert len(out) == 9
    assert out.groupby("predicted").share.sum().round(9).to_dict() == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_set_recovery_edges(spark, rows):
    left = spark.createDataFrame([("x", "g9"), ("y", "g1"), ("w", "g1")], "g string, i string")
    right = spark.createDataFrame([("x", "g8"), ("y", "g1"), ("y", "g2")], "g string, i string")
    markers = spark.createDataFrame([("x", "g1"), ("y", "g1"), ("y", "g2"), ("w", "g1")], "g string, i string")
    assert rows(A.set_recovery(left, right, markers, "g", "i")) == [("x", 1, 0.0, 0.0, 0.0, 0.0), ("y", 2, 0.5, 1.0, 0.5, 0.5)]
    assert rows(A.recovered_fraction(left, markers, "g", "i")) == [("w", 1, 1, 1.0), ("x", 1, 0, 0.0), ("y", 2, 1, 0.5)]


def test_agreement_of_nulls(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), ("a", None), ("b", "a")], "x string, y string")
    assert tuple(A.agreement(df, "x", "y").first()) == (4, 2, 50.0)


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert A.ratio_of_sums(df, "a", "b").first()[0] is None


def test_pivot_top(spark, rows):
    df = spark.createDataFrame([("r", "a", 1), ("r", "z", 2), ("s", "b", 5)], "r string, c string, v int")
    assert rows(A.pivot_top(df, "r", "c", "v", ["a", "b"])) == [("r", 1, 0, 2), ("s", 0, 5, 0)]


def test_upsert_rules(spark, rows):
    base = spark.createDataFrame([(1, "a", 10, 5), (2, "b", 20, 6)], "k int, v string, n int, id int")
    new = spark.createDataFrame([(2, None, 2**40, 1, 99), (2, "late", 1, 2, 99), (3, "c", 7, 3, 99)], "k int, v string, n long, seq int, id int")
    assert rows(upsert(base, new, ["k"], ["seq"])) == [(1, "a", 10, 5), (2, None, None, 6), (3, "c", 7, None)]
    assert rows(update(base, new, ["k"], ["seq"])) == [(1, "a", 10, 5), (2, None, None, 6)]


@FEW
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=12))
def test_upsert_twice_is_upsert_once(spark, rows, base, new):
    b = spark.createDataFrame(list(dict(base).items()), "k int, v int")
    i = spark.createDataFrame(new, "k int, v int")
    once = upsert(b, i, ["k"], ["v"])
    assert rows(upsert(once, i, ["k"], ["v"])) == rows(once)


def test_first_n_trims_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 as g", "id as v")
    out = W.first_n(df, ["g"], [F.desc("v")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.v for r in out.collect()) == [994, 995, 996, 997, 998, 999]


def test_histogram_cumulative(spark, rows):
    df = spark.createDataFrame([(0.5,), (1.5,), (1.7,), (None,)], "v double")
    out = A.histogram(df, F.floor("v"), cumulative=True)
    assert [(b, n, round(c, 4)) for b, n, c in rows(out)] == [(0, 1, 0.3333), (1, 2, 1.0)]


def test_describe_matches_pandas(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    out = A.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert np.allclose(tuple(out), pd.Series(values).describe().to_numpy())
