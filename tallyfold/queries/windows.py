"""Windows, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranked as R, windows as W
from ..operators.aggregate import group_sum, share_within
from ..operators.joins import flag_repeats, spread_first
from ..plans.trends import summed_by_period
from ..session import materialize
from .registry import DATASETS, datasets, positioned, query, rounded, table


@query("w1_running_total", f"""
WITH {DATASETS}, s AS (SELECT CAST(year(release_date) AS INTEGER) AS year, organism, sum(cells) AS cells FROM ds GROUP BY 1, 2)
SELECT year, organism, CAST(cells AS BIGINT) AS cells, CAST(sum(cells) OVER (PARTITION BY organism ORDER BY year) AS BIGINT) AS cumulative FROM s""")
def w1(spark, sf):
    sums = group_sum(datasets(spark, sf).withColumn("year", F.year("release_date")), ["year", "organism"], cells="cells")
    return W.running_total(sums, ["organism"], "year", "cells", "cumulative")


@query("w2_period_change", f"""
WITH {DATASETS}, s AS (SELECT CAST(date_trunc('month', release_date) AS DATE) AS period, collection, sum(cells) AS cells FROM ds GROUP BY 1, 2),
l AS (SELECT *, lag(cells) OVER (PARTITION BY collection ORDER BY period) AS prev FROM s)
SELECT strftime(period, '%Y-%m-%d') AS period, collection, CAST(cells AS BIGINT) AS cells, round((cells / nullif(prev, 0) - 1) * 100, 6) AS change FROM l""")
def w2(spark, sf):
    sums = group_sum(datasets(spark, sf).withColumn("period", F.trunc("release_date", "month")), ["period", "collection"], cells="cells")
    return rounded(W.period_change(sums, ["collection"], "period", "cells", "change").withColumn("period", F.col("period").cast("string")), 6)


@query("w3_first_n_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5""")
def w3(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.first_n(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)


@query("w4_spread_first", """
SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS sample FROM orders""")
def w4(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("sample"))
    return spread_first(rows, ["o_custkey"], "sample", ["sample"])


@query("w5_budget_sample", f"""
WITH {DATASETS}, r AS (SELECT tissue, accession, cells, sum(cells) OVER (PARTITION BY tissue ORDER BY md5('42:' || accession) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ds)
SELECT tissue, accession, cells FROM r WHERE coalesce(before, 0) < 50000000""")
def w5(spark, sf):
    rows = datasets(spark, sf).select("tissue", "accession", "cells")
    return R.budget_sample(rows, ["tissue"], "accession", "cells", 5e7)


@query("w5_budget_in_given_order", f"""
WITH {DATASETS}, r AS (SELECT tissue, accession, cells, sum(cells) OVER (PARTITION BY tissue ORDER BY accession ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ds)
SELECT tissue, accession, CAST(cells AS BIGINT) AS cells, CAST(coalesce(before, 0) AS BIGINT) AS size_before FROM r WHERE coalesce(before, 0) < 50000000""")
def w5b(spark, sf):
    rows = datasets(spark, sf).select("tissue", "accession", "cells")
    ranked = R.running_weight(rows, ["accession"], by=["tissue"], weight="cells")
    return ranked.where("_before < 50000000").withColumnRenamed("_before", "size_before").drop("_total")


@query("w6_repeat_flag", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS repeated FROM orders""")
def w6(spark, sf):
    return flag_repeats(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], "repeated")


@query("w7_empirical_cdf", """
SELECT value, CAST(n AS BIGINT) AS n, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 6) AS fraction
FROM (SELECT value, count(*) AS n FROM events GROUP BY 1)""")
def w7(spark, sf):
    return rounded(R.empirical_cdf(table(spark, sf, "events"), "value"), 6)


@query("w8_sorted_batches", """
SELECT p_name, p_partkey, CAST(floor((row_number() OVER (ORDER BY p_name, p_partkey) - 1) / 200) AS BIGINT) AS batch_id FROM part""")
def w8(spark, sf):
    return R.batches(table(spark, sf, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], 200)


@query("w9_row_sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE md5('42:' || l_orderkey || ':' || l_linenumber) < '33333333'")
def w9(spark, sf):
    return W.row_sample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 0.2, ["l_orderkey", "l_linenumber"])


@query("o1_mixed_sort", """
SELECT s_nationkey, s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS BIGINT) AS position FROM supplier""")
def o1(spark, sf):
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return positioned(rows.orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey"))


@query("o2_top_categories", f"""
WITH {DATASETS}, t AS (SELECT organism FROM ds WHERE organism <> 'NATION_3' GROUP BY 1 ORDER BY sum(cells) DESC, organism LIMIT 10)
SELECT accession, organism, cells FROM ds WHERE organism IN (SELECT organism FROM t)""")
def o2(spark, sf):
    return W.keep_top(datasets(spark, sf).select("accession", "organism", "cells"), "organism", "cells", 10, ["NATION_3"])


@query("o2_top_by_cumulative", f"""
WITH {DATASETS}, s AS (SELECT CAST(year(release_date) AS INTEGER) AS period, organism, sum(cells) AS cells FROM ds GROUP BY 1, 2),
g AS (SELECT p.period, o.organism, coalesce(cells, 0) AS cells FROM (SELECT DISTINCT period FROM s) p CROSS JOIN (SELECT DISTINCT organism FROM s) o LEFT JOIN s USING (period, organism)),
c AS (SELECT *, sum(cells) OVER (PARTITION BY organism ORDER BY period) AS cum FROM g)
SELECT organism FROM c GROUP BY 1 ORDER BY sum(cum) DESC, organism LIMIT 10""")
def o2b(spark, sf):
    sums = summed_by_period(datasets(spark, sf), "release_date", "organism", "cells")
    return W.top_labels(W.running_total(sums, ["organism"], "period", "cells", "cumulative"), "organism", "cumulative", 10)


@query("o3_top_by_single_row", """
SELECT o_custkey FROM orders GROUP BY 1 ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 35""")
def o3(spark, sf):
    return W.top_labels(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 35, how="max")


@query("o4_ordered_head", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""")
def o4(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return W.head(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 20)


@query("o4_first_distinct_ids", "SELECT DISTINCT l_partkey FROM lineitem ORDER BY 1 LIMIT 30")
def o4b(spark, sf):
    return W.head(table(spark, sf, "lineitem").select("l_partkey").distinct(), ["l_partkey"], 30)


@query("w2_share_change", f"""
WITH {DATASETS}, s AS (SELECT CAST(year(release_date) AS INTEGER) AS period, tissue, sum(cells) AS cells FROM ds GROUP BY 1, 2),
h AS (SELECT *, cells / sum(cells) OVER (PARTITION BY period) AS share FROM s)
SELECT period, tissue, CAST(cells AS BIGINT) AS cells, round(share, 6) AS share, round((share / lag(share) OVER (PARTITION BY tissue ORDER BY period) - 1) * 100, 4) AS change_percent FROM h""")
def w2b(spark, sf):
    sums = materialize(group_sum(datasets(spark, sf).withColumn("period", F.year("release_date")), ["period", "tissue"], cells="cells"), "sums")
    out = W.period_change(share_within(sums, ["period"], "cells"), ["tissue"], "period", "share")
    return out.withColumns({"share": F.round("share", 6), "change_percent": F.round("change_percent", 4)})
