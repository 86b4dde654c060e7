"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.dates import in_days
from ..operators import aggregate as A, sketches as K
from ..operators.cells import average_over
from ..operators.joins import drop_duplicated_keys, first_row
from ..operators.ontology import category_frequency
from ..operators.ranked import group_median
from ..plans import forecast, runlog, trends
from ..session import materialize
from .registry import DATASETS, RUNS, datasets, positioned, query, rounded, run_records, table


@query("a1_group_sum", f"""
WITH {DATASETS} SELECT CAST(year(release_date) AS INTEGER) AS year, organism, tissue, CAST(sum(cells) AS BIGINT) AS cells
FROM ds WHERE tissue <> 'BUILDING' GROUP BY 1, 2, 3""")
def a1(spark, sf):
    rows = datasets(spark, sf).withColumn("year", F.year("release_date")).withColumn(
        "tissue", F.when(F.col("tissue") != "BUILDING", F.col("tissue")))
    return A.group_sum(rows, ["year", "organism", "tissue"], cells="cells")


@query("a2_mean_and_std", """
SELECT l_orderkey, round(avg(l_extendedprice), 6) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 6) AS std FROM lineitem GROUP BY 1""")
def a2(spark, sf):
    return rounded(A.mean_and_std(table(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", single_std=0.0), 6)


@query("a3_frequent_values", """
SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 12""")
def a3(spark, sf):
    return A.frequent(table(spark, sf, "part"), ["p_brand", "p_type"], 12)


@query("a4_group_median", """
SELECT l_suppkey, round(median(l_extendedprice), 4) AS median FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def a4(spark, sf):
    return rounded(group_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice"))


@query("a5_min_max", """
SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def a5(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("a6_distinct_count", """
SELECT l_returnflag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts FROM lineitem GROUP BY 1""")
def a6(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts"))


DESCRIBED = """CAST(count(x) AS BIGINT) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS max"""


@query("a7_describe", f"SELECT o_orderpriority, {DESCRIBED} FROM (SELECT o_orderpriority, o_totalprice AS x FROM orders) GROUP BY 1")
def a7(spark, sf):
    return rounded(A.describe(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]))


@query("a7_describe_whole", f"SELECT {DESCRIBED} FROM (SELECT l_extendedprice AS x FROM lineitem)")
def a7b(spark, sf):
    return rounded(A.describe(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("a8_box_stats", """
WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS rn,
             count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem),
q AS (SELECT l_returnflag, l_linestatus, max(x) FILTER (WHERE rn = round((n - 1) * 0.25) + 1) AS q1,
        max(x) FILTER (WHERE rn = round((n - 1) * 0.5) + 1) AS med, max(x) FILTER (WHERE rn = round((n - 1) * 0.75) + 1) AS q3,
        min(x) AS min, max(x) AS max FROM r GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, q1, med, q3, min, max, round(q3 - q1, 4) AS iqr,
  round(greatest(q1 - 1.5 * (q3 - q1), min), 4) AS whislo, round(least(q3 + 1.5 * (q3 - q1), max), 4) AS whishi FROM q""")
def a8(spark, sf):
    return rounded(A.box_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("a8_box_stats_linear", """
WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3,
        min(value) AS min, max(value) AS max FROM events GROUP BY 1)
SELECT user_id, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, min, max, round(q3 - q1, 6) AS iqr,
  round(greatest(q1 - 1.5 * (q3 - q1), min), 6) AS whislo, round(least(q3 + 1.5 * (q3 - q1), max), 6) AS whishi FROM q""")
def a8b(spark, sf):
    return rounded(A.box_stats(table(spark, sf, "events"), ["user_id"], "value", method="linear"), 6)


@query("a9_ratio_of_sums", "SELECT l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio FROM lineitem GROUP BY 1")
def a9(spark, sf):
    return rounded(A.ratio_of_sums(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_suppkey"]))


@query("a10_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def a10(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("a10_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def a10b(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return first_row(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])


@query("a10_drop_all_duplicated", """
SELECT l_orderkey, l_suppkey, l_extendedprice FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n = 1""")
def a10c(spark, sf):
    return drop_duplicated_keys(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice"), ["l_orderkey"])


@query("a11_append_totals", f"""
WITH {DATASETS}, s AS (SELECT CAST(year(release_date) AS INTEGER) AS period, tech, CAST(sum(cells) AS BIGINT) AS cells FROM ds GROUP BY 1, 2)
SELECT * FROM s UNION ALL SELECT period, 'Total', CAST(sum(cells) AS BIGINT) FROM s GROUP BY 1""")
def a11(spark, sf):
    return trends.period_totals(datasets(spark, sf), "release_date", "tech", "cells")


@query("a12_share", f"""
WITH {DATASETS}, s AS (SELECT tissue, organism, sum(cells) AS cells FROM ds GROUP BY 1, 2)
SELECT tissue, organism, CAST(cells AS BIGINT) AS cells, round(cells / sum(cells) OVER (PARTITION BY tissue), 6) AS within_tissue,
  round(cells / sum(cells) OVER (), 6) AS of_all FROM s""")
def a12(spark, sf):
    sums = materialize(A.group_sum(datasets(spark, sf), ["tissue", "organism"], cells="cells"), "sums")
    return rounded(A.share_within(A.share_within(sums, ["tissue"], "cells", "within_tissue"), [], "cells", "of_all"), 6)


@query("a13_row_of_max", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def a13(spark, sf):
    return A.row_of_max(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("a14_share_change", f"""
WITH {DATASETS}, s AS (SELECT organism, sum(cells) FILTER (WHERE year(release_date) = 1996) AS a, sum(cells) FILTER (WHERE year(release_date) = 2000) AS b FROM ds GROUP BY 1),
p AS (SELECT organism, a / sum(a) OVER () * 100 AS a, b / sum(b) OVER () * 100 AS b FROM s)
SELECT organism, round(a, 4) AS first_percent, round(b, 4) AS second_percent, round(b - a, 4) AS delta_percent FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def a14(spark, sf):
    rows = datasets(spark, sf).withColumn("year", F.year("release_date"))
    return rounded(A.share_change(rows, "year", "organism", "cells", 1996, 2000))


@query("a15_top_and_other_pivot", f"""
WITH {DATASETS} SELECT tissue, CAST(sum(CASE WHEN tech = '1-URGENT' THEN cells ELSE 0 END) AS BIGINT) AS "1-URGENT",
  CAST(sum(CASE WHEN tech = '2-HIGH' THEN cells ELSE 0 END) AS BIGINT) AS "2-HIGH",
  CAST(sum(CASE WHEN tech NOT IN ('1-URGENT', '2-HIGH') THEN cells ELSE 0 END) AS BIGINT) AS other FROM ds GROUP BY 1""")
def a15(spark, sf):
    return A.pivot_top(datasets(spark, sf), "tissue", "tech", "cells", ["1-URGENT", "2-HIGH"])


@query("a16_key_value_pivot", """
SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS "view"
FROM events GROUP BY 1""")
def a16(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return A.to_wide(counts, ["user_id"], "event_type", "n", ["click", "view"]).fillna(0)


@query("a17_mapped_nested_counts", """
SELECT c_mktsegment AS tissue, r_name AS category, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 0 GROUP BY 1, 2""")
def a17(spark, sf):
    counted = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    nested = counted.select(F.col("c_mktsegment").alias("tissue"), F.create_map("n_name", "n").alias("counts"))
    mapping = table(spark, sf, "nation").where("n_regionkey <> 0").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), F.col("r_name").alias("category"))
    return A.mapped_counts(A.nested_counts(nested, "tissue", "counts"), "tissue", mapping)


@query("a18_shared_categories", """
SELECT l_partkey AS category, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 20""")
def a18(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tissue"), F.col("l_partkey").alias("category"))
    return A.shared_categories(rows, "tissue", "category", 20)


def _yields(spark, sf):
    return datasets(spark, sf).withColumn("done", F.col("status") != "P").withColumn(
        "cells", F.when(F.col("status") == "F", F.col("cells")).otherwise(0))


YIELDS = f"""{DATASETS}, y AS (SELECT organism, status <> 'P' AS done, CASE WHEN status = 'F' THEN cells ELSE 0 END AS cells FROM ds)"""
ESTIMATE = """round(avg(CASE WHEN cells > 0 THEN cells END), 4) AS cells_per_dataset, CAST(count(*) FILTER (WHERE NOT done) AS BIGINT) AS to_process,
  CAST(sum(cells) AS BIGINT) AS processed_cells, round(1 - count(*) FILTER (WHERE done AND cells = 0) / count(*), 4) AS fraction_with_cells,
  round(avg(CASE WHEN cells > 0 THEN cells END) * count(*) FILTER (WHERE NOT done) * (1 - count(*) FILTER (WHERE done AND cells = 0) / count(*)) + sum(cells), 2) AS estimated_cells,
  round(avg(CASE WHEN cells > 0 THEN cells END) * count(*) FILTER (WHERE NOT done) * (1 - count(*) FILTER (WHERE done AND cells = 0) / count(*)), 2) AS delta"""


def _two_digits(df):
    return df.withColumns({c: F.round(c, d) for c, d in
                           {"cells_per_dataset": 4, "fraction_with_cells": 4, "estimated_cells": 2, "delta": 2}.items()})


@query("a19_yield_estimate", f"WITH {YIELDS} SELECT organism, {ESTIMATE} FROM y GROUP BY 1")
def a19(spark, sf):
    return _two_digits(forecast.extrapolate_yield(_yields(spark, sf), "cells", "done", ["organism"]))


@query("a19_yield_estimate_all", f"WITH {YIELDS} SELECT {ESTIMATE} FROM y")
def a19b(spark, sf):
    return _two_digits(forecast.extrapolate_yield(_yields(spark, sf), "cells", "done"))


def _flat(spark, sf, kind="tool"):
    return runlog.flatten_runs(run_records(spark, sf), kind)


@query("a20_workflow_summary", f"""
WITH {RUNS} SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(count(*) AS BIGINT) AS run_count, round(sum(duration_seconds), 4) AS total_duration,
  CAST(count(*) FILTER (WHERE has_error) AS BIGINT) AS error_count, CAST(count(DISTINCT tool_name) AS BIGINT) AS unique_names,
  arg_min(tool_name, (start_time, CAST(run_id AS VARCHAR))) AS first_name, arg_max(tool_name, (start_time, CAST(run_id AS VARCHAR))) AS last_name,
  strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS workflow_start,
  strftime(arg_max(make_timestamp(epoch_us(start_time) + CAST(round(duration_seconds * 1e6) AS BIGINT)), (start_time, CAST(run_id AS VARCHAR))), '%Y-%m-%d %H:%M:%S') AS workflow_end, round(sum(duration_seconds) / count(*), 8) AS avg_duration,
  round(1 - count(*) FILTER (WHERE has_error) / count(*), 8) AS success_rate FROM runs GROUP BY 1""")
def a20(spark, sf):
    out = runlog.workflow_summary(_flat(spark, sf))
    shown = {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("workflow_start", "workflow_end")}
    out = out.withColumns({"total_duration": F.round("total_duration", 4), **shown})
    return rounded(out, 8)


@query("a20_name_sequence", f"""
WITH {RUNS} SELECT CAST(trace_id AS VARCHAR) AS trace_id, tool_name AS name,
  CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_time, CAST(run_id AS VARCHAR)) AS BIGINT) AS position FROM runs""")
def a20b(spark, sf):
    return runlog.name_sequence(_flat(spark, sf)).drop("length")


@query("a20_short_sequences", f"""
WITH {RUNS} SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(count(*) OVER (PARTITION BY trace_id) AS BIGINT) AS length, tool_name AS name,
  CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_time, CAST(run_id AS VARCHAR)) AS BIGINT) AS position FROM runs""")
def a20c(spark, sf):
    return runlog.name_sequence(_flat(spark, sf))


@query("a20_model_workflow", f"""
WITH {RUNS} SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(count(*) AS BIGINT) AS run_count, CAST(count(DISTINCT tool_name) AS BIGINT) AS unique_names,
  arg_min(tool_name, (start_time, CAST(run_id AS VARCHAR))) AS first_name, arg_max(tool_name, (start_time, CAST(run_id AS VARCHAR))) AS last_name,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_cost), 4) AS total_cost FROM runs GROUP BY 1""")
def a20e(spark, sf):
    out = runlog.workflow_summary(_flat(spark, sf, "model"), "model")
    return rounded(out.select("trace_id", "run_count", "unique_names", "first_name", "last_name", "total_tokens", "total_cost"))


@query("a20_workflow_overview", f"""
WITH {RUNS} SELECT CAST(count(DISTINCT trace_id) AS BIGINT) AS total_workflows, CAST(count(*) AS BIGINT) AS total_runs,
  round(count(*) / count(DISTINCT trace_id), 4) AS avg_runs_per_workflow FROM runs""")
def a20d(spark, sf):
    return rounded(runlog.workflow_overview(runlog.workflow_summary(_flat(spark, sf))))


@query("a21_run_stats", f"""
WITH {RUNS} SELECT tool_name AS name, CAST(count(*) AS BIGINT) AS call_count, CAST(count(*) FILTER (WHERE has_error) AS BIGINT) AS error_count,
  round(avg(CAST(has_error AS INTEGER)), 4) AS error_rate, round(avg(duration_seconds), 4) AS avg_duration, min(duration_seconds) AS min_duration,
  max(duration_seconds) AS max_duration, round(stddev_samp(duration_seconds), 4) AS std_duration, round(median(duration_seconds), 4) AS median_duration,
  CAST(row_number() OVER (ORDER BY count(*) DESC, tool_name) AS BIGINT) AS position
FROM runs GROUP BY 1""")
def a21(spark, sf):
    return rounded(positioned(runlog.run_stats(_flat(spark, sf))))


@query("a21_model_stats", f"""
WITH {RUNS} SELECT 'm-' || tool_name AS name, CAST(count(*) AS BIGINT) AS call_count, round(median(duration_seconds), 4) AS median_duration,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(total_tokens), 4) AS avg_tokens, round(sum(total_cost), 2) AS total_cost, round(avg(total_cost), 4) AS avg_cost
FROM runs GROUP BY 1""")
def a21b(spark, sf):
    stats = runlog.run_stats(_flat(spark, sf, "model"), "model")
    return rounded(stats.select("name", "call_count", "median_duration", "total_tokens", "avg_tokens", F.round("total_cost", 2).alias("total_cost"), "avg_cost"))


@query("a21_overall_stats", f"""
WITH {RUNS} SELECT CAST(count(*) AS BIGINT) AS total_calls, round(avg(CAST(has_error AS INTEGER)), 4) AS error_rate, round(avg(duration_seconds), 4) AS avg_duration,
  CAST(count(DISTINCT tool_name) AS BIGINT) AS unique_names, round(median(duration_seconds), 4) AS median_duration FROM runs""")
def a21c(spark, sf):
    return rounded(runlog.overall_stats(_flat(spark, sf)))


@query("a22_agreement", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE quality <> toxic) AS BIGINT) AS n_mismatch,
  round((1 - count(*) FILTER (WHERE quality <> toxic) / count(*)) * 100, 4) AS accuracy FROM labels""")
def a22(spark, sf):
    return rounded(A.agreement(table(spark, sf, "labels"), "quality", "toxic"))


@query("a22_mismatches", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic")
def a22b(spark, sf):
    return A.mismatches(table(spark, sf, "labels"), "quality", "toxic")


@query("a23_confusion", """
WITH k AS (SELECT lang AS p, CASE WHEN n_chars > 2000 THEN source ELSE lang END AS a FROM documents),
l AS (SELECT p AS l FROM k UNION SELECT a FROM k),
n AS (SELECT p, a, count(*) AS n FROM k GROUP BY 1, 2),
f AS (SELECT x.l AS actual, y.l AS predicted, coalesce(n, 0) AS n FROM l x CROSS JOIN l y LEFT JOIN n ON n.a = x.l AND n.p = y.l)
SELECT actual, predicted, CAST(n AS BIGINT) AS n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY predicted), 0), 0), 6) AS share FROM f""")
def a23(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.when(F.col("n_chars") > 2000, F.col("source")).otherwise(F.col("lang")).alias("truth"))
    return rounded(A.confusion(rows, "lang", "truth"), 6)


def _rankings(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("group"), F.col("l_partkey").alias("gene"), "l_returnflag", "l_quantity", "p_size")
    left = line.where("l_returnflag = 'A' and l_quantity > 40")
    right = line.where("l_returnflag = 'N' and l_quantity > 45")
    markers = table(spark, sf, "part").where("p_size > 10").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("gene"))
    return left, right, markers


RANKINGS = """x AS (SELECT DISTINCT p_brand AS g, l_partkey AS gene FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_quantity > 40),
y AS (SELECT DISTINCT p_brand AS g, l_partkey AS gene FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' AND l_quantity > 45),
m AS (SELECT p_brand AS g, p_partkey AS gene FROM part WHERE p_size > 10)"""


RECOVERY_SQL = f"""
WITH {RANKINGS}, j AS (SELECT m.g, x.gene IS NOT NULL AS a, y.gene IS NOT NULL AS b FROM m LEFT JOIN x ON m.g = x.g AND m.gene = x.gene LEFT JOIN y ON m.g = y.g AND m.gene = y.gene
  WHERE m.g IN (SELECT g FROM x) AND m.g IN (SELECT g FROM y))
SELECT g AS "group", CAST(count(*) AS BIGINT) AS n_markers, round(count(*) FILTER (WHERE a) / count(*), 6) AS left_fraction, round(count(*) FILTER (WHERE b) / count(*), 6) AS right_fraction,
  round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS shared_fraction, round(coalesce(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0), 0), 6) AS jaccard
FROM j GROUP BY 1"""


@query("a24_set_recovery", RECOVERY_SQL)
def a24(spark, sf):
    return rounded(A.set_recovery(*_rankings(spark, sf), "group", "gene"), 6)


@query("a24_sketch_recovery", RECOVERY_SQL)
def a24_sketches(spark, sf):
    left, right, markers = (K.id_sketches(df, ["group"], "gene") for df in _rankings(spark, sf))
    return rounded(K.sketch_recovery(left, right, markers, "group"), 6)


@query("a25_axis_mean", """
SELECT c_mktsegment AS tissue, round(avg(v), 4) AS v FROM (
  SELECT c_mktsegment, c_nationkey, sum(c_acctbal) / count(*) AS v FROM customer GROUP BY 1, 2) GROUP BY 1""")
def a25(spark, sf):
    cells = A.ratio_of_sums(table(spark, sf, "customer").withColumn("one", F.lit(1)), "c_acctbal", "one", ["c_mktsegment", "c_nationkey"], "v")
    return rounded(average_over(cells, "c_mktsegment", ["v"]).withColumnRenamed("c_mktsegment", "tissue"))


@query("a26_histogram", """
WITH b AS (SELECT CAST(floor((log10(l_extendedprice) - 2) / 0.05) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1)
SELECT bin, CAST(n AS BIGINT) AS n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cumulative_share FROM b""")
def a26(spark, sf):
    return rounded(A.histogram(table(spark, sf, "lineitem"), numeric.log_bin("l_extendedprice", 2, 0.05), cumulative=True), 6)


@query("a26_histogram_2d", """
SELECT CAST(floor(log10(l_extendedprice) / 0.25) AS BIGINT) AS x_bin, CAST(floor(log10(l_quantity + 1) / 0.25) AS BIGINT) AS y_bin, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > -1 GROUP BY 1, 2""")
def a26b(spark, sf):
    return A.histogram_2d(table(spark, sf, "lineitem"), numeric.log_bin("l_extendedprice", 0, 0.25), numeric.log_bin("l_quantity", 0, 0.25, plus_one=True))


@query("a27_storage_usage", """
WITH o AS (SELECT lang AS bucket, CAST(sum(n_chars) AS BIGINT) AS size_bytes, CAST(count(*) AS BIGINT) AS n_objects FROM documents GROUP BY 1),
t AS (SELECT d.lang AS bucket, CAST(sum(b.n_chars) AS BIGINT) AS egress_bytes FROM documents d JOIN (SELECT doc_id, n_chars * 3 AS n_chars FROM documents) b USING (doc_id) WHERE source < 'src2' GROUP BY 1)
SELECT o.bucket, size_bytes, n_objects, coalesce(egress_bytes, 0) AS egress_bytes,
  CASE WHEN size_bytes < 1024 THEN printf('%.2f B', size_bytes * 1.0::DOUBLE) WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024.0::DOUBLE)
       ELSE printf('%.2f MB', size_bytes / 1048576.0::DOUBLE) END AS size_text,
  round(coalesce(egress_bytes, 0) / size_bytes * 5, 6) AS downloads, round(coalesce(egress_bytes, 0) / 1099511627776 * 120, 6) AS cost
FROM o LEFT JOIN t ON o.bucket = t.bucket""")
def a27(spark, sf):
    docs = table(spark, sf, "documents")
    objects = docs.select(F.col("lang").alias("bucket"), F.col("n_chars").alias("length"))
    traffic = docs.where("source < 'src2'").select(F.col("lang").alias("bucket"), (F.col("n_chars") * 3).alias("bytes"))
    return rounded(forecast.storage_usage(objects, traffic, copies=5), 6)


@query("a27_storage_window", """
WITH o AS (SELECT event_type AS bucket, CAST(sum(event_id) AS BIGINT) AS size_bytes, CAST(count(*) AS BIGINT) AS n_objects FROM events GROUP BY 1),
t AS (SELECT event_type AS bucket, CAST(sum(event_id % 1000) AS BIGINT) AS egress_bytes FROM events WHERE ts >= DATE '2024-01-02' AND ts < DATE '2024-01-06' GROUP BY 1)
SELECT o.bucket, size_bytes, n_objects, coalesce(egress_bytes, 0) AS egress_bytes,
  round(coalesce(egress_bytes, 0) / size_bytes, 8) AS downloads, round(coalesce(egress_bytes, 0) / 1099511627776 * 120, 8) AS cost
FROM o LEFT JOIN t ON o.bucket = t.bucket""")
def a27_window(spark, sf):
    events = table(spark, sf, "events")
    objects = events.select(F.col("event_type").alias("bucket"), F.col("event_id").alias("length"))
    points = events.select(F.col("event_type").alias("bucket"), "ts", (F.col("event_id") % 1000).alias("bytes"))
    usage = forecast.storage_usage(objects, points, window=in_days("ts", "2024-01-02", "2024-01-05"))
    return rounded(usage.drop("size_text"), 8)


@query("a28_cost_projection", """
SELECT CAST(count(*) AS BIGINT) AS n, round(count(*) / 60.0::DOUBLE, 4) AS hours, round(count(*) * 0.08::DOUBLE, 4) AS cost, CAST(count(*) * 63000 AS BIGINT) AS tokens,
  round(8 * 25 * count(*) FILTER (WHERE o_orderstatus <> 'F') / 60.0::DOUBLE, 4) AS cpu_hours_saved FROM orders""")
def a28(spark, sf):
    rates = {"hours": forecast.MINUTES_PER_DATASET / 60, "cost": forecast.COST_PER_DATASET, "tokens": forecast.TOKENS_PER_DATASET}
    saved = F.count_if(F.col("o_orderstatus") != "F") * (forecast.CPU_MINUTES * 25) / 60
    n = F.count(F.lit(1))
    return rounded(table(spark, sf, "orders").agg(n.alias("n"), *forecast.project_costs(n, rates), saved.alias("cpu_hours_saved")))


@query("a29_category_count", """
SELECT tag AS category, CAST(count(*) AS BIGINT) AS n_terms FROM (
  SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1""")
def a29(spark, sf):
    return category_frequency(table(spark, sf, "part").select(
        F.col("p_partkey").alias("term"), F.explode(F.split("p_name", " ")).alias("category")))


@query("a30_funnel", """
SELECT CAST(count(o_orderkey) AS BIGINT) AS with_id, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS single_cell,
  CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS target_library,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS BIGINT) AS all_flags,
  CAST((SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)) AS BIGINT) AS with_results FROM orders""")
def a30(spark, sf):
    single, target = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    stages = {"with_id": F.col("o_orderkey").isNotNull(), "single_cell": single, "target_library": target, "all_flags": single & target}
    results = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return forecast.funnel(table(spark, sf, "orders"), stages, results, "o_orderkey")
