"""Projections, predicates and recoding."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import dates, numeric, rules, text
from ..operators.embed import trim_outliers
from ..operators.joins import drop_in, recode
from ..operators.ranked import label_ranks
from ..plans.catalogues import metadata_rows
from ..plans.trends import collapse_rare
from .registry import DATASETS, datasets, query, rounded, table

# stand-in keyword lists for the invented texts
WORDS = ("the", "and", "not")


@query("p1_select_rename", "SELECT c_mktsegment AS tissue, c_custkey AS sample, c_name AS name FROM customer")
def p1(spark, sf):
    return table(spark, sf, "customer").withColumnsRenamed(
        {"c_custkey": "sample", "c_mktsegment": "tissue", "c_name": "name"}).select("tissue", "sample", "name")


@query("p2_equality_filter", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_orderstatus = 'F'""")
def p2(spark, sf):
    return table(spark, sf, "orders").where(
        (F.lower("o_orderpriority") == "1-urgent") & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_orderstatus")


@query("p3_in_and_not_in", """
SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def p3(spark, sf):
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return drop_in(urgent, poor, "o_custkey").select("o_orderkey")


@query("p4_missing_values", """
SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE lower(c_mktsegment) IN ('machinery', 'building') OR c_acctbal < 0) AS BIGINT) AS n_missing
FROM customer GROUP BY 1""")
def p4(spark, sf):
    label = F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    known = table(spark, sf, "customer").withColumn("label", text.nullify(label, ["Machinery", "building"]))
    return known.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("n_missing"))


@query("p5_threshold_filters", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS cells FROM lineitem
WHERE l_quantity > 10 AND l_extendedprice >= 5000 AND l_discount <= 0.05 GROUP BY 1""")
def p5(spark, sf):
    kept = table(spark, sf, "lineitem").where("l_quantity > 10 and l_extendedprice >= 5000 and l_discount <= 0.05")
    return rounded(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("cells")))


@query("p6_date_window", """
SELECT event_type,
  CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11') AS BIGINT) AS n_range,
  CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23' AND ts <= TIMESTAMP '2024-01-30') AS BIGINT) AS n_last_week
FROM events GROUP BY 1""")
def p6(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if(dates.in_days("ts", "2024-01-05", "2024-01-10")).alias("n_range"),
        F.count_if(dates.in_last_days("ts", 7, datetime(2024, 1, 30))).alias("n_last_week"))


@query("p7_text_filter", """
SELECT p_partkey, p_name FROM part
WHERE contains(p_name, 'ring') OR starts_with(p_name, 'red') OR regexp_matches(p_name, '(?i)^B.*(LT|ET)$')""")
def p7(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").where(
        name.contains("ring") | name.startswith("red") | name.rlike("(?i)^B.*(LT|ET)$")).select("p_partkey", "p_name")


@query("p8_row_mask", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax > 0.02 AND l_discount > 0""")
def p8(spark, sf):
    flags = [F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_tax") > 0.02, F.col("l_discount") > 0]
    mask = flags[0] & flags[1] & flags[2] & flags[3]
    return table(spark, sf, "lineitem").where(mask).select("l_orderkey", "l_linenumber")


@query("p9_keep_or_other", """
SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' THEN o_orderpriority ELSE 'other' END AS tech,
       CASE WHEN o_orderstatus <> 'F' THEN 'other' ELSE o_orderpriority END AS tech_by_status,
       CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def p9(spark, sf):
    label = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        rules.keep_or_other(label, ["1-URGENT", "2-HIGH"]).alias("tech"),
        F.when(F.col("o_orderstatus") != "F", "other").otherwise(F.col("o_orderpriority")).alias("tech_by_status"),
    ).groupBy("tech", "tech_by_status").agg(F.count(F.lit(1)).alias("n"))


@query("p10_collapse_rare", f"""
WITH {DATASETS}, tot AS (SELECT organism, sum(cells) AS t FROM ds GROUP BY 1)
SELECT CASE WHEN t < 150000000 THEN 'Other' ELSE ds.organism END AS organism, CAST(sum(cells) AS BIGINT) AS cells
FROM ds JOIN tot ON ds.organism = tot.organism GROUP BY 1""")
def p10(spark, sf):
    return collapse_rare(datasets(spark, sf), "organism", "cells", 150_000_000).groupBy("organism").agg(F.sum("cells").alias("cells"))


@query("p11_rule_category", """
SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'red') THEN 'first'
  WHEN contains(p_name, 'widget') THEN 'second' WHEN contains(p_name, 'o') THEN 'third' ELSE 'rest' END AS category FROM part""")
def p11(spark, sf):
    ladder = [(("ring", "red"), "first"), (("widget",), "second"), (("o",), "third")]
    return table(spark, sf, "part").select("p_partkey", rules.category_from_text("p_name", ladder, "rest").alias("category"))


@query("p12_keyword_override", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the|and|not') THEN 'Healthy' ELSE lang END AS label,
  regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])(?:the|and|not)(?:$|[^\\p{L}\\p{N}_])') AS as_word FROM documents""")
def p12(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.when(text.has_keyword("text", WORDS), "Healthy").otherwise(F.col("lang")).alias("label"),
        text.has_keyword("text", WORDS, whole_word=True).alias("as_word"))


@query("p13_recode", """
SELECT c_custkey, r.r_name AS mapped, coalesce(r.r_name, n_name) AS replaced,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'bone' WHEN 'MACHINERY' THEN 'muscle' END AS small_map
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region r ON n_regionkey = r_regionkey AND n_regionkey < 3""")
def p13(spark, sf):
    nation = table(spark, sf, "nation")
    mapping = nation.where("n_regionkey < 3").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("mapped"), F.col("n_name").alias("replaced"),
        text.map_label("c_mktsegment", {"BUILDING": "bone", "MACHINERY": "muscle"}).alias("small_map"))
    return recode(recode(rows, "mapped", mapping), "replaced", mapping, "replace")


@query("p14_scaling_and_bounds", """
SELECT o_orderpriority, round(m / 1e3, 4) AS mean_k, round(m - s, 4) AS lower, round(m + s, 4) AS upper, round(m / nullif(s, 0), 4) AS ratio
FROM (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1)""")
def p14(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return rounded(sums.select(
        "o_orderpriority", (F.col("m") / 1e3).alias("mean_k"), (F.col("m") - F.col("s")).alias("lower"),
        (F.col("m") + F.col("s")).alias("upper"), numeric.ratio("m", "s").alias("ratio")))


@query("p15_constant_tag", """
SELECT s_suppkey AS id, 'supplier' AS source FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer""")
def p15(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"))
    return a.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source")))


@query("p16_numeric_cleanup", """
SELECT l_orderkey, l_linenumber, TRY_CAST(t AS DOUBLE) AS number, CAST(coalesce(trunc(TRY_CAST(t AS DOUBLE)), 0) AS BIGINT) AS whole,
  CASE WHEN l_orderkey * 1000000 BETWEEN -2147483648 AND 2147483647 THEN l_orderkey * 1000000 END AS small
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN '12.5%' WHEN l_returnflag = 'N' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.75' END AS t FROM lineitem)""")
def p16(spark, sf):
    shown = F.when(F.col("l_returnflag") == "A", "12.5%").when(
        F.col("l_returnflag") == "N", F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".75")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.to_number(shown).alias("number"),
        numeric.to_count(numeric.to_number(shown)).alias("whole"), numeric.within_int32(F.col("l_orderkey") * 1_000_000).alias("small"))


@query("p17_column_names", """
SELECT s_suppkey AS estimated_number_of_cells, s_name AS sample_name, s_acctbal AS reads_in_cell___ FROM supplier""")
def p17(spark, sf):
    return text.snake_columns(table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("Estimated Number of Cells"), F.col("s_name").alias("Sample-Name"), F.col("s_acctbal").alias("Reads in Cell(%)")))


@query("p18_label_rank", f"""
WITH {DATASETS}, tot AS (SELECT organism, sum(cells) AS total FROM ds GROUP BY 1)
SELECT organism, CAST(total AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY total DESC, organism) AS BIGINT) AS label_rank FROM tot""")
def p18(spark, sf):
    return label_ranks(datasets(spark, sf), "organism", "cells")


@query("p19_truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS appended,
  CASE WHEN length(text) > 200 THEN substring(text, 1, 197) || '...' ELSE text END AS within_limit FROM documents""")
def p19(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.truncate_text("text", 100).alias("appended"), text.truncate_text("text", 200, total=True).alias("within_limit"))


@query("p20_facet_flag", """
SELECT n_nationkey, CASE WHEN n_name IN ('NATION_1', 'NATION_7') THEN 'major' ELSE 'minor' END AS facet, CAST(count(c_custkey) AS BIGINT) AS n
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def p20(spark, sf):
    joined = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_nationkey", rules.facet("n_name", ["NATION_1", "NATION_7"]).alias("facet")).agg(F.count("c_custkey").alias("n"))


@query("p21_first_clean_label", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE lower(p_type) END AS label FROM part""")
def p21(spark, sf):
    preferred = F.when(F.col("p_size") > 25, F.concat(F.lit('" '), F.upper("p_name"), F.lit('";stem')))
    return table(spark, sf, "part").select("p_partkey", text.first_clean_label(preferred, "p_type").alias("label"))


@query("p22_percentile_trim", """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a1, quantile_cont(l_extendedprice, 0.95) AS a2,
                  quantile_cont(l_quantity, 0.05) AS b1, quantile_cont(l_quantity, 0.95) AS b2 FROM lineitem)
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem, b
WHERE l_extendedprice BETWEEN a1 AND a2 AND l_quantity BETWEEN b1 AND b2 GROUP BY 1""")
def p22(spark, sf):
    kept = trim_outliers(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 0.05, 0.95)
    return rounded(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), 2)


@query("p23_rescale", """
SELECT c_custkey, round(300 + (c_acctbal - lo) / (hi - lo) * 7700, 4) AS size
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def p23(spark, sf):
    return rounded(numeric.rescale(table(spark, sf, "customer"), "c_acctbal", 300.0, 8000.0, "size").select("c_custkey", "size"))


@query("p24_path_rewrite", "SELECT page_id, replace(url, 'example.', 'mirror.') AS url FROM pages")
def p24(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.replace_literal("url", "example.", "mirror.").alias("url"))


@query("p25_stand_in_id", """
SELECT c_custkey, '1' || ltrim(CASE WHEN c_custkey % 2 = 0 THEN 'ARC' ELSE 'CARX' END || c_custkey, 'ARC') AS entrez FROM customer""")
def p25(spark, sf):
    accession = F.concat(F.when(F.col("c_custkey") % 2 == 0, "ARC").otherwise("CARX"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.stand_in_id(accession).alias("entrez"))


@query("p26_metadata_rows", """
SELECT DISTINCT l_suppkey AS accession, 'sra' AS database, 'yes' AS is_illumina, '10x_Genomics' AS lib_prep FROM lineitem""")
def p26(spark, sf):
    ids = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("accession"))
    return metadata_rows(ids, database="sra", is_illumina="yes", lib_prep="10x_Genomics")
