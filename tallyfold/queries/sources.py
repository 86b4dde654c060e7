"""Sources and sinks: the given tables are written in the format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregate import nested_counts
from ..operators.keyed import KeyedTable
from ..operators.merge import update, upsert
from ..plans import runlog
from ..session import scratch_path
from ..sources import files, sinks
from .registry import COUNTS, RUNS, counts_long, datasets, positioned, query, rounded, run_records, table

ORDER_SCHEMA = "o_orderkey bigint, o_orderpriority string, o_totalprice double"
ORDER_SQL = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("s1_delimited_scan", ORDER_SQL)
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_delimited(_orders(spark, sf), path, gzip=True)
    return files.read_delimited(spark, path, ORDER_SCHEMA)


@query("s2_column_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s2(spark, sf):
    return files.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("s3_many_files", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(extra) AS BIGINT) AS n_extra FROM (
  SELECT o_orderpriority, NULL AS extra FROM orders
  UNION ALL SELECT c_mktsegment, c_nationkey FROM customer) GROUP BY 1""")
def s3(spark, sf):
    root = scratch_path(spark, "many")
    sinks.write_parquet(table(spark, sf, "orders").select("o_orderpriority").repartition(6), f"{root}/a")
    other = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("o_orderpriority"), F.col("c_nationkey").alias("extra"))
    sinks.write_parquet(other, f"{root}/b")
    return files.read_many(spark, root, merge_schema=True).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


ROWS_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"""


@query("s4_rows_of_datasets", ROWS_SQL)
def s4(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return files.read_for_ids(spark, f"{sf}/lineitem.parquet", ids, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("s4_rows_of_buckets", ROWS_SQL)
def s4_buckets(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    kept = KeyedTable(spark, scratch_path(spark, "lines"), lines.schema, ["l_orderkey"], 16)
    kept.create(lines)
    return kept.rows_of(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")))


@query("s5_results_with_metadata", """
SELECT l_orderkey AS sample, l_returnflag AS feature, l_linenumber AS part_no, l_quantity AS cells, o_orderpriority AS lib_prep
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE lower(l_returnflag) = 'r' AND o_orderpriority = '1-URGENT'""")
def s5(spark, sf):
    results = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("feature"),
        F.col("l_linenumber").alias("part_no"), F.col("l_quantity").alias("cells"))
    metadata = table(spark, sf, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("lib_prep"))
    return files.sample_results(results, metadata, "r", lib_prep="1-URGENT")


@query("s6_warehouse_lookup", """
SELECT DISTINCT l_orderkey AS experiment, l_suppkey AS project, l_returnflag AS study FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def s6(spark, sf):
    metadata = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("experiment"), F.col("l_suppkey").alias("project"), F.col("l_returnflag").alias("study"))
    return files.projects_of(metadata, table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey"))


@query("s7_census_columns", """
SELECT l_orderkey, l_partkey, l_linenumber, 'Homo sapiens' AS organism FROM lineitem""")
def s7(spark, sf):
    return files.observations(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"], organism="Homo sapiens")


@query("s8_annotated_matrix", f"""
WITH {COUNTS}
SELECT o_orderpriority AS cell_type, p_type AS gene_type, CAST(count(*) AS BIGINT) AS n, round(sum(count), 4) AS total
FROM counts JOIN orders ON cell_id = o_orderkey JOIN part ON gene_id = p_partkey WHERE count > 0 GROUP BY 1, 2""")
def s8(spark, sf):
    root = scratch_path(spark, "matrix")
    sinks.write_parquet(counts_long(spark, sf), f"{root}/counts", sort_by=["cell_id"])
    sinks.write_parquet(table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("cell_type")), f"{root}/obs")
    sinks.write_parquet(table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("gene_type")), f"{root}/var")
    counts, obs, var = files.read_cells(spark, f"{root}/counts", f"{root}/obs", f"{root}/var")
    return rounded(counts.join(obs, "cell_id").join(var, "gene_id").groupBy("cell_type", "gene_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")))


def summary_files(spark, sf):
    """Writes one headerless key,value file per brand and return flag; returns the folder."""
    rows = (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.concat(F.lit("SRX"), F.split("p_brand", "#")[1]).alias("accession"),
                 F.concat(F.lit("Gene"), "l_returnflag").alias("feature"))
        .agg(F.count(F.lit(1)).alias("reads"), F.sum("l_quantity").alias("umis"), F.max("l_extendedprice").alias("peak"))
    )
    values = {
        "Number of Reads": F.col("reads").cast("string"),
        "UMIs in Cells": F.col("umis").cast("bigint").cast("string"),
        "Reads Mapped to Gene Unique": F.format_string("%.2f", F.col("peak")),
        "Saturation": F.when(F.col("reads") % 2 == 0, F.lit("no value")).otherwise(F.lit("0.25")),
    }
    pairs = rows.select("accession", "feature", F.explode(F.array(
        *[F.struct(F.lit(k).alias("category"), v.alias("value")) for k, v in values.items()])).alias("kv")
    ).select("accession", "feature", "kv.category", "kv.value")
    root = scratch_path(spark, "summaries")
    pairs.repartition("accession", "feature").write.partitionBy("accession", "feature").csv(root)
    return root


SUMMARIES = """sm AS (
  SELECT 'SRX' || split_part(p_brand, '#', 2) AS accession, 'Gene' || l_returnflag AS feature,
         count(*) AS reads, sum(l_quantity) AS umis, max(l_extendedprice) AS peak
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query("s9_key_value_files", f"""
WITH {SUMMARIES}
SELECT accession, feature, 'Number of Reads' AS category, CAST(reads AS VARCHAR) AS value FROM sm
UNION ALL SELECT accession, feature, 'UMIs in Cells', CAST(CAST(umis AS BIGINT) AS VARCHAR) FROM sm
UNION ALL SELECT accession, feature, 'Reads Mapped to Gene Unique', printf('%.2f', peak) FROM sm
UNION ALL SELECT accession, feature, 'Saturation', CASE WHEN reads % 2 = 0 THEN 'no value' ELSE '0.25' END FROM sm""")
def s9(spark, sf):
    return files.read_key_values(spark, summary_files(spark, sf), "SRX", "*.csv").drop("path")


def matrix_files(spark, sf):
    """Writes files `SRX<customer nation>/<status>/<raw or filtered>/...`; returns the folder."""
    rows = datasets(spark, sf).select(
        F.concat(F.lit("SRX"), F.split("organism", "_")[1]).alias("accession"), F.col("status").alias("feature"),
        F.when(F.col("tech") < "3", "raw").otherwise("filtered").alias("processing"), "cells")
    root = scratch_path(spark, "matrices")
    rows.repartition("accession", "feature", "processing").write.partitionBy("accession", "feature", "processing").parquet(root)
    return root


@query("s10_file_manifest", """
SELECT DISTINCT 'SRX' || split_part(n_name, '_', 2) AS accession, o_orderstatus AS feature,
       CASE WHEN o_orderpriority < '3' THEN 'raw' ELSE 'filtered' END AS processing, CAST(1 AS BIGINT) AS n_files
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def s10(spark, sf):
    found = files.manifest(spark, matrix_files(spark, sf), "*.parquet", "SRX").where("length > 0")
    return found.groupBy("accession", "feature", "processing").agg(F.count(F.lit(1)).alias("n_files"))


NESTED_SQL = """
SELECT c_mktsegment AS tissue, o_orderpriority AS label, CAST(count(*) AS BIGINT) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


@query("s11_nested_counts", NESTED_SQL)
def s11(spark, sf):
    counted = datasets(spark, sf).groupBy("tissue", "tech", "organism").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "nested")
    counted.select(F.to_json(F.create_map("tissue", F.create_map("tech", "n")))).write.text(path)
    return nested_counts(files.read_nested_counts(spark, path).withColumnRenamed("outer", "tissue"), "tissue", "counts")


@query("s11_whole_files", NESTED_SQL)
def s11_files(spark, sf):
    counted = datasets(spark, sf).groupBy("tissue", "tech").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("tissue").agg(F.map_from_entries(F.collect_list(F.struct("tech", "n"))).alias("counts"))
    path = scratch_path(spark, "files")
    # one object per file, over several lines
    text = F.to_json(F.create_map("tissue", "counts"), {"pretty": "true"})
    maps.select(F.col("tissue").alias("file"), text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = files.read_nested_counts(spark, f"{path}/*", multi_line=True)
    return nested_counts(found.withColumnRenamed("outer", "tissue"), "tissue", "counts")


@query("s12_id_list", """
SELECT 'SRX' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'""")
def s12(spark, sf):
    path = scratch_path(spark, "ids")
    line = F.concat(F.lit(" SRX"), F.col("o_orderkey").cast("string"), F.lit("  "))
    table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", line).when(F.col("o_orderstatus") == "P", F.lit("  "))
        .otherwise(F.concat(F.lit("#"), line)).alias("value")).write.text(path)
    return files.read_id_list(spark, path)


@query("s13_run_records", f"""
WITH {RUNS} SELECT run_id, trace_id, tool_name, duration_seconds, has_error, total_tokens FROM runs""")
def s13(spark, sf):
    records = run_records(spark, sf)
    path = scratch_path(spark, "runs")
    sinks.write_json(records, path)
    flat = runlog.flatten_runs(files.read_runs(spark, path, records.schema))
    return flat.select(F.col("run_id").cast("long"), F.col("trace_id").cast("long"), "tool_name",
                       F.round("duration_seconds", 4).alias("duration_seconds"), "has_error", "total_tokens")


@query("s14_work_list", "SELECT c_mktsegment AS species, c_name AS accession FROM customer")
def s14(spark, sf):
    path = scratch_path(spark, "work")
    sinks.write_delimited(table(spark, sf, "customer").select("c_mktsegment", "c_name", "c_acctbal"), path, "\t")
    return files.read_work_list(spark, path)


@query("s15_run_table", """
SELECT *, CAST(row_number() OVER (ORDER BY name, experiment, run) AS BIGINT) AS position FROM (
  SELECT CASE WHEN p_type = 'PROMO' THEN 'No title available' ELSE p_name || ', lane' END AS name, p_brand AS experiment, p_partkey AS run FROM part)""")
def s15(spark, sf):
    path = scratch_path(spark, "runinfo")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Run"), F.col("p_brand").alias("Experiment"),
        F.when(F.col("p_type") != "PROMO", F.concat("p_name", F.lit(", lane"))).alias("LibraryName"))
    sinks.write_delimited(rows, path)
    return positioned(files.run_table(files.read_delimited(spark, path, "Run bigint, Experiment string, LibraryName string")))


@query("k1_write_delimited", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def k1(spark, sf):
    path = scratch_path(spark, "tsv")
    sinks.write_delimited(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path, "\t", gzip=True)
    return files.read_delimited(spark, path, "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double", "\t")


@query("k2_write_parquet", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def k2(spark, sf):
    path = scratch_path(spark, "sorted")
    sinks.write_parquet(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), path, ["l_orderkey"])
    return spark.read.parquet(path)


@query("k3_write_json", """
SELECT c_mktsegment AS tissue, n_name AS label, CAST(count(*) AS BIGINT) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def k3(spark, sf):
    path = scratch_path(spark, "json")
    counted = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_json(counted.select(F.struct(F.col("c_mktsegment").alias("tissue"), F.col("n_name").alias("label")).alias("key"), "n"), path)
    return spark.read.schema("key struct<tissue string, label string>, n bigint").json(path).select("key.tissue", "key.label", "n")


@query("k4_report", f"""
WITH {RUNS}
SELECT 'runs' AS part, CAST(count(*) AS BIGINT) AS n FROM runs WHERE NOT has_error
UNION ALL SELECT 'performance', CAST(count(DISTINCT tool_name) AS BIGINT) FROM runs WHERE NOT has_error
UNION ALL SELECT 'workflows', CAST(count(DISTINCT trace_id) AS BIGINT) FROM runs WHERE NOT has_error""")
def k4(spark, sf):
    flat = runlog.filter_runs(runlog.flatten_runs(run_records(spark, sf)))
    places = sinks.write_report(
        {"runs": flat, "performance": runlog.run_stats(flat), "workflows": runlog.workflow_summary(flat)}, scratch_path(spark, "report"))
    out = None
    for part, path in places.items():
        rows = spark.read.option("header", True).option("escape", '"').csv(path).select(F.lit(part).alias("part"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _accounts(spark, sf):
    customer = table(spark, sf, "customer")
    base = customer.where("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    incoming = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("balance"),
        F.col("o_orderkey").alias("order_no"))
    return base, incoming


ACCOUNTS = """base AS (SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_mktsegment <> 'BUILDING'),
inc AS (SELECT c_custkey, balance FROM (
  SELECT o_custkey AS c_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS balance,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1)"""


UPSERT_SQL = f"""
WITH {ACCOUNTS}
SELECT coalesce(b.c_custkey, i.c_custkey) AS c_custkey, b.segment, CASE WHEN i.c_custkey IS NOT NULL THEN i.balance ELSE b.balance END AS balance
FROM base b FULL JOIN inc i ON b.c_custkey = i.c_custkey"""


@query("k5_upsert", UPSERT_SQL)
def k5(spark, sf):
    base, incoming = _accounts(spark, sf)
    return upsert(base, incoming, ["c_custkey"], ["order_no"])


UPDATE_SQL = f"""
WITH {ACCOUNTS}
SELECT b.c_custkey, b.segment, CASE WHEN i.c_custkey IS NOT NULL THEN i.balance ELSE b.balance END AS balance
FROM base b LEFT JOIN inc i ON b.c_custkey = i.c_custkey"""


@query("k6_update", UPDATE_SQL)
def k6(spark, sf):
    base, incoming = _accounts(spark, sf)
    return update(base, incoming, ["c_custkey"], ["order_no"])


def _keyed_accounts(spark, base):
    kept = KeyedTable(spark, scratch_path(spark, "accounts"), base.schema, ["c_custkey"], 16)
    kept.create(base)
    return kept


@query("k5_upsert_buckets", UPSERT_SQL)
def k5_buckets(spark, sf):
    base, incoming = _accounts(spark, sf)
    kept = _keyed_accounts(spark, base)
    kept.upsert(incoming, ["order_no"])
    return kept.rows()


@query("k6_update_buckets", UPDATE_SQL)
def k6_buckets(spark, sf):
    base, incoming = _accounts(spark, sf)
    kept = _keyed_accounts(spark, base)
    kept.update(incoming, ["order_no"])
    return kept.rows()


@query("k7_write_per_dataset", """
WITH r AS (SELECT CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS dataset, o_orderstatus FROM orders)
SELECT dataset, CAST(count(*) AS BIGINT) AS n FROM r WHERE dataset IS DISTINCT FROM '5-LOW' GROUP BY 1
UNION ALL SELECT '5-LOW', CAST(count(*) AS BIGINT) FROM r WHERE dataset = '5-LOW' AND o_orderstatus = 'F'""")
def k7(spark, sf):
    path = scratch_path(spark, "datasets")
    named = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select(named.alias("dataset"), "o_orderkey", "o_orderstatus")
    sinks.write_per_dataset(rows.where("dataset = '5-LOW' and o_orderstatus = 'F'"), path, "dataset")
    done = spark.read.parquet(path)
    sinks.write_per_dataset(rows, path, "dataset", done)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
