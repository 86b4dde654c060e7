"""Resumable work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialize, scratch_path
from ..streaming.incremental import VersionedTable, carry_on, follow_files, isolated, pending
from .registry import query, table


def _progress(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(
        F.when(F.max("o_totalprice") > 450000, "failed").otherwise("ok").alias("status"))
    return table(spark, sf, "orders").select("o_custkey"), done


DONE = """dn AS (SELECT o_custkey, CASE WHEN max(o_totalprice) > 450000 THEN 'failed' ELSE 'ok' END AS status FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


@query("m1_pending_keys", f"WITH {DONE} SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM dn WHERE status = 'ok')")
def m1(spark, sf):
    rows, done = _progress(spark, sf)
    return pending(rows, materialize(done, "done"), "o_custkey")


@query("m1_carry_on", f"""
WITH {DONE} SELECT o_custkey, status FROM dn WHERE status = 'ok' UNION ALL
SELECT DISTINCT o_custkey, 'again' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM dn WHERE status = 'ok')""")
def m1b(spark, sf):
    rows, done = _progress(spark, sf)
    path = scratch_path(spark, "results")
    done.write.parquet(path)
    return carry_on(rows, path, done.schema, "o_custkey", lambda todo: todo.withColumn("status", F.lit("again")), chunk_rows=50_000)


@query("m2_follow_files", """
SELECT o_custkey, last_order, priority FROM (SELECT o_custkey, o_orderkey AS last_order, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def m2(spark, sf):
    schema = StructType([StructField("o_custkey", LongType()), StructField("last_order", LongType()), StructField("priority", StringType())])
    target = VersionedTable(spark, scratch_path(spark, "latest"), schema, ["o_custkey"])

    def newest(batch):
        return batch.select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderpriority").alias("priority"),
                            (-F.col("o_orderkey")).alias("newest_first"))

    # two arrivals: the older half of the orders, then the newer one, each followed by a call
    orders, inbox = table(spark, sf, "orders"), scratch_path(spark, "inbox")
    older = F.col("o_orderkey") <= orders.agg(F.max("o_orderkey")).first()[0] // 2
    for arrived in (orders.where(older), orders.where(~older)):
        arrived.write.mode("append").parquet(inbox)
        latest = follow_files(spark, inbox, orders.schema, target, ["newest_first"], prepare=newest)
    return latest


@query("m3_isolated_failures", """
SELECT p_partkey, CASE WHEN p_size <> 13 THEN CAST(split_part(p_brand, '#', 2) AS BIGINT) END AS brand_no, CASE WHEN p_size = 13 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN p_size = 13 THEN 'ValueError: size 13' END AS error FROM part""")
def m3(spark, sf):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["p_size"] == 13).any():
            raise ValueError("size 13")
        return pd.DataFrame({"p_partkey": pdf["p_partkey"], "brand_no": pdf["p_brand"].str.split("#").str[1].astype("int64")})

    schema = StructType([StructField("p_partkey", LongType()), StructField("brand_no", LongType())])
    return isolated(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), work, schema)
