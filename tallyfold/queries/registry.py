"""Registry of queries and the roles the given tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranked import row_numbers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select([F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def positioned(df: DataFrame) -> DataFrame:
    """Adds `position`, the place of each row in the order that `df` has, so that the order is compared too."""
    return row_numbers(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "position").drop("_at")


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue entries: accession, release date, technology, organism, tissue, cells, status."""
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("accession"), F.col("o_orderdate").alias("release_date"),
            F.col("o_orderpriority").alias("tech"), F.col("n_name").alias("organism"),
            F.col("c_mktsegment").alias("tissue"), F.floor("o_totalprice").alias("cells"),
            F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("collection"),
        )
    )


DATASETS = """ds AS (
  SELECT o_orderkey AS accession, o_orderdate AS release_date, o_orderpriority AS tech, n_name AS organism,
         c_mktsegment AS tissue, CAST(floor(o_totalprice) AS BIGINT) AS cells, o_orderstatus AS status,
         o_custkey AS collection
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def counts_long(spark: SparkSession, sf: str) -> DataFrame:
    """Cells by genes: an order is a cell, a part a gene, the quantity the count."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("count"))


COUNTS = """counts AS (
  SELECT l_orderkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2)"""


def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Run log: a user is a trace, an event a run, its value the duration in seconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"),
        F.lit("tool").alias("run_type"), F.col("ts").cast("timestamp").alias("start_time"),
        F.timestamp_micros(micros).alias("end_time"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        F.from_json("props", "map<string,string>").alias("inputs"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("outputs"),
        F.create_map(F.lit("model"), F.concat(F.lit("m-"), F.col("event_type")), F.lit("temperature"), F.lit("0.5"))
        .alias("invocation_params"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"),
        F.array("event_type").alias("tags"),
        (F.col("event_id") % 1000).alias("total_tokens"), (F.col("event_id") % 700).alias("prompt_tokens"),
        (F.col("event_id") % 300).alias("completion_tokens"),
        F.col("value").alias("prompt_cost"), F.col("value").alias("completion_cost"),
        (F.col("value") * 2).alias("total_cost"),
    )


RUNS = """runs AS (
  SELECT event_id AS run_id, user_id AS trace_id, event_type AS tool_name, ts AS start_time, value AS duration_seconds,
         event_type = 'error' AS has_error, event_id % 1000 AS total_tokens, value * 2 AS total_cost, props FROM events)"""


def ontology_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Terms are parts; each has the parents key/2 and key/3."""
    part = table(spark, sf, "part")
    halves, thirds = (
        part.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / d).alias("parent")) for d in (2, 3))
    return halves.unionByName(thirds)


EDGES = """e AS (
  SELECT DISTINCT child, parent FROM (
    SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part
    UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE child <> parent)"""

# the closure of e as c(src, dst, depth)
CLOSURE = """w(src, dst, d) AS (
  SELECT child, parent, 1 FROM e UNION SELECT w.src, e.parent, w.d + 1 FROM w JOIN e ON w.dst = e.child),
c AS (SELECT src, dst, min(d) AS depth FROM w GROUP BY src, dst)"""
