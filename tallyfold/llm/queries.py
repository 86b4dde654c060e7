"""The operators as queries over the given tables, with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path
from . import centroids, chat, decontaminate, merkle, packing, pii, placement, quality, simhash, suffix_tree, topk, url_rules, warc
from .common import crc_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def byte_bpe() -> str:
    """Contents of the public byte-level tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@query("op1_warc_revisits")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf, "pages"), path)
    records = materialize(warc.read_archive(spark, path, with_payload=False).drop("payload"), "records")
    return warc.join_originals(records).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


@query("op2_quality_scores")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), crc_of("doc_id") % 3 == 1
    weights = quality.train(docs, table(spark, sf, "labels").where(~held_out))
    return quality.score(docs, weights).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Verdicts by host and path; any other URL is allowed.
URL_RULES = [url_rules.Rule("net/", "block"), url_rules.Rule("example.net/en/", "allow"),
             url_rules.Rule("example.com/de/", "block"), url_rules.Rule("org/fr/", "allow")]


@query("op3_url_verdicts", """
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge(table(spark, sf, "pages"), URL_RULES, keep=("page_id",))


@query("op4_sum_of_squares_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Shards of the placement query.
SHARDS = [f"shard-{i:03d}" for i in range(256)]


@query("op5_shard_placement")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return placement.place(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op6_suffix_tree_scores")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), crc_of("doc_id") % 10 == 0
    tree = suffix_tree.grow(docs, ~held_out)
    return suffix_tree.score(docs, tree).withColumn("held_out", crc_of("doc_id") % 10 == 0)


@query("op7_simhash_components")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf, "documents")).select(
        "doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op8_chat_round_trip")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    formatted = materialize(chat.format_turns(turns.unionByName(extra)), "formatted")
    return chat.digests(formatted)


@query("op9_benchmark_passages")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_top_products")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_products(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@query("op11_personal_data")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in pii.KINDS], "base_sha256", "spans", "n_added")


@query("op12_centroid_clusters", centroids.cluster_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings"))


@query("op13_merkle_manifest", merkle.MANIFEST_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered=tampered,
                           changes={"n_chars": F.try_add(F.col("n_chars"), F.lit(1))})
