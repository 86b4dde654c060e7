"""Scalar functions, one query per family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from ..operators.embed import cell_identifier, tissue_from_name
from .registry import query, rounded, table


@query("f_case_and_trim", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed, ltrim(p_brand, 'Brand') AS stripped FROM part""")
def case_and_trim(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), F.ltrim("p_brand", F.lit("Brand")).alias("stripped"))


@query("f_split_and_replace", """
SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS first_part, regexp_replace(url, '[0-9]+', '', 'g') AS no_digits, replace(url, 'http', 'ftp') AS swapped FROM pages""")
def split_and_replace(spark, sf):
    parts = F.split("url", "/")
    return table(spark, sf, "pages").select(
        "page_id", parts.getItem(2).alias("host"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("first_part"),
        F.regexp_replace("url", "[0-9]+", "").alias("no_digits"), text.replace_literal("url", "http", "ftp").alias("swapped"))


@query("f_regex_capture", """
SELECT p_partkey, nullif(regexp_extract(p_name, '^(.+) (w[a-z]+)$', 1), '') AS head, nullif(regexp_extract(p_name, '^(.+) (w[a-z]+)$', 2), '') AS tail FROM part""")
def regex_capture(spark, sf):
    pattern = "^(.+) (w[a-z]+)$"
    return table(spark, sf, "part").select(
        "p_partkey", text.capture("p_name", pattern, 1).alias("head"), text.capture("p_name", pattern, 2).alias("tail"))


@query("f_contains_any", """
SELECT doc_id, contains(text, 'and') AS has_and, starts_with(text, 'T') AS starts_t, regexp_matches(text, 'onnx|ough|eau') AS any_of FROM documents""")
def contains_any(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", body.contains("and").alias("has_and"), body.startswith("T").alias("starts_t"), body.rlike("onnx|ough|eau").alias("any_of"))


@query("f_concatenate", """
SELECT c_custkey, concat_ws('_', c_name, c_mktsegment) AS joined, c_name || '_' || c_custkey AS cell_key, concat_ws(';', c_mktsegment, c_nationkey) AS listed FROM customer""")
def concatenate(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws("_", "c_name", "c_mktsegment").alias("joined"),
        F.concat("c_name", F.lit("_"), F.col("c_custkey").cast("string")).alias("cell_key"),
        F.array_join(F.array("c_mktsegment", F.col("c_nationkey").cast("string")), ";").alias("listed"))


@query("f_length_and_cut", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, substring(text, 1, 30) AS cut FROM documents")
def length_and_cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), F.substring("text", 1, 30).alias("cut"))


@query("f_path_parts", """
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, split_part(url, '/', -2) AS folder,
  nullif(regexp_extract(url, '(?:^|/)(?:[^/=]+=)?(en[^/]*)(?:/|$)', 1), '') AS starts_en FROM pages""")
def path_parts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.path_part("url", -1).alias("base"), text.path_part("url", -2).alias("folder"),
        text.path_part_starting("url", "en").alias("starts_en"))


@query("f_date_bins", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
  strftime(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d'), '%Y-%m-%d') AS parsed FROM orders""")
def date_bins(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.period("o_orderdate").alias("year"), dates.period("o_orderdate", "month").cast("string").alias("month"),
        F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("parsed"))


@query("f_date_arithmetic", """
SELECT l_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS days,
  CAST(epoch_us(l_shipdate) - epoch_us(o_orderdate) AS DOUBLE) / 1e6 AS seconds, strftime(l_shipdate - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_arithmetic(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"),
        dates.seconds_between("o_orderdate", "l_shipdate").alias("seconds"),
        F.date_sub("l_shipdate", 7).cast("string").alias("week_before"))


@query("f_math", """
SELECT p_partkey, round(log10(p_retailprice), 6) AS l10, round(log10(p_size + 1), 6) AS l10p, round(ln(1 + p_size), 6) AS l1p,
  round(sqrt(p_size * p_retailprice), 6) AS geo, abs(p_size - 25) AS dist, round(p_retailprice / 1e6, 9) AS millions FROM part""")
def math(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(F.log10(price), 6).alias("l10"), F.round(F.log10(size + 1), 6).alias("l10p"),
        F.round(F.log1p(size), 6).alias("l1p"), F.round(F.sqrt(size * price), 6).alias("geo"),
        F.abs(size - 25).alias("dist"), F.round(price / 1e6, 9).alias("millions"))


@query("f_row_min_max", """
SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 500, NULL) AS high, least(l_quantity, l_tax * 500) AS low FROM lineitem""")
def row_min_max(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", F.greatest(F.col("l_quantity"), F.col("l_discount") * 500, F.lit(None).cast("double")).alias("high"),
        F.least(F.col("l_quantity"), F.col("l_tax") * 500).alias("low"))


@query("f_null_handling", """
SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(CAST(toxic AS VARCHAR), lang) AS combined, quality IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def null_handling(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), "lang").alias("combined"),
        F.col("quality").isNotNull().alias("labelled"))


@query("f_cast_or_null", """
SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS number, TRY_CAST(p_type AS DOUBLE) AS none, CAST(p_retailprice AS BIGINT) AS whole
FROM (SELECT p_partkey, p_brand, p_type, floor(p_retailprice) AS p_retailprice FROM part)""")
def cast_or_null(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", numeric.to_number(F.split("p_brand", "#")[1]).alias("number"), numeric.to_number("p_type").alias("none"),
        numeric.to_count("p_retailprice").alias("whole"))


@query("f_arrays", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_type]))), ',') AS merged,
  len(list_intersect(string_split(p_name, ' '), ['red', 'small', 'ring'])) AS common FROM part""")
def arrays(spark, sf):
    words = F.split("p_name", " ")
    wanted = F.array(F.lit("red"), F.lit("small"), F.lit("ring"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.sort_array(F.array_union(words, F.array("p_type"))), ",").alias("merged"),
        F.size(F.array_intersect(words, wanted)).cast("bigint").alias("common"))


@query("f_maps_and_json", """
SELECT event_id, array_to_string(json_keys(props), ',') AS keys, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  coalesce(json_extract_string(props, '$.missing'), event_type) AS fallback, '{"type":"' || event_type || '","user":' || user_id || '}' AS dumped FROM events""")
def maps_and_json(spark, sf):
    parsed = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select(
        "event_id", F.array_join(F.map_keys(parsed), ",").alias("keys"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing"), "event_type").alias("fallback"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("dumped"))


@query("f_sizes_and_percent", """
SELECT o_orderkey, CASE WHEN b = 0 THEN '0B' WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE)
  WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS size,
  round(b / 7.0::DOUBLE, 3) AS rounded FROM (SELECT o_orderkey, CAST(floor(o_totalprice * o_orderkey) AS BIGINT) AS b FROM orders)""")
def sizes_and_percent(spark, sf):
    size = F.floor(F.col("o_totalprice") * F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", text.size_text(size).alias("size"), F.round(size / 7.0, 3).alias("rounded"))


@query("f_percent_text", """
SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_discount * 100) AS shown FROM lineitem""")
def percent(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.percent_text("l_discount").alias("shown"))


@query("l2_cell_identifiers", """
SELECT o_orderkey, replace(replace('TSP' || o_custkey || '_Lung' || o_orderkey || '_S12_x_GeneFull_Ex50pAS', '_S12_', '_'), '_GeneFull_Ex50pAS', '') || '_' || o_orderkey AS identifier, 'lung' AS tissue FROM orders""")
def cell_identifiers(spark, sf):
    name = F.concat(F.lit("TSP"), F.col("o_custkey").cast("string"), F.lit("_Lung"), F.col("o_orderkey").cast("string"), F.lit("_S12_x_GeneFull_Ex50pAS"))
    rows = table(spark, sf, "orders").select("o_orderkey", name.alias("dataset"), F.col("o_orderkey").cast("string").alias("barcode"))
    return rows.select("o_orderkey", cell_identifier("dataset", "barcode").alias("identifier"), tissue_from_name("dataset").alias("tissue"))
