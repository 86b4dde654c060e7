"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.aggregate import recovered_fraction, with_group_total
from ..operators.cells import align_cells, cell_totals, coverage
from ..operators.grid import key_grid
from ..operators.sketches import id_sketches, merged_sketches, sketch_overlap
from ..plans.catalogues import last_lookup
from .registry import COUNTS, DATASETS, counts_long, datasets, query, rounded, table


@query("j1_inner_join", f"WITH {DATASETS} SELECT accession, tech, organism, tissue, cells FROM ds")
def j1(spark, sf):
    return datasets(spark, sf).select("accession", "tech", "organism", "tissue", "cells")


@query("j2_lookup_with_default", """
SELECT p_partkey, coalesce(t.category, 'unknown') AS category FROM part
LEFT JOIN (SELECT p_type, min(p_brand) AS category FROM part WHERE p_size > 48 AND p_type <> 'PROMO' GROUP BY 1) t ON part.p_type = t.p_type""")
def j2(spark, sf):
    part = table(spark, sf, "part")
    lookup = part.where("p_size > 48 and p_type <> 'PROMO'").groupBy("p_type").agg(F.min("p_brand").alias("category"))
    return J.lookup_join(part.select("p_partkey", "p_type"), lookup, "p_type", {"category": "unknown"}).select("p_partkey", "category")


@query("j3_keep_all_datasets", """
SELECT l_orderkey, l_linenumber, s_name, n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0
RIGHT JOIN lineitem ON l_suppkey = s_suppkey""")
def j3(spark, sf):
    resolved = table(spark, sf, "nation").join(
        table(spark, sf, "supplier").where("s_acctbal > 0"), F.col("s_nationkey") == F.col("n_nationkey"))
    return table(spark, sf, "lineitem").join(resolved, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "l_orderkey", "l_linenumber", "s_name", "n_name")


@query("j4_semi_join", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def j4(spark, sf):
    ids = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.keep_in(table(spark, sf, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("j5_anti_join", """
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 400000)""")
def j5(spark, sf):
    ids = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.drop_in(table(spark, sf, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("j6_left_join_is_null", """
SELECT DISTINCT p_partkey AS sample FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) ON p_partkey = l_partkey WHERE l_partkey IS NULL""")
def j6(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("sample"))
    return J.drop_in(table(spark, sf, "part").select(F.col("p_partkey").alias("sample")), done, "sample")


@query("j7_composite_key", """
SELECT l_orderkey, l_linenumber, top FROM lineitem JOIN (
  SELECT l_returnflag AS f, l_suppkey AS s, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2) ON l_returnflag = f AND l_suppkey = s""")
def j7(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_extendedprice")
    best = line.groupBy("l_returnflag", "l_suppkey").agg(F.max("l_extendedprice").alias("top"))
    return line.join(best, ["l_returnflag", "l_suppkey"]).select("l_orderkey", "l_linenumber", "top")


@query("j8_suffixed_reconcile", """
SELECT doc_id, d.n_chars AS n_chars_a, l.n_chars AS n_chars_b, lang_a, lang_b FROM
  (SELECT doc_id, n_chars, lang AS lang_a FROM documents) d
  JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS n_chars, CAST(toxic AS VARCHAR) AS lang_b FROM labels) l USING (doc_id)""")
def j8(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    b = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("n_chars"), F.col("toxic").cast("string").alias("lang"))
    return J.unambiguous_join(a, b, ["doc_id"], ("_a", "_b"))


@query("j9_many_to_many_terms", f"""
WITH {DATASETS}, l AS (SELECT collection, tech AS term, count(*) AS n FROM ds GROUP BY 1, 2),
r AS (SELECT o_custkey AS collection, CASE WHEN l_returnflag = 'A' THEN '1-URGENT' WHEN l_returnflag = 'N' THEN '2-HIGH' ELSE '3-MEDIUM' END AS term, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
pairs AS (SELECT l.collection, l.term AS a, sum(l.n * r.n) FILTER (WHERE l.term <> r.term) AS d FROM l JOIN r USING (collection) GROUP BY 1, 2)
SELECT f.collection, f.term, CAST(f.ln AS BIGINT) AS left_rows, CAST(f.rn AS BIGINT) AS right_rows, CAST(coalesce(d, 0) AS BIGINT) AS differing_pairs FROM (
  SELECT coalesce(l.collection, r.collection) AS collection, coalesce(l.term, r.term) AS term, coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn
  FROM l FULL JOIN r ON l.collection = r.collection AND l.term = r.term) f
LEFT JOIN pairs p ON f.collection = p.collection AND f.term = p.a
WHERE f.collection IN (SELECT collection FROM l) AND f.collection IN (SELECT collection FROM r)""")
def j9(spark, sf):
    left = datasets(spark, sf).select("collection", F.col("tech").alias("term"))
    right = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("collection"),
        F.when(F.col("l_returnflag") == "A", "1-URGENT").when(F.col("l_returnflag") == "N", "2-HIGH").otherwise("3-MEDIUM").alias("term"))
    return J.term_differences(left, right, "collection", "term")


@query("j10_key_grid", """
SELECT a.tech, b.year, c.segment FROM (SELECT DISTINCT o_orderpriority AS tech FROM orders) a,
  (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) b, (SELECT DISTINCT c_mktsegment AS segment FROM customer) c""")
def j10(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "full").select(
        F.col("o_orderpriority").alias("tech"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("segment"))
    return key_grid(rows, ["tech", "year", "segment"]).where("tech is not null and year is not null")


def _cell_tables(spark, sf):
    embedded = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        J.composed_key(["o_custkey", "o_orderkey"]).alias("cell_id"), "o_totalprice")
    types = table(spark, sf, "orders").select(J.composed_key(["o_custkey", "o_orderkey"]).alias("cell_id"), F.col("o_orderpriority").alias("cell_type"))
    totals = cell_totals(counts_long(spark, sf)).join(table(spark, sf, "orders"), F.col("cell_id") == F.col("o_orderkey")).select(
        J.composed_key(["o_custkey", "o_orderkey"]).alias("cell_id"), "umi_count")
    return embedded, types, totals


ALIGNED = f"""{COUNTS}, t AS (SELECT cell_id, sum(count) AS umi FROM counts WHERE count > 0 GROUP BY 1),
a AS (SELECT o_custkey || '_' || o_orderkey AS cell_id, o_orderpriority AS cell_type, umi FROM orders JOIN t ON cell_id = o_orderkey WHERE o_orderstatus <> 'P')"""


@query("j11_cell_alignment", f"WITH {ALIGNED} SELECT cell_id, cell_type, round(umi, 4) AS umi_count FROM a")
def j11(spark, sf):
    return rounded(align_cells(*_cell_tables(spark, sf)).select("cell_id", "cell_type", "umi_count"))


@query("j11_alignment_coverage", f"""
WITH {ALIGNED} SELECT CAST((SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS BIGINT) AS n_embedded, CAST(count(*) AS BIGINT) AS n_aligned,
  round(count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P'), 4) AS coverage FROM a""")
def j11b(spark, sf):
    tables = _cell_tables(spark, sf)
    return rounded(coverage(tables[0], align_cells(*tables)))


def _markers(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("group"), F.col("p_partkey").alias("gene"))


@query("j12_marker_lookup", """
SELECT p_type AS "group", CAST(count(DISTINCT p_partkey) AS BIGINT) AS n_markers,
  CAST(count(DISTINCT CASE WHEN l_partkey IS NOT NULL THEN p_partkey END) AS BIGINT) AS n_found,
  round(count(DISTINCT CASE WHEN l_partkey IS NOT NULL THEN p_partkey END) / count(DISTINCT p_partkey), 4) AS fraction
FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50) ON p_partkey = l_partkey GROUP BY 1""")
def j12(spark, sf):
    ranked = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("gene")).join(_markers(spark, sf), "gene")
    return rounded(recovered_fraction(ranked, _markers(spark, sf), "group", "gene"))


@query("j13_group_total", """
SELECT l_orderkey, l_linenumber, round(t, 4) AS total FROM lineitem JOIN (SELECT l_suppkey AS s, sum(l_quantity) AS t FROM lineitem GROUP BY 1) ON l_suppkey = s""")
def j13(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return rounded(with_group_total(line, ["l_suppkey"], "l_quantity", "total").select("l_orderkey", "l_linenumber", "total"))


@query("j14_label_or_unknown", """
SELECT coalesce(s_name, 'unknown') AS label, CAST(count(*) AS BIGINT) AS n, CAST(count(s_name) AS BIGINT) AS n_found
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) ON l_suppkey = s_suppkey GROUP BY 1""")
def j14(spark, sf):
    terms = table(spark, sf, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"))
    found = J.lookup_join(rows, terms, "id", {"label": "unknown"})
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != "unknown").alias("n_found"))


@query("j15_last_row_wins", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def j15(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return last_lookup(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("u1_union_by_name", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def u1(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_intersection", """
SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT l_partkey FROM lineitem""")
def u2(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return ids.intersect(table(spark, sf, "orders").select("o_custkey")).intersect(table(spark, sf, "lineitem").select("l_partkey"))


@query("u2_sketch_overlap", """
WITH a AS (SELECT DISTINCT l_returnflag AS flag, l_partkey AS id FROM lineitem WHERE l_quantity > 47),
b AS (SELECT DISTINCT l_returnflag AS flag, l_partkey AS id FROM lineitem WHERE l_quantity < 4),
j AS (SELECT coalesce(a.flag, b.flag) AS flag, a.id AS x, b.id AS y FROM a FULL JOIN b ON a.flag = b.flag AND a.id = b.id)
SELECT flag, CAST(count(x) AS BIGINT) AS n_left, CAST(count(y) AS BIGINT) AS n_right, CAST(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS n_shared,
  CAST(count(*) AS BIGINT) AS n_union, round(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*), 6) AS jaccard FROM j GROUP BY 1""")
def u2_sketches(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year"), "l_partkey", "l_quantity")
    sides = [id_sketches(lines.where(w), ["flag", "year"], "l_partkey") for w in ("l_quantity > 47", "l_quantity < 4")]
    return rounded(sketch_overlap(*[merged_sketches(s, ["flag"]) for s in sides], ["flag"]), 6)


@query("u3_gap_both_ways", """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' WHEN a.id IS NULL THEN 'right' ELSE 'both' END AS found_in
FROM (SELECT DISTINCT o_custkey AS id FROM orders) a FULL JOIN (SELECT DISTINCT l_partkey AS id FROM lineitem) b ON a.id = b.id""")
def u3(spark, sf):
    return J.id_gap(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")), "id")


@query("u4_label_union", "SELECT lang AS label FROM documents UNION SELECT source FROM documents UNION SELECT event_type FROM events")
def u4(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("lang").alias("label")).union(docs.select("source")).union(table(spark, sf, "events").select("event_type")).distinct()
