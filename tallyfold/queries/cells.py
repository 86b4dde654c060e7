"""Cells, genes and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C, embed as E
from ..operators.aggregate import agreement, set_recovery
from ..operators.classify import read_models, train_together, write_models
from ..operators.neighbour_graph import neighbour_graph
from ..session import scratch_path
from .registry import COUNTS, counts_long, query, rounded, table


@query("x1_cell_totals", f"""
WITH {COUNTS} SELECT cell_id, round(sum(count), 2) AS umi_count, CAST(count(*) AS BIGINT) AS gene_count FROM counts WHERE count > 0 GROUP BY 1""")
def x1(spark, sf):
    return rounded(C.cell_totals(counts_long(spark, sf)), 2)


@query("x2_cell_filter", f"""
WITH {COUNTS} SELECT cell_id, round(sum(count), 2) AS umi_count, CAST(count(*) AS BIGINT) AS gene_count FROM counts WHERE count > 0 GROUP BY 1
HAVING count(*) > 3 AND sum(count) > 100""")
def x2(spark, sf):
    return rounded(C.passing_cells(C.cell_totals(counts_long(spark, sf)), 3, 100), 2)


NORMAL = f"""{COUNTS}, tt AS (SELECT cell_id, sum(count) AS t FROM counts WHERE count > 0 GROUP BY 1), md AS (SELECT median(t) AS m FROM tt),
nv AS (SELECT cell_id, gene_id, count * m / t AS value FROM counts JOIN tt USING (cell_id), md WHERE count > 0)"""


@query("x3_normalized_counts", f"WITH {NORMAL} SELECT cell_id, gene_id, round(value, 6) AS value FROM nv")
def x3(spark, sf):
    return rounded(C.normalize_counts(counts_long(spark, sf)).select("cell_id", "gene_id", "value"), 6)


@query("x4_log_values", f"WITH {NORMAL} SELECT cell_id, gene_id, round(ln(1 + value), 6) AS value FROM nv")
def x4(spark, sf):
    return rounded(C.log_values(C.normalize_counts(counts_long(spark, sf))).select("cell_id", "gene_id", "value"), 6)


@query("x5_drop_rare_types", """
SELECT o_orderkey AS cell_id, o_custkey AS cell_type FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8)""")
def x5(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("cell_type"))
    return C.drop_rare_types(rows, "cell_type", 8)


def _types(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("cell_type"))


RANKED = f"""{NORMAL}, cl AS (SELECT o_orderkey AS cell_id, o_orderpriority AS grp FROM orders), lv AS (SELECT grp, gene_id, ln(1 + value) AS v FROM nv JOIN cl USING (cell_id)),
sz AS (SELECT grp, count(*) AS n1, (SELECT count(*) FROM cl) - count(*) AS n2 FROM cl GROUP BY 1),
al AS (SELECT gene_id, sum(v) AS s, sum(v * v) AS ss FROM lv GROUP BY 1), gg AS (SELECT grp, gene_id, sum(v) AS s, sum(v * v) AS ss FROM lv GROUP BY 1, 2),
st AS (SELECT sz.grp, al.gene_id, n1, n2, coalesce(gg.s, 0) / n1 AS m1, (al.s - coalesce(gg.s, 0)) / n2 AS m2, coalesce(gg.ss, 0) AS s1, al.ss - coalesce(gg.ss, 0) AS s2
  FROM sz CROSS JOIN al LEFT JOIN gg ON gg.grp = sz.grp AND gg.gene_id = al.gene_id),
sc AS (SELECT grp AS "group", gene_id AS gene, (m1 - m2) / nullif(sqrt(greatest(0, (s1 - n1 * m1 * m1) / (n1 - 1)) / n1 + greatest(0, (s2 - n2 * m2 * m2) / (n2 - 1)) / n2), 0) AS score,
  log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)) AS log_fold_change, m1 AS mean_group, m2 AS mean_rest FROM st)"""


@query("x6_rank_genes", f"""
WITH {RANKED} SELECT "group", gene, round(score, 5) AS score, round(log_fold_change, 4) AS log_fold_change, round(mean_group, 6) AS mean_group, round(mean_rest, 6) AS mean_rest FROM sc""")
def x6(spark, sf):
    out = C.rank_genes(counts_long(spark, sf), _types(spark, sf), "cell_type")
    return out.withColumns({"score": F.round("score", 5), "log_fold_change": F.round("log_fold_change", 4),
                            "mean_group": F.round("mean_group", 6), "mean_rest": F.round("mean_rest", 6)})


# p-values by the continued fraction of the incomplete beta integral, 1500 terms evaluated from the back
P_VALUES = f"""{RANKED}, fr AS (SELECT grp, gene_id, n1, n2, greatest(0, (s1 - n1 * m1 * m1) / (n1 - 1)) / n1 AS w1, greatest(0, (s2 - n2 * m2 * m2) / (n2 - 1)) / n2 AS w2 FROM st),
td AS (SELECT grp, gene_id, score, (w1 + w2) ** 2 / (w1 ** 2 / (n1 - 1) + w2 ** 2 / (n2 - 1)) AS df FROM fr JOIN sc ON sc."group" = grp AND gene = gene_id WHERE score IS NOT NULL),
be AS (SELECT grp, gene_id, df / (df + score * score) >= (df / 2 + 1) / (df / 2 + 2.5) AS near, df / 2 AS h, df / (df + score * score) AS x FROM td),
ab AS (SELECT *, CASE WHEN near THEN 0.5 ELSE h END AS a, CASE WHEN near THEN h ELSE 0.5 END AS b, CASE WHEN near THEN 1 - x ELSE x END AS z FROM be),
cf AS (SELECT grp, gene_id, near, exp(lgamma(h + 0.5) - lgamma(h) - lgamma(0.5) + CASE WHEN z > 0 THEN a * ln(z) + b * ln(1 - z) ELSE -1000 END) / a / list_reduce(
  list_transform(range(1500, 0, -1), lambda k: k::DOUBLE), lambda v, k: 1 + CASE WHEN k % 2 = 1 THEN -(a + (k - 1) / 2) * (a + b + (k - 1) / 2) * z / ((a + k - 1) * (a + k))
  ELSE k / 2 * (b - k / 2) * z / ((a + k - 1) * (a + k)) END / v, 1.0::DOUBLE) AS part FROM ab),
pv AS (SELECT sc."group" AS g, gene, score, coalesce(CASE WHEN near THEN 1 - part ELSE part END, 1) AS p FROM sc LEFT JOIN cf ON sc."group" = grp AND gene = gene_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, gene) AS r, count(*) OVER (PARTITION BY g) AS n FROM pv)"""


@query("x6_gene_p_values", f"""
WITH {P_VALUES} SELECT g AS "group", gene, round(score, 5) AS score, round(p, 6) AS p,
  round(min(least(1, p * n / r)) OVER (PARTITION BY g ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_adjusted FROM rk""")
def x6_p_values(spark, sf):
    out = C.rank_genes(counts_long(spark, sf), _types(spark, sf), "cell_type", p_values=True)
    return out.select("group", "gene", F.round("score", 5).alias("score"), F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"))


@query("x7_top_genes", f"""
WITH {RANKED}, r AS (SELECT "group", gene, score, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, gene) AS rank FROM sc WHERE score IS NOT NULL)
SELECT "group", gene, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200""")
def x7(spark, sf):
    out = C.rank_genes(counts_long(spark, sf), _types(spark, sf), "cell_type", top_n=200)
    return out.select("group", "gene", F.round("score", 5).alias("score"), "rank")


@query("x8_marker_recovery", f"""
WITH {RANKED}, r AS (SELECT "group", gene, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, gene) AS rank FROM sc WHERE score IS NOT NULL),
x AS (SELECT "group" AS g, gene FROM r WHERE rank <= 200), y AS (SELECT DISTINCT o_orderpriority AS g, l_partkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 46),
mk AS (SELECT p AS g, p_partkey AS gene FROM part, (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE p_size > 30),
j AS (SELECT mk.g, x.gene IS NOT NULL AS a, y.gene IS NOT NULL AS b FROM mk LEFT JOIN x ON mk.g = x.g AND mk.gene = x.gene LEFT JOIN y ON mk.g = y.g AND mk.gene = y.gene)
SELECT g AS "group", CAST(count(*) AS BIGINT) AS n_markers, round(count(*) FILTER (WHERE a) / count(*), 6) AS left_fraction, round(count(*) FILTER (WHERE b) / count(*), 6) AS right_fraction,
  round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS shared_fraction, round(coalesce(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0), 0), 6) AS jaccard FROM j GROUP BY 1""")
def x8(spark, sf):
    ranked = C.rank_genes(counts_long(spark, sf), _types(spark, sf), "cell_type", top_n=200)
    other = table(spark, sf, "lineitem").where("l_quantity > 46").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("group"), F.col("l_partkey").alias("gene"))
    groups = F.array(*[F.lit(g) for g in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    markers = table(spark, sf, "part").where("p_size > 30").select(F.explode(groups).alias("group"), F.col("p_partkey").alias("gene"))
    return rounded(set_recovery(ranked.select("group", "gene"), other, markers, "group", "gene"), 6)


@query("x9_combined_datasets", """
SELECT 'a' AS dataset, CAST(o_orderkey AS VARCHAR) AS cell, o_totalprice AS size, 'a_' || o_orderkey AS cell_id FROM orders
UNION ALL SELECT 'b', CAST(c_custkey AS VARCHAR), c_acctbal, 'b_' || c_custkey FROM customer""")
def x9(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("a").alias("dataset"), F.col("o_orderkey").cast("string").alias("cell"), F.col("o_totalprice").alias("size"), "o_orderstatus")
    b = table(spark, sf, "customer").select(F.lit("b").alias("dataset"), F.col("c_custkey").cast("string").alias("cell"), F.col("c_acctbal").alias("size"), "c_name")
    return C.combine_datasets([a, b])


@query("l1_typed_cells", """
SELECT c_custkey, c_mktsegment AS cell_type FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0""")
def l1(spark, sf):
    label = F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return C.clean_types(table(spark, sf, "customer").select("c_custkey", label.alias("cell_type")), "cell_type")


def _embedded(spark, sf):
    """Vectors of two tissues with five cell types each."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("tissue"),
        F.concat(F.lit("type "), F.col("label").cast("string")).alias("cell_type"))


@query("l3_train_per_tissue")
def l3(spark, sf):
    models = E.train_by(_embedded(spark, sf), "tissue", "embedding", "cell_type", max_iter=100)
    rows = [(tissue, label, float(m.bias[i]), float((m.weights[i] ** 2).sum() ** 0.5)) for tissue, m in models.items() for i, label in enumerate(m.labels)]
    return spark.createDataFrame(rows, "tissue string, cell_type string, bias double, weight_norm double")


@query("l4_annotate_cells", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS tissue, 'type ' || label AS cell_type FROM embeddings),
c AS (SELECT tissue, cell_type, list(m ORDER BY i) AS mean FROM (
  SELECT tissue, cell_type, i, avg(e) AS m FROM (SELECT tissue, cell_type, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM v) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT vec_id, v.cell_type, arg_min(c.cell_type, list_distance(x, mean)) AS predicted FROM v JOIN c ON v.tissue = c.tissue GROUP BY 1, 2""")
def l4(spark, sf):
    rows = _embedded(spark, sf)
    models = E.nearest_mean_models(rows, "tissue", "embedding", "cell_type")
    return E.annotate(rows, "tissue", "embedding", models, name="predicted").select("vec_id", "cell_type", "predicted")


@query("l3_train_together")
def l3_together(spark, sf):
    models = train_together(_embedded(spark, sf), "tissue", "embedding", "cell_type")
    path = scratch_path(spark, "models")
    write_models(spark, models, path)
    norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))
    return spark.read.parquet(path).select(F.col("part").alias("tissue"), F.col("label").alias("cell_type"), "bias", norm.alias("weight_norm"))


@query("l4_annotate_trained")
def l4_trained(spark, sf):
    rows, path = _embedded(spark, sf), scratch_path(spark, "models")
    write_models(spark, train_together(rows, "tissue", "embedding", "cell_type"), path)
    return E.annotate(rows, "tissue", "embedding", read_models(spark, path), name="predicted").select("vec_id", "cell_type", "predicted")


@query("l5_integrity_checks", """
SELECT CAST(count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS BIGINT) AS wrong_width,
  CAST((SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS only_left,
  CAST((SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS BIGINT) AS only_right FROM embeddings""")
def l5(spark, sf):
    vectors = table(spark, sf, "embeddings")
    wrong = E.wrong_width(vectors, "embedding", 64).agg(F.count(F.lit(1)).alias("wrong_width"))
    cells = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return E.unmatched_cells(vectors, cells, "vec_id").withColumn("wrong_width", wrong.scalar())


@query("l6_dataset_facts", """
SELECT l_suppkey, organism, tissue, organism = 'Homo sapiens' AS is_human, organism = 'Mus musculus' AS is_mouse FROM (SELECT DISTINCT l_suppkey FROM lineitem)
LEFT JOIN (SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'Homo sapiens' WHEN s_nationkey < 15 THEN 'Mus musculus' ELSE 'other' END AS organism,
  CASE WHEN s_acctbal > 5000 THEN 'lung' END AS tissue FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def l6(spark, sf):
    metadata = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.when(F.col("s_nationkey") < 10, "Homo sapiens").when(F.col("s_nationkey") < 15, "Mus musculus").otherwise("other").alias("organism"),
        F.when(F.col("s_acctbal") > 5000, "Lung tissue").otherwise("elsewhere").alias("tissue"))
    return E.dataset_facts(table(spark, sf, "lineitem"), metadata, "l_suppkey", {"Lung tissue": "lung"})


@query("l7_neighbours", """
WITH d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d)
SELECT id, neighbour, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def l7(spark, sf):
    return rounded(E.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 5))


@query("l7_neighbour_graph")
def l7_graph(spark, sf):
    return rounded(neighbour_graph(table(spark, sf, "embeddings"), "vec_id", "embedding", 5))


@query("l8_silhouette", """
WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) AS d, count(*) AS n
  FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(d / (n - 1)) FILTER (WHERE own = other) AS a, min(d / n) FILTER (WHERE own <> other) AS b FROM p GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM s""")
def l8(spark, sf):
    score = E.silhouette(table(spark, sf, "embeddings"), "embedding", "label")
    return rounded(spark.createDataFrame([(score,)], "silhouette double"))


@query("l9_label_positions", """
SELECT label, round(median(embedding[1]::DOUBLE), 6) AS x, round(median(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY 1""")
def l9(spark, sf):
    points = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(E.label_positions(points, "label", "x", "y"), 6)
