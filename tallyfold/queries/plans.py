"""Whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.grid import complete
from ..operators.cells import dataset_gate, gated_cells, retained_fractions
from ..plans import catalogues, labels, runlog, trends
from .registry import DATASETS, RUNS, datasets, query, rounded, run_records, table
from .sources import SUMMARIES, summary_files
from ..sources.files import read_key_values

GRID = """s AS (SELECT CAST(year(release_date) AS INTEGER) AS period, {by}, sum(cells) AS cells FROM ds GROUP BY 1, 2),
g AS (SELECT p.period, o.{by}, CAST(coalesce(cells, 0) AS BIGINT) AS cells FROM (SELECT DISTINCT period FROM s) p
      CROSS JOIN (SELECT DISTINCT {by} FROM s) o LEFT JOIN s ON s.period = p.period AND s.{by} = o.{by})"""


@query("c1_complete_grid", """
WITH s AS (SELECT o_custkey AS collection, o_orderpriority AS tech, o_orderstatus AS status, sum(o_totalprice) AS cells, max(o_totalprice) AS peak FROM orders GROUP BY 1, 2, 3)
SELECT a.collection, b.tech, c.status, round(coalesce(cells, 0), 2) AS cells, round(coalesce(peak, 0), 2) AS peak FROM (SELECT DISTINCT collection FROM s) a
CROSS JOIN (SELECT DISTINCT tech FROM s) b CROSS JOIN (SELECT DISTINCT status FROM s) c
LEFT JOIN s ON s.collection = a.collection AND s.tech = b.tech AND s.status = c.status""")
def c1(spark, sf):
    sums = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("collection"), F.col("o_orderpriority").alias("tech"), F.col("o_orderstatus").alias("status")).agg(
        F.sum("o_totalprice").alias("cells"), F.max("o_totalprice").alias("peak"))
    return rounded(complete(sums, ["collection", "tech", "status"]), 2)


@query("c1_complete_chosen_columns", """
WITH s AS (SELECT l_suppkey AS s, l_quantity AS q, sum(l_extendedprice) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1, 2)
SELECT x.s, y.q, round(coalesce(a, -1), 2) AS a, round(b, 4) AS b FROM (SELECT DISTINCT s FROM s) x CROSS JOIN (SELECT DISTINCT q FROM s) y LEFT JOIN s ON s.s = x.s AND s.q = y.q""")
def c1b(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q")).agg(
        F.sum("l_extendedprice").alias("a"), F.sum("l_tax").alias("b"))
    out = complete(sums, ["s", "q"], fill_cols={"a": -1})
    return out.withColumns({"a": F.round("a", 2), "b": F.round("b", 4)})


@query("c2_cumulative_trend", f"""
WITH {DATASETS}, {GRID.format(by="tech")}, c AS (SELECT *, CAST(sum(cells) OVER (PARTITION BY tech ORDER BY period) AS BIGINT) AS cumulative FROM g)
SELECT period, tech, cells, cumulative FROM c UNION ALL SELECT period, 'Total', CAST(sum(cells) AS BIGINT), CAST(sum(cumulative) AS BIGINT) FROM c GROUP BY 1""")
def c2(spark, sf):
    return trends.cumulative_trend(datasets(spark, sf), "release_date", "tech", "cells", total_label="Total")


@query("c2_top_organisms", f"""
WITH {DATASETS}, {GRID.format(by="organism")}, c AS (SELECT *, CAST(sum(cells) OVER (PARTITION BY organism ORDER BY period) AS BIGINT) AS cumulative FROM g),
t AS (SELECT organism FROM c WHERE organism <> 'NATION_4' GROUP BY 1 ORDER BY sum(cumulative) DESC, organism LIMIT 10)
SELECT period, organism, cells, cumulative FROM c WHERE organism IN (SELECT organism FROM t)""")
def c2b(spark, sf):
    return trends.cumulative_trend(datasets(spark, sf), "release_date", "organism", "cells", top_n=10, rank_on="cumulative", exclude=["NATION_4"])


@query("c2_monthly_trend", f"""
WITH {DATASETS}, s AS (SELECT date_trunc('month', release_date) AS period, tissue, sum(cells) AS cells FROM ds GROUP BY 1, 2),
g AS (SELECT p.period, o.tissue, coalesce(cells, 0) AS cells FROM (SELECT DISTINCT period FROM s) p CROSS JOIN (SELECT DISTINCT tissue FROM s) o LEFT JOIN s USING (period, tissue))
SELECT strftime(period, '%Y-%m-%d') AS period, tissue, CAST(cells AS BIGINT) AS cells, CAST(sum(cells) OVER (PARTITION BY tissue ORDER BY period) AS BIGINT) AS cumulative FROM g""")
def c2c(spark, sf):
    out = trends.cumulative_trend(datasets(spark, sf), "release_date", "tissue", "cells", period="month")
    return out.withColumn("period", F.col("period").cast("string"))


@query("c3_proportion_trend", f"""
WITH {DATASETS}, {GRID.format(by="tissue")}, h AS (SELECT *, cells / sum(cells) OVER (PARTITION BY period) AS share FROM g)
SELECT period, tissue, cells, round(share, 6) AS share, round((share / lag(share) OVER (PARTITION BY tissue ORDER BY period) - 1) * 100, 4) AS change_percent FROM h""")
def c3(spark, sf):
    out = trends.proportion_trend(datasets(spark, sf), "release_date", "tissue", "cells")
    return out.withColumns({"share": F.round("share", 6), "change_percent": F.round("change_percent", 4)})


@query("c3_top_share_years", f"""
WITH {DATASETS}, {GRID.format(by="organism")}, h AS (SELECT *, cells / sum(cells) OVER (PARTITION BY period) AS share FROM g),
t AS (SELECT organism FROM h GROUP BY 1 ORDER BY sum(share) DESC, organism LIMIT 10)
SELECT period, organism, cells, round(share, 6) AS share FROM h WHERE organism IN (SELECT organism FROM t) AND period IN (1996, 2000)""")
def c3b(spark, sf):
    return rounded(trends.top_share_trend(datasets(spark, sf), "release_date", "organism", "cells", 10, [1996, 2000]).drop("change_percent"), 6)


def _two(spark, sf):
    nation = table(spark, sf, "nation")
    ours = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("tissue"), F.col("c_acctbal").alias("cells"))
    theirs = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("tissue"), F.col("s_acctbal").alias("cells"))
    return {"ours": ours, "theirs": theirs}


@query("c4_compare_catalogues", """
WITH u AS (SELECT n_name AS tissue, 'ours' AS catalogue, sum(c_acctbal) AS cells FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
  UNION ALL SELECT n_name, 'theirs', sum(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
t AS (SELECT tissue FROM u GROUP BY 1 ORDER BY max(cells) DESC, tissue LIMIT 20),
g AS (SELECT t.tissue, k.catalogue, coalesce(cells, 0) AS cells FROM t CROSS JOIN (SELECT DISTINCT catalogue FROM u) k LEFT JOIN u ON u.tissue = t.tissue AND u.catalogue = k.catalogue)
SELECT tissue, catalogue, round(cells, 2) AS cells, round(cells / 1e6, 8) AS scaled FROM g""")
def c4(spark, sf):
    out = catalogues.compare_catalogues(_two(spark, sf), ["tissue"], "cells", top_n=20, scale=1e6)
    return out.select("tissue", "catalogue", F.round("cells", 2).alias("cells"), F.round("scaled", 8).alias("scaled"))


def _cells(spark, sf):
    """Cells with counts, their species and dataset; an order is a cell."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.sum("l_quantity").alias("umi_count"), F.count(F.lit(1)).alias("gene_count"))
    return line.join(datasets(spark, sf), F.col("cell_id") == F.col("accession")).select(
        "cell_id", "umi_count", "gene_count", F.col("organism").alias("species"), F.col("collection").alias("dataset"))


QC = f"""{DATASETS}, n AS (SELECT l_orderkey AS cell_id, sum(l_quantity) AS umi_count, count(*) AS gene_count FROM lineitem GROUP BY 1),
k AS (SELECT cell_id, umi_count, gene_count, organism AS species, collection AS dataset FROM n JOIN ds ON cell_id = accession),
q AS (SELECT species, dataset, count(*) AS n_cells FROM k WHERE gene_count > 2 AND umi_count > 60 GROUP BY 1, 2)"""
LIMITS = {"min_genes": 2, "min_umis": 60, "min_cells": 7}


@query("c5_dataset_gate", f"WITH {QC} SELECT species, dataset, CAST(n_cells AS BIGINT) AS n_cells, n_cells >= 7 AS passes FROM q")
def c5(spark, sf):
    return dataset_gate(_cells(spark, sf), ["species", "dataset"], **LIMITS)


@query("c5_gated_cells", f"""
WITH {QC} SELECT cell_id, round(umi_count, 2) AS umi_count, CAST(gene_count AS BIGINT) AS gene_count FROM k
WHERE gene_count > 2 AND umi_count > 60 AND (species, dataset) IN (SELECT species, dataset FROM q WHERE n_cells >= 7)""")
def c5b(spark, sf):
    return gated_cells(_cells(spark, sf), ["species", "dataset"], **LIMITS).select("cell_id", F.round("umi_count", 2).alias("umi_count"), "gene_count")


@query("c5_retained_fractions", f"""
WITH {QC} SELECT CAST(count(*) AS BIGINT) AS n_datasets, CAST(count(*) FILTER (WHERE n_cells >= 7) AS BIGINT) AS n_passing,
  CAST(coalesce(sum(n_cells) FILTER (WHERE n_cells >= 7), 0) AS BIGINT) AS n_cells, round(count(*) FILTER (WHERE n_cells >= 7) / count(*), 6) AS datasets_kept,
  round(coalesce(sum(n_cells) FILTER (WHERE n_cells >= 7), 0) / (SELECT count(*) FROM k), 6) AS cells_kept FROM q""")
def c5c(spark, sf):
    return rounded(retained_fractions(_cells(spark, sf), ["species", "dataset"], **LIMITS), 6)


FILE_CODES = [(float(i + 1), step, name) for i, (step, name) in enumerate(
    sorted({(p, f) for (_, p), names in catalogues.REQUIRED_FILES.items() for f in names}))]


def _manifest(spark, sf):
    """A supplier is an accession, a return flag a feature; a line's quantity tells which file it stands for."""
    codes = spark.createDataFrame(FILE_CODES, "l_quantity double, processing string, file string")
    return table(spark, sf, "lineitem").join(codes, "l_quantity").select(
        F.concat(F.lit("SRX"), F.col("l_suppkey").cast("string")).alias("accession"),
        F.when(F.col("l_returnflag") == "A", "Velocyto").otherwise(F.col("l_returnflag")).alias("feature"), "processing", "file")


def _manifest_sql() -> str:
    codes = ", ".join(f"({c}, '{p}', '{f}')" for c, p, f in FILE_CODES)
    required = ", ".join(f"('{k}', '{p}', '{f}')" for (k, p), names in catalogues.REQUIRED_FILES.items() for f in names)
    return f"""fl(q, processing, file) AS (VALUES {codes}), rq(rule, processing, file) AS (VALUES {required}),
mf AS (SELECT 'SRX' || l_suppkey AS accession, CASE WHEN l_returnflag = 'A' THEN 'Velocyto' ELSE l_returnflag END AS feature, processing, file
  FROM lineitem JOIN fl ON l_quantity = q),
ms AS (SELECT x.accession, x.feature, rq.processing, rq.file FROM (SELECT DISTINCT accession, feature FROM mf) x
  JOIN rq ON rule = CASE WHEN feature = 'Velocyto' THEN feature ELSE '*' END ANTI JOIN mf ON mf.accession = x.accession AND mf.feature = x.feature AND mf.processing = rq.processing AND mf.file = rq.file)"""


@query("c6_missing_files", f"WITH {_manifest_sql()} SELECT * FROM ms")
def c6(spark, sf):
    return catalogues.missing_files(_manifest(spark, sf), catalogues.required_files(spark))


@query("c6_complete_datasets", f"WITH {_manifest_sql()} SELECT DISTINCT accession, feature FROM mf ANTI JOIN ms USING (accession, feature)")
def c6b(spark, sf):
    return catalogues.complete_datasets(_manifest(spark, sf), catalogues.required_files(spark))


#: Categories of the summary files that `summary_files` writes.
SUMMARY_NAMES = ("Number of Reads", "Reads Mapped to feature Unique", "Saturation", "UMIs in Cells")


@query("c7_result_table", f"""
WITH {SUMMARIES} SELECT accession AS sample, feature, CAST(reads AS BIGINT) AS number_of_reads, CAST(CAST(umis AS BIGINT) AS BIGINT) AS umis_in_cells,
  CAST(printf('%.2f', peak) AS DOUBLE) AS reads_mapped_to_feature_unique, CASE WHEN reads % 2 = 0 THEN NULL ELSE 0.25::DOUBLE END AS saturation
FROM sm WHERE accession IN (SELECT 'SRX' || split_part(p_brand, '#', 2) FROM part WHERE p_size = 50)""")
def c7(spark, sf):
    pairs = read_key_values(spark, summary_files(spark, sf), "SRX", "*.csv")
    ready = table(spark, sf, "part").where("p_size = 50").select(F.concat(F.lit("SRX"), F.split("p_brand", "#")[1]).alias("accession"))
    return catalogues.result_table(pairs, ready, SUMMARY_NAMES)


@query("c8_gap_report", """
WITH f AS (SELECT l_returnflag AS feature, l_orderkey AS accession FROM lineitem), o AS (SELECT DISTINCT feature, accession FROM f),
r AS (SELECT DISTINCT l_orderkey AS accession, l_returnflag AS feature FROM lineitem WHERE l_quantity > 20)
SELECT feature, CAST((SELECT count(*) FROM f WHERE f.feature = x.feature) AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS n_datasets,
  CAST(count(*) FILTER (WHERE accession NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS BIGINT) AS n_without_metadata,
  CAST(count(*) FILTER (WHERE (accession, feature) NOT IN (SELECT accession, feature FROM r)) AS BIGINT) AS n_without_results,
  CAST((SELECT count(*) FROM (SELECT accession FROM f WHERE f.feature = x.feature GROUP BY 1 HAVING count(*) >= 2)) AS BIGINT) AS n_duplicated
FROM o x GROUP BY feature""")
def c8(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_orderkey").alias("accession"), "l_quantity")
    metadata = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("accession"))
    return catalogues.gap_report(line, metadata, line.where("l_quantity > 20"))


def _diseases(spark, sf):
    """A document is a data set, its source the disease text; ids come from the languages seen with it."""
    docs = table(spark, sf, "documents")
    text = F.when(F.col("n_chars") < 300, F.concat(F.lit("Normal "), "source")).when(F.col("n_chars") > 1000, F.col("source"))
    data = docs.select(F.col("doc_id").alias("accession"), "lang", text.alias("disease"))
    pairs = docs.select(F.col("source").alias("disease"), "lang").distinct()
    wide = pairs.groupBy("disease").agg(F.array_join(F.sort_array(F.collect_set("lang")), " ; ").alias("ids"))
    clusters = docs.select(F.col("lang").alias("node_id")).distinct().withColumn("cluster_id", F.length("node_id") + F.ascii("node_id") % 5)
    return data, wide, clusters


DISEASES = """dd AS (SELECT doc_id AS accession, lang, CASE WHEN n_chars < 300 THEN 'Normal ' || source WHEN n_chars > 1000 THEN source END AS disease FROM documents),
pr AS (SELECT DISTINCT source AS disease, lang FROM documents), mi AS (SELECT disease, count(*) > 1 AS multi_id FROM pr GROUP BY 1),
cl AS (SELECT DISTINCT lang AS node_id, CAST(length(lang) + ascii(lang) % 5 AS INTEGER) AS cluster_id FROM documents)"""


def _names_sql() -> str:
    return "nm(cluster_id, cluster_name) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in labels.CLUSTER_NAMES.items()) + ")"


@query("c9_label_resolution", f"""
WITH {DISEASES}, {_names_sql()}, rs AS (SELECT pr.disease, multi_id, node_id, cl.cluster_id, cluster_name FROM pr JOIN mi USING (disease) JOIN cl ON lang = node_id JOIN nm ON nm.cluster_id = cl.cluster_id)
SELECT accession, lang, dd.disease, node_id, multi_id, CAST(CASE WHEN h THEN 10 ELSE cluster_id END AS INTEGER) AS cluster_id, CASE WHEN h THEN 'Healthy' ELSE cluster_name END AS cluster_name
FROM (SELECT *, coalesce(regexp_matches(lower(disease), 'healthy|normal|control|wild-type|wild type|wildtype|none|not reported|not specified'), false) AS h FROM dd) dd
LEFT JOIN rs ON rs.disease = dd.disease WHERE h OR cluster_id IS NOT NULL""")
def c9(spark, sf):
    data, terms, clusters = _diseases(spark, sf)
    return labels.resolve_labels(data, terms, clusters, labels.cluster_names(spark))


@query("c9_term_abundance", """
SELECT lang AS node, CAST(count(*) AS BIGINT) AS abundance FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1""")
def c9b(spark, sf):
    return labels.term_abundance(_diseases(spark, sf)[1], "ids")


@query("c10_tag_counts", """
WITH x AS (SELECT unnest(string_split(replace(p_name, ' ', ', ') || CASE WHEN p_size < 5 THEN ',' ELSE '' END, ',')) AS t FROM part),
n AS (SELECT CASE WHEN trim(t) = '' THEN 'unknown' ELSE trim(t) END AS tag, count(*) AS n FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT tag, CAST(n AS BIGINT) AS n, coalesce(l.label, 'unknown') AS label FROM n LEFT JOIN (SELECT split_part(p_name, ' ', 1) AS tag, min(p_type) AS label FROM part WHERE p_name < 'p' GROUP BY 1) l USING (tag)""")
def c10(spark, sf):
    part = table(spark, sf, "part")
    tagged = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.when(F.col("p_size") < 5, ",").otherwise("")).alias("tags"))
    known = part.where("p_name < 'p'").groupBy(F.split("p_name", " ")[0].alias("tag")).agg(F.min("p_type").alias("label"))
    return labels.tag_counts(tagged, "tags", known, top_n=6)


def _sheet(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.when(F.col("p_size") > 10, "mRNA_").otherwise("DNA_"), F.replace("p_name", F.lit(" "), F.lit("_")),
                 F.when(F.col("l_returnflag") != "R", F.concat(F.lit("_L00"), F.col("l_linenumber").cast("string"))).otherwise("")).alias("name"),
        F.concat(F.lit("SRX"), F.col("l_orderkey").cast("string")).alias("experiment"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run"))


SHEET = """sh AS (SELECT 'mRNA_' || replace(p_name, ' ', '_') AS name, 'L00' || l_linenumber AS lane, 'SRX' || l_orderkey AS experiment,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS accession FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 AND l_returnflag <> 'R'),
st AS (SELECT min(experiment) OVER (PARTITION BY name) AS sample, accession, name, lane, 'Homo sapiens' AS organism FROM sh)"""


@query("c11_sample_sheet", f"WITH {SHEET} SELECT * FROM st")
def c11(spark, sf):
    return labels.sample_sheet(_sheet(spark, sf))


@query("c11_missing_samples", f"""
WITH {SHEET} SELECT * FROM st WHERE sample NOT IN (SELECT 'SRX' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def c11b(spark, sf):
    finished = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("SRX"), F.col("o_orderkey").cast("string")).alias("sample"))
    return labels.missing_samples(labels.sample_sheet(_sheet(spark, sf)), finished)


def _taxonomy(spark, sf):
    part = table(spark, sf, "part")
    current = part.select(F.col("p_name").alias("tissue"), F.col("p_type").alias("category"))
    incoming = part.where("p_size > 45").select(F.col("p_name").alias("tissue"), F.concat(F.lit('" '), "p_brand", F.lit(' ";x')).alias("category"))
    return current, incoming


@query("c12_taxonomy_refresh", """
SELECT o.tissue, split_part(lower(trim(replace(coalesce(n.category, o.category), '"', ''))), ';', 1) AS category FROM (SELECT p_name AS tissue, min(p_type) AS category FROM part GROUP BY 1) o
LEFT JOIN (SELECT p_name AS tissue, min('" ' || p_brand || ' ";x') AS category FROM part WHERE p_size > 45 GROUP BY 1) n ON o.tissue = n.tissue""")
def c12(spark, sf):
    return labels.refresh_taxonomy(*_taxonomy(spark, sf))


@query("c12_unmapped_labels", """
SELECT p_brand, CAST(count(DISTINCT p_name) AS BIGINT) AS n_unmapped FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45 AND p_type = 'PROMO') GROUP BY 1""")
def c12b(spark, sf):
    part = table(spark, sf, "part")
    mapped = part.where("p_size > 45 and p_type = 'PROMO'").select("p_name")
    return labels.unmapped_labels(part, mapped, "p_name", "p_brand")


@query("c13_run_filter", f"""
WITH {RUNS} SELECT CAST(run_id AS VARCHAR) AS run_id, tool_name, round(duration_seconds, 4) AS duration_seconds FROM runs
WHERE NOT has_error AND duration_seconds >= 5 AND duration_seconds <= 60 AND tool_name IN ('view', 'click', 'error')""")
def c13(spark, sf):
    flat = runlog.flatten_runs(run_records(spark, sf))
    kept = runlog.filter_runs(flat, min_duration=5, max_duration=60, names=["view", "click", "error"])
    return rounded(kept.select("run_id", "tool_name", "duration_seconds"))


@query("c14_flat_tool_runs", f"""
WITH {RUNS} SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(trace_id AS VARCHAR) AS trace_id, tool_name, round(duration_seconds, 4) AS duration_seconds,
  CASE WHEN has_error THEN 'error' ELSE 'success' END AS status, 'k' AS input_keys, CAST(length(replace(props, ' ', '')) + 2 AS INTEGER) AS input_size_chars,
  '{{"k":"' || json_extract_string(props, '$.k') || '"}}' AS input_summary, total_tokens FROM runs""")
def c14(spark, sf):
    flat = runlog.flatten_runs(run_records(spark, sf))
    return rounded(flat.select("run_id", "trace_id", "tool_name", "duration_seconds", "status", F.array_join("input_keys", ",").alias("input_keys"),
                               "input_size_chars", "input_summary", "total_tokens"))


@query("c14_flat_model_runs", f"""
WITH {RUNS} SELECT CAST(run_id AS VARCHAR) AS run_id, tool_name AS run_name, 'm-' || tool_name AS model_name, 0.5::DOUBLE AS temperature, NULL::DOUBLE AS top_p, round(total_cost, 4) AS total_cost FROM runs""")
def c14b(spark, sf):
    flat = runlog.flatten_runs(run_records(spark, sf), "model")
    return rounded(flat.select("run_id", "run_name", "model_name", "temperature", "top_p", "total_cost"))
