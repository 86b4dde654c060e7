"""Ontology and graph operators. Terms are parts, each below the parts key/2 and key/3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import FINE_CELL_RULES
from ..operators import graph as G, ontology as O, spectral as S
from ..session import materialize
from .registry import CLOSURE, EDGES, ontology_edges, positioned, query, rounded, table


@query("g1_edges", f"WITH {EDGES} SELECT child, parent FROM e")
def g1(spark, sf):
    return G.clean_edges(ontology_edges(spark, sf))


@query("g2_ancestors", f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT src, dst, depth FROM c")
def g2(spark, sf):
    return G.closure(ontology_edges(spark, sf))


@query("g2_parents_and_children", f"""
WITH {EDGES}, p AS (SELECT p_partkey AS t FROM part WHERE p_size > 40)
SELECT 'parent' AS side, child, parent FROM e WHERE child IN (SELECT t FROM p) UNION ALL SELECT 'child', child, parent FROM e WHERE parent IN (SELECT t FROM p)""")
def g2b(spark, sf):
    edges = G.clean_edges(ontology_edges(spark, sf))
    terms = table(spark, sf, "part").where("p_size > 40").select("p_partkey")
    return O.parents(edges, terms).select(F.lit("parent").alias("side"), "child", "parent").unionByName(
        O.children(edges, terms).select(F.lit("child").alias("side"), "child", "parent"))


@query("g3_contracted_graph", f"""
WITH RECURSIVE {EDGES}, {CLOSURE}, k AS (SELECT p_partkey AS n FROM part WHERE p_type IN ('PROMO', 'ECONOMY'))
SELECT src AS child, dst AS parent, CASE WHEN depth = 1 THEN 'is_a' ELSE 'is_a_transitive' END AS relationship, depth AS path_length
FROM c WHERE src IN (SELECT n FROM k) AND dst IN (SELECT n FROM k)""")
def g3(spark, sf):
    kept = table(spark, sf, "part").where(F.col("p_type").isin("PROMO", "ECONOMY")).select("p_partkey")
    return G.contract(ontology_edges(spark, sf), kept)


def _weights(spark, sf):
    part = table(spark, sf, "part")
    abundance = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("abundance"))
    return G.node_weights(part.select(F.col("p_partkey").alias("node")), abundance)


WEIGHTS = """ab AS (SELECT l_partkey AS node, count(*) AS abundance FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
nw AS (SELECT p_partkey AS node, coalesce(abundance, 1)::DOUBLE AS weight, abundance IS NOT NULL AS matched FROM part LEFT JOIN ab ON p_partkey = node)"""


@query("g4_node_weights", f"WITH {WEIGHTS} SELECT * FROM nw")
def g4(spark, sf):
    return _weights(spark, sf)


@query("g5_weighted_edges", f"""
WITH {EDGES}, {WEIGHTS} SELECT DISTINCT least(child, parent) AS a, greatest(child, parent) AS b, round(sqrt(x.weight * y.weight), 6) AS weight
FROM e JOIN nw x ON child = x.node JOIN nw y ON parent = y.node""")
def g5(spark, sf):
    return rounded(G.weighted_edges(ontology_edges(spark, sf), _weights(spark, sf)), 6)


def _forest(spark, sf):
    """Each part below key/2, without the links of one part type, which cuts the tree into many."""
    part = table(spark, sf, "part").where("p_type <> 'ECONOMY'")
    return part.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))


FOREST = """e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_type <> 'ECONOMY' AND p_partkey <> p_partkey // 2),
w(src, dst, d) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT w.src, e.parent, w.d + 1 FROM w JOIN e ON w.dst = e.child),
m AS (SELECT src AS node, min(dst) AS component FROM w GROUP BY 1 UNION SELECT parent, parent FROM e WHERE parent NOT IN (SELECT child FROM e))"""


@query("g6_components", f"WITH RECURSIVE {FOREST} SELECT node, component FROM m")
def g6(spark, sf):
    return G.components(_forest(spark, sf))


@query("g6_largest_component", f"""
WITH RECURSIVE {FOREST} SELECT node FROM m WHERE component = (SELECT component FROM m GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""")
def g6b(spark, sf):
    return G.largest_component(_forest(spark, sf))


@query("g7_graph_clusters")
def g7(spark, sf):
    weighted = materialize(G.weighted_edges(ontology_edges(spark, sf), _weights(spark, sf)), "weighted")
    inside = G.largest_component(weighted.select(F.col("b").alias("child"), F.col("a").alias("parent")))
    kept = weighted.join(inside.select(F.col("node").alias("a")), "a", "left_semi")
    return S.spectral_clusters(kept, 5, max_rounds=25)


def _membership(spark, sf):
    """Runs of twelve neighbouring keys as clusters."""
    return table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 12).alias("cluster"), F.col("p_partkey").alias("node"))


@query("l8_graph_silhouette", f"""
WITH {EDGES}, {WEIGHTS}, g AS (SELECT DISTINCT least(child, parent) AS a, greatest(child, parent) AS b, sqrt(x.weight * y.weight) AS weight
  FROM e JOIN nw x ON child = x.node JOIN nw y ON parent = y.node),
mb AS (SELECT p_partkey AS node, p_partkey // 12 AS cluster FROM part), sz AS (SELECT cluster, count(*) AS n FROM mb GROUP BY 1),
sm AS (SELECT x.node, y.cluster AS other, sum(weight) AS d FROM (SELECT a, b, weight FROM g UNION ALL SELECT b, a, weight FROM g) JOIN mb x ON a = x.node JOIN mb y ON b = y.node GROUP BY 1, 2),
av AS (SELECT mb.node, mb.cluster, sz.cluster AS other, n, coalesce(d, 0) AS d FROM mb CROSS JOIN sz LEFT JOIN sm ON sm.node = mb.node AND sm.other = sz.cluster),
sc AS (SELECT node, any_value(cluster) AS cluster, max(CASE WHEN n > 1 THEN d / (n - 1) END) FILTER (WHERE cluster = other) AS own, min(d / n) FILTER (WHERE cluster <> other) AS other FROM av GROUP BY 1)
SELECT node, cluster, round(own, 6) AS own, round(other, 6) AS other,
  round(CASE WHEN own IS NULL OR other IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END, 6) AS silhouette FROM sc""")
def l8(spark, sf):
    weighted = G.weighted_edges(ontology_edges(spark, sf), _weights(spark, sf))
    return rounded(S.graph_silhouette(weighted, _membership(spark, sf)), 6)


ROOTS = """mb AS (SELECT p_partkey // 12 AS cluster, p_partkey AS node FROM part), sz AS (SELECT cluster, count(*) AS n FROM mb GROUP BY 1),
cs AS (SELECT src, dst FROM c UNION ALL SELECT p_partkey, p_partkey FROM part),
cv AS (SELECT cluster, dst AS root, count(*) AS k FROM mb JOIN cs ON node = src GROUP BY 1, 2),
cm AS (SELECT cv.cluster, root FROM cv JOIN sz ON cv.cluster = sz.cluster AND k = n WHERE n > 1 OR EXISTS (SELECT 1 FROM mb WHERE mb.cluster = cv.cluster AND node = root)),
hi AS (SELECT x.cluster, y.root FROM cm x JOIN c ON src = x.root JOIN cm y ON y.cluster = x.cluster AND y.root = dst),
lw AS (SELECT cluster, root, row_number() OVER (PARTITION BY cluster ORDER BY root) AS rn FROM cm ANTI JOIN hi USING (cluster, root)),
rt AS (SELECT cluster, root, TRUE AS common FROM lw WHERE rn <= 3 UNION ALL
  SELECT mb.cluster, node, FALSE FROM mb WHERE mb.cluster NOT IN (SELECT cluster FROM cm) AND NOT EXISTS (
    SELECT 1 FROM e JOIN mb m2 ON m2.node = e.parent WHERE e.child = mb.node AND m2.cluster = mb.cluster))"""


@query("g8_cluster_roots", f"WITH RECURSIVE {EDGES}, {CLOSURE}, {ROOTS} SELECT cluster, root, common FROM rt")
def g8(spark, sf):
    return O.common_roots(ontology_edges(spark, sf), _membership(spark, sf))


def _terms(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.repeat(F.concat("p_name", F.lit(" ")), 10).alias("definition"))


REPORT = """tm AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, repeat(p_name || ' ', 10) AS definition FROM part),
rl AS (SELECT cluster, string_agg(name, ':' ORDER BY name) AS labels FROM (SELECT DISTINCT cluster, name FROM rt JOIN tm ON root = id WHERE common) GROUP BY 1),
rp AS (SELECT node AS node_id, name AS node_name, mb.cluster AS cluster_id, coalesce(labels, CASE WHEN mb.cluster IN (SELECT cluster FROM rt) THEN 'No common root' ELSE 'No root found' END) AS cluster_root_labels, weight AS abundance,
  CASE WHEN length(definition) > 100 THEN substring(definition, 1, 100) || '...' ELSE definition END AS definition
  FROM mb JOIN tm ON node = id JOIN nw USING (node) LEFT JOIN rl ON rl.cluster = mb.cluster)"""


def _report(spark, sf):
    members = _membership(spark, sf)
    roots = O.common_roots(ontology_edges(spark, sf), members)
    return O.cluster_report(members, roots, _terms(spark, sf), _weights(spark, sf))


@query("g9_cluster_report", f"""
WITH RECURSIVE {EDGES}, {CLOSURE}, {ROOTS}, {WEIGHTS}, {REPORT}
SELECT *, CAST(row_number() OVER (ORDER BY cluster_id, abundance DESC, node_id) AS BIGINT) AS position FROM rp""")
def g9(spark, sf):
    return positioned(_report(spark, sf).orderBy("cluster_id", F.desc("abundance"), "node_id"))


@query("g9_root_names", f"WITH RECURSIVE {EDGES}, {CLOSURE}, {ROOTS} SELECT cluster, root, common, p_name || ' ' || p_partkey AS name FROM rt LEFT JOIN part ON root = p_partkey")
def g9c(spark, sf):
    return O.root_names(O.common_roots(ontology_edges(spark, sf), _membership(spark, sf)), _terms(spark, sf))


@query("g9_cluster_summary", f"""
WITH RECURSIVE {EDGES}, {CLOSURE}, {ROOTS}, {WEIGHTS}, {REPORT}
SELECT cluster_id, cluster_root_labels, CAST(count(node_id) AS BIGINT) AS n_nodes, round(sum(abundance), 3) AS abundance_sum,
  round(avg(abundance), 3) AS abundance_mean, round(stddev_samp(abundance), 3) AS abundance_std FROM rp GROUP BY 1, 2""")
def g9b(spark, sf):
    return O.cluster_summary(_report(spark, sf))


MATCHES = """br AS (SELECT p_partkey AS id, p_name AS category FROM part WHERE p_size > 44),
mt AS (SELECT DISTINCT src AS term, category FROM (SELECT src, dst FROM c UNION ALL SELECT p_partkey, p_partkey FROM part) JOIN br ON dst = id),
fq AS (SELECT category, count(*) AS n_terms FROM mt GROUP BY 1),
bs AS (SELECT term, category FROM (SELECT term, mt.category, row_number() OVER (PARTITION BY term ORDER BY n_terms DESC, mt.category) AS rn FROM mt JOIN fq USING (category)) WHERE rn = 1)"""


def _matches(spark, sf):
    part = table(spark, sf, "part")
    broad = part.where("p_size > 44").select(F.col("p_partkey").alias("category"), F.col("p_name").alias("name"))
    found = O.broad_matches(ontology_edges(spark, sf), part.select("p_partkey"), broad)
    return materialize(found.join(broad, "category").select("term", F.col("name").alias("category")).distinct(), "matches")


@query("g10_common_category", f"WITH RECURSIVE {EDGES}, {CLOSURE}, {MATCHES} SELECT term, category FROM bs")
def g10(spark, sf):
    return O.most_common_category(_matches(spark, sf))


STAND_IN_RULES = (("red widget", "red"), ("small ring", "ring"), ("blue ring", "ring"), ("cold plate", "plate"))


@query("g10_ruled_category", f"""
WITH RECURSIVE {EDGES}, {CLOSURE}, {MATCHES}, fo AS (SELECT term, list(category) AS f FROM mt GROUP BY 1)
SELECT term, CASE {' '.join(f"WHEN list_contains(f, '{a}') THEN '{b}'" for a, b in (*FINE_CELL_RULES, *STAND_IN_RULES))} ELSE category END AS category FROM fo JOIN bs USING (term)""")
def g10b(spark, sf):
    return O.ruled_category(_matches(spark, sf), (*FINE_CELL_RULES, *STAND_IN_RULES))


@query("g11_depth_from_root", f"""
WITH RECURSIVE {EDGES}, {CLOSURE} SELECT src AS node, depth FROM c WHERE dst = 1 UNION ALL SELECT 1, 0""")
def g11(spark, sf):
    return G.depths_from(G.reverse(G.clean_edges(ontology_edges(spark, sf))), 1)


@query("g12_term_distance", f"""
WITH RECURSIVE {EDGES}, {CLOSURE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_partkey = l_suppkey THEN 0 ELSE coalesce(u.depth, d.depth) END AS INTEGER) AS distance
FROM lineitem LEFT JOIN c u ON u.src = l_partkey AND u.dst = l_suppkey LEFT JOIN c d ON d.dst = l_partkey AND d.src = l_suppkey""")
def g12(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return O.term_distance(rows, "l_partkey", "l_suppkey", ontology_edges(spark, sf))
