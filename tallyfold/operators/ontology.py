"""Ontology work on top of the graph operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import category_from_array
from ..functions.text import truncate_text
from ..session import materialize, scratch_path, write_measured
from .graph import clean_edges, closure, reverse, with_self
from .ranked import running_weight
from .windows import first_n


def parents(edges: DataFrame, terms: DataFrame) -> DataFrame:
    return edges.join(terms.select(F.col(terms.columns[0]).alias("child")).distinct(), "child", "left_semi")


def children(edges: DataFrame, terms: DataFrame) -> DataFrame:
    return edges.join(terms.select(F.col(terms.columns[0]).alias("parent")).distinct(), "parent", "left_semi")


# Edges that a round of `coverage` goes up at once, as a power of two.
STRIDE_DOUBLINGS = 2


def coverage(up: DataFrame, members: DataFrame) -> DataFrame:
    """`(cluster, node, covers, size)`: every ancestor of a cluster's nodes, the nodes included, and how many of them it covers.

    The nodes of a cluster are numbered, and each number is a bit of a mask, 64 to
    a row. Masks, not pairs of nodes and ancestors, move up the edges and are merged
    where they meet, so a large cluster below one term is one row for each 64 of
    its nodes. A round goes several edges up with the bits that were new in the
    round before, and is written to a folder of its own.
    """
    spark, root = members.sparkSession, scratch_path(members.sparkSession, "coverage")
    numbered = running_weight(members.where(F.col("cluster").isNotNull()), ["node"], by=["cluster"])
    masks = materialize(numbered.select(
        "cluster", F.floor(F.col("_before") / 64).alias("block"), "node", F.col("_total").alias("size"),
        F.expr("shiftleft(1L, cast(_before % 64 as int))").alias("bits")), "masks")
    above = _within(up, STRIDE_DOUBLINGS)
    keys = ["cluster", "block", "node", "size"]
    known, fresh, rounds, gained = masks, masks, 0, 1
    while gained:
        risen = fresh.join(above, F.col("node") == F.col("child")).select(
            "cluster", "block", F.col("parent").alias("node"), "size", F.col("bits").alias("_new"), F.lit(0).cast("long").alias("_old"))
        both = risen.unionByName(known.select(*keys, F.lit(0).cast("long").alias("_new"), F.col("bits").alias("_old")))
        merged = both.groupBy(*keys).agg(F.bit_or("_new").alias("_new"), F.bit_or("_old").alias("_old")).select(
            *keys, F.col("_new").bitwiseOR(F.col("_old")).alias("bits"),
            F.col("_new").bitwiseAND(F.bitwise_not("_old")).alias("gained"))
        rounds += 1
        gained = write_measured(merged, f"{root}/{rounds}", n=F.count_if(F.col("gained") != 0))["n"]
        known = spark.read.schema(merged.schema).parquet(f"{root}/{rounds}")
        fresh = known.where("gained != 0").select(*keys, F.col("gained").alias("bits"))
    return known.groupBy("cluster", "node", "size").agg(F.sum(F.bit_count("bits")).alias("covers")).select(
        "cluster", "node", "covers", "size")


def _within(up: DataFrame, doublings: int) -> DataFrame:
    """All pairs joined by a path of at most 2 ** doublings edges."""
    pairs = up.select("child", "parent")
    for _ in range(doublings):
        onward = pairs.select(F.col("child").alias("parent"), F.col("parent").alias("_far"))
        longer = pairs.join(onward, "parent").select("child", F.col("_far").alias("parent"))
        pairs = materialize(pairs.unionByName(longer).where(F.col("child") != F.col("parent")).distinct(), "within")
    return pairs


def common_roots(edges: DataFrame, membership: DataFrame, top: int = 3, direction: str = "ancestors") -> DataFrame:
    """Up to `top` lowest common ancestors `(cluster, root, common)` of each cluster's nodes.

    A cluster without a common ancestor gets its nodes that have no parent
    inside it, with `common` false. `direction='descendants'` follows the edges the other way.
    """
    if direction not in ("ancestors", "descendants"):
        raise ValueError("direction is ancestors or descendants")
    up = clean_edges(edges)
    up = materialize(up if direction == "ancestors" else reverse(up), "edges")
    members = materialize(membership.select("cluster", "node").distinct(), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    # a cluster of one node is its own root
    single = members.join(sizes.where("size = 1"), "cluster").select("cluster", F.col("node").alias("root"))
    several = members.join(sizes.where("size > 1"), "cluster", "left_semi")
    shared = coverage(up, several).where("covers = size").select("cluster", F.col("node").alias("root"))
    common = materialize(shared.unionByName(single.where(F.col("root").isNotNull())), "common")
    # whatever is above a common ancestor is common too, so looking one edge down is enough
    higher = (
        common.join(up, F.col("root") == F.col("child"))
        .select("cluster", F.col("parent").alias("root"))
        .distinct()
    )
    lowest = common.join(higher, ["cluster", "root"], "left_anti")
    best = first_n(lowest, ["cluster"], [F.col("root")], top)
    inside = _with_parent_inside(members, up)
    tops = (
        members.join(common.select("cluster").distinct(), "cluster", "left_anti")
        .join(inside, ["cluster", "node"], "left_anti")
        .select("cluster", F.col("node").alias("root"))
    )
    return best.withColumn("common", F.lit(True)).unionByName(tops.withColumn("common", F.lit(False)))


def _with_parent_inside(members: DataFrame, up: DataFrame) -> DataFrame:
    """Members that have a parent in their own cluster."""
    links = members.join(up, F.col("node") == F.col("child")).select("cluster", "node", "parent")
    inside = members.select("cluster", F.col("node").alias("parent"))
    return links.join(inside, ["cluster", "parent"], "left_semi").select("cluster", "node")


def root_names(roots: DataFrame, terms: DataFrame) -> DataFrame:
    """`(cluster, root, common, name)`: every root of every cluster, however many, with its name."""
    return roots.join(terms.select(F.col("id").alias("root"), "name"), "root", "left").select("cluster", "root", "common", "name")


def _root_labels(roots: DataFrame, terms: DataFrame) -> DataFrame:
    """Names of the common ancestors of each cluster joined by `:`, null where it has none."""
    name = F.coalesce("name", F.col("root").cast("string"))
    return root_names(roots, terms).groupBy("cluster").agg(
        F.collect_set(F.when(F.col("common"), name)).alias("_names")).select(
        "cluster", F.coalesce(F.nullif(F.array_join(F.sort_array("_names"), ":"), F.lit("")), F.lit("No common root")).alias("cluster_root_labels"))


def cluster_report(membership: DataFrame, roots: DataFrame, terms: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per node: cluster, the names of its common ancestors, weight and a shortened definition.

    A cluster without a common ancestor may have any number of roots, so they
    have no joined label; `root_names` has them all, one per row.
    """
    labels = _root_labels(roots, terms)
    return (
        membership.join(terms.select(F.col("id").alias("node"), "name", "definition"), "node", "left")
        .join(weights.select("node", "weight"), "node", "left")
        .join(labels, "cluster", "left")
        .select(
            F.col("node").alias("node_id"), F.coalesce("name", F.lit("")).alias("node_name"),
            F.col("cluster").alias("cluster_id"),
            F.coalesce("cluster_root_labels", F.lit("No root found")).alias("cluster_root_labels"),
            F.coalesce("weight", F.lit(1.0)).alias("abundance"),
            truncate_text(F.coalesce("definition", F.lit("")), 100).alias("definition"),
        )
    )


def cluster_summary(report: DataFrame) -> DataFrame:
    """Nodes and abundance per cluster, rounded to three digits."""
    return report.groupBy("cluster_id", "cluster_root_labels").agg(
        F.count("node_id").alias("n_nodes"),
        F.round(F.sum("abundance"), 3).alias("abundance_sum"),
        F.round(F.avg("abundance"), 3).alias("abundance_mean"),
        F.round(F.stddev_samp("abundance"), 3).alias("abundance_std"),
    )


def broad_matches(edges: DataFrame, terms: DataFrame, broad: DataFrame) -> DataFrame:
    """`(term, category)`: the broad categories among a term's ancestors and itself."""
    wanted = broad.select(F.col(broad.columns[0]).alias("category")).distinct()
    ids = terms.select(F.col(terms.columns[0]).alias("term")).distinct()
    below = with_self(closure(reverse(edges), wanted), wanted)  # from the few broad terms down
    return below.select(F.col("dst").alias("term"), F.col("src").alias("category")).join(ids, "term", "left_semi")


def category_frequency(matches: DataFrame) -> DataFrame:
    """In how many terms each category was found."""
    return matches.distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n_terms"))


def most_common_category(matches: DataFrame) -> DataFrame:
    """For each term the category found most often over all terms; ties by name."""
    counted = matches.distinct().join(category_frequency(matches), "category")
    best = counted.groupBy("term").agg(F.min(F.struct((-F.col("n_terms")).alias("_n"), "category")).alias("_best"))
    return best.select("term", F.col("_best.category").alias("category"))


def ruled_category(matches: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """First rule that fits a term's categories, else its most common category.

    The array per term holds broad categories only, so it is as short as that list.
    """
    found = matches.groupBy("term").agg(F.collect_set("category").alias("_found"))
    return found.join(most_common_category(matches), "term").select(
        "term", category_from_array("_found", rules, F.col("category")).alias("category"))


def term_distance(df: DataFrame, left: str, right: str, edges: DataFrame) -> DataFrame:
    """Adds the ontology distance of two terms of a row where one is above the other.

    0 for equal terms, null where neither is an ancestor of the other.
    """
    ends = df.select(F.col(left).alias("src"), F.col(right).alias("dst"))
    wanted = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    # all paths are looked at once, and only those that join terms of a row go on
    paths = materialize(closure(edges).join(materialize(wanted, "wanted"), ["src", "dst"], "left_semi"), "paths")
    up = paths.select(F.col("src").alias(left), F.col("dst").alias(right), F.col("depth").alias("_up"))
    down = paths.select(F.col("dst").alias(left), F.col("src").alias(right), F.col("depth").alias("_down"))
    return (
        df.join(up, [left, right], "left").join(down, [left, right], "left")
        .withColumn("distance", F.when(F.col(left) == F.col(right), 0).otherwise(F.coalesce("_up", "_down")))
        .drop("_up", "_down")
    )
