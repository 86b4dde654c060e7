"""Directed graphs as edge tables: reachability, distances, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize, scratch_path, write_measured


def clean_edges(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Distinct edges without self-loops or missing ends."""
    return (
        edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
        .where(F.col("child").isNotNull() & F.col("parent").isNotNull() & (F.col("child") != F.col("parent")))
        .distinct()
    )


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_rounds: int | None = None, few: bool = True) -> DataFrame:
    """All `(src, dst, depth)` with a path from src to dst, `depth` the shortest; a node is not its own descendant.

    `seeds` leaves only paths that start there. Without seeds, or where they are
    not `few` against all nodes, paths are doubled in length each round; from few
    seeds they grow by one edge a round, so that nothing is found that does not
    start at a seed. Paths longer than `max_rounds` edges are an error.
    """
    step = materialize(clean_edges(edges), "edges")
    if seeds is None:
        return _doubled(step, max_rounds)
    ids = seeds.select(F.col(seeds.columns[0]).alias("src")).distinct()
    return _by_level(step, ids, max_rounds) if few else _doubled(step, max_rounds).join(ids, "src", "left_semi")


def _doubled(step: DataFrame, max_rounds: int | None) -> DataFrame:
    """All shortest paths in about as many rounds as the longest has binary digits.

    With all pairs up to a distance of k at hand, a pair between k and 2k apart
    has a node on its way that is exactly k from the start, so only the pairs
    exactly k apart are extended, each by all pairs that begin where it ends.
    Few nodes are that far from any start in a hierarchy, so what begins at them
    is written by itself and joined from memory where it is small. The pairs are
    dealt by their start, where the longer ones stay and are merged with those
    known. Every round is written to a folder of its own, which keeps its plan short.
    """
    spark, root = step.sparkSession, scratch_path(step.sparkSession, "closure")
    pairs = step.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1).alias("depth"))
    longest, k = 1, 1
    while True:
        if max_rounds is not None and longest > max_rounds:
            raise RuntimeError(f"paths longer than {max_rounds} edges")
        if longest < k:
            return pairs
        vias = materialize(pairs.where(F.col("depth") == k).select(F.col("dst").alias("src")).distinct(), "vias")
        onward = materialize(pairs.join(vias, "src", "left_semi"), "onward").select(
            F.col("src").alias("_via"), F.col("dst").alias("_to"), F.col("depth").alias("_further"))
        known = pairs.repartition("src")
        longer = known.where(F.col("depth") == k).join(onward, F.col("dst") == F.col("_via")).where(F.col("src") != F.col("_to")).select(
            "src", F.col("_to").alias("dst"), (F.col("_further") + k).alias("depth"))
        nearest = known.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        found = write_measured(nearest, f"{root}/{2 * k}", longest=F.max("depth"))
        pairs = spark.read.schema(nearest.schema).parquet(f"{root}/{2 * k}")
        longest, k = found["longest"] or 0, 2 * k


def _by_level(step: DataFrame, ids: DataFrame, max_rounds: int | None) -> DataFrame:
    """Shortest paths from the seeds: those found last are extended by one edge, and pairs known already are dropped."""
    spark = step.sparkSession
    start = step.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1).alias("depth")).join(ids, "src", "left_semi")
    reader = spark.read.schema(start.schema)
    root = scratch_path(spark, "closure")
    paths = [f"{root}/level-1"]
    found = write_measured(start, paths[0], n=F.count(F.lit(1)))
    while found["n"]:
        if max_rounds is not None and len(paths) >= max_rounds:
            raise RuntimeError(f"paths longer than {max_rounds} edges")
        longer = (
            reader.parquet(paths[-1]).join(step, F.col("dst") == F.col("child"))
            .select("src", F.col("parent").alias("dst"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("fresh"))
            .where(F.col("src") != F.col("dst"))
        )
        # one shuffle both drops repeats and takes out the pairs of earlier levels
        pairs = longer.unionByName(reader.parquet(*paths).withColumn("fresh", F.lit(False))).groupBy("src", "dst")
        level = pairs.agg(F.min("depth").alias("depth"), F.bool_and("fresh").alias("fresh")).where("fresh").drop("fresh")
        paths.append(f"{root}/level-{len(paths) + 1}")
        found = write_measured(level, paths[-1], n=F.count(F.lit(1)))
    return reader.parquet(*paths)


def with_self(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure plus each node reaching itself at depth 0."""
    own = nodes.select(F.col(nodes.columns[0]).alias("src")).distinct()
    return paths.unionByName(own.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")))


def depths_from(edges: DataFrame, root) -> DataFrame:
    """Shortest distance of every node reachable from `root` along the edges."""
    clean = clean_edges(edges)
    seed = clean.sparkSession.range(1).select(F.lit(root).cast(clean.schema["child"].dataType).alias("src"))
    return with_self(closure(clean, seed), seed).select(F.col("dst").alias("node"), "depth")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def contract(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Graph over the kept nodes: an edge wherever a path exists, with its length.

    `is_a` for pairs that are joined directly, `is_a_transitive` for the others.
    """
    clean = materialize(clean_edges(edges), "edges")
    ids = kept.select(F.col(kept.columns[0]).alias("dst")).distinct()
    paths = closure(clean, ids, few=False).join(ids, "dst", "left_semi")
    return paths.select(
        F.col("src").alias("child"), F.col("dst").alias("parent"),
        F.when(F.col("depth") == 1, "is_a").otherwise("is_a_transitive").alias("relationship"),
        F.col("depth").alias("path_length"),
    )


def node_weights(nodes: DataFrame, abundance: DataFrame, default: float = 1.0) -> DataFrame:
    """Weight of each node: its abundance, or the default; `matched` tells which."""
    table = abundance.select("node", F.col("abundance").cast("double").alias("_w"))
    return nodes.select("node").distinct().join(table, "node", "left").select(
        "node", F.coalesce("_w", F.lit(float(default))).alias("weight"), F.col("_w").isNotNull().alias("matched"))


def weighted_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Undirected edges, once each, weighted by the geometric mean of the node weights."""
    w = weights.select("node", "weight")
    pairs = clean_edges(edges).select(
        F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).distinct()
    return (
        pairs.join(w.select(F.col("node").alias("a"), F.col("weight").alias("_wa")), "a")
        .join(w.select(F.col("node").alias("b"), F.col("weight").alias("_wb")), "b")
        .select("a", "b", F.sqrt(F.col("_wa") * F.col("_wb")).alias("weight"))
    )


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)`, a weakly connected component named by its smallest node.

    Alternates two rewirings that hang the neighbours of each node on its
    smallest one: first the larger neighbours, then the smaller. Links shrink to
    stars in a few rounds, also on long chains.
    """
    spark, root = edges.sparkSession, scratch_path(edges.sparkSession, "links")
    marks = {"n": F.count(F.lit(1)), "mix": F.bit_xor(F.xxhash64("u", "v"))}
    oriented = clean_edges(edges).select(
        F.greatest("child", "parent").alias("u"), F.least("child", "parent").alias("v")).distinct()
    now, before, turn = write_measured(oriented, f"{root}/0", **marks), None, 0
    links = spark.read.schema(oriented.schema).parquet(f"{root}/0")
    while now != before:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("_min")).select("u", F.least("u", "_min").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        before, now = now, write_measured(small, f"{root}/{turn}", **marks)
        links = spark.read.schema(oriented.schema).parquet(f"{root}/{turn}")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with the most nodes."""
    members = materialize(components(edges), "members")
    biggest = members.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return members.join(biggest, "component", "left_semi").select("node")
