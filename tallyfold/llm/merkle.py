"""A manifest of a table as a Merkle tree: a subroot per group, a root over the subroots, and a proof for every row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranked import running_weight
from ..session import materialize

#: Levels of the tree in one record; a record has 2^LEVELS children at most.
LEVELS = 5


def digest(*parts: Column) -> Column:
    """Hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value; no two rows of values read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _parents(nodes: Column) -> Column:
    """Digests of each two consecutive nodes; the last one may be on its own."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


@dataclass
class Store:
    """Records of trees: `records[g]` has `(tree, rank, digest, levels, nodes, kids)` of the g-th run of LEVELS levels.

    A record leads from a digest to its up to 2^LEVELS children, `kids`, with
    all nodes in between (`nodes`, a list for each level from the children up).
    `roots` has `(tree, top, digest)`: the root of each tree and its run of levels.
    """

    records: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame, order: Sequence[str]) -> Store:
    """Trees over `(tree, digest, ...)`, a tree for each value of `tree` with its leaves in the given order.

    Leaves are numbered by ranges, and the children of a record share its
    number, so the tree of a group with most of the rows is built by all tasks.
    Other columns stay with the leaves.
    """
    extra = [c for c in leaves.columns if c not in ("tree", "digest")]
    height = F.when(F.col("_total") <= 1, 0).otherwise(F.length(F.bin(F.col("_total") - 1)))
    nodes = running_weight(leaves, order, ["tree"]).select(
        "tree", F.col("_before").alias("rank"), height.alias("height"), "digest", *extra)
    records, roots, g = [], None, 0
    while True:
        grouped = nodes.withColumn("kid", F.struct("rank", "digest", *extra)).groupBy(
            "tree", "height", F.shiftright("rank", LEVELS).alias("rank")).agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        level = grouped.withColumn("levels", F.least(F.lit(LEVELS), F.col("height") - g * LEVELS)).withColumn("n0", F.col("kids.digest"))
        for i in range(LEVELS):
            level = level.withColumn(f"n{i + 1}", F.when(F.col("levels") > i, _parents(F.col(f"n{i}"))))
        top = F.coalesce(*[F.col(f"n{i}") for i in range(LEVELS, -1, -1)])[0]
        written = materialize(level.select(
            "tree", "height", "rank", top.alias("digest"), "levels",
            F.array(*[F.col(f"n{i}") for i in range(LEVELS)]).alias("nodes"), "kids"), f"records-{g}")
        done = written.where(F.col("height") <= (g + 1) * LEVELS).select("tree", F.lit(g).alias("top"), "digest")
        records.append(written)
        roots = done if roots is None else roots.unionByName(done)
        nodes = written.where(F.col("height") > (g + 1) * LEVELS).select("tree", "rank", "height", "digest")
        if nodes.isEmpty():
            return Store(records, materialize(roots, "roots"))
        extra, g = [], g + 1


def descend(store: Store, start: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Requests led from the roots to the leaves: `(*start, tree, rank, leaf fields, path)`.

    `start` has `(tree, path, ...)`, a row for each tree to be read, with the
    steps that lead to its root. Requests for leaves below one node travel as
    one row, so no digest is asked for by more rows than have it as a node. At
    each record the digits of the rank choose a child, and the nodes that were
    not chosen are added to the path, as `(sibling, right)`: the digest beside
    the chosen node, null where it is alone, and whether the chosen one is the
    right of the two. `wanted`, as `(tree, rank)`, leaves out all other leaves.
    """
    carried = [c for c in start.columns if c != "tree"]
    keyed = start.withColumn("_tree", F.col("tree")).drop("tree")
    at_roots = keyed.join(store.roots, F.col("_tree").eqNullSafe(F.col("tree"))).drop("_tree")
    requests = None
    for g in range(len(store.records) - 1, -1, -1):
        fresh = at_roots.where(F.col("top") == g).select("tree", F.lit(0).cast("long").alias("rank"), "digest", *carried)
        requests = fresh if requests is None else requests.unionByName(fresh)
        known = store.records[g].dropDuplicates(["digest"]).select("digest", "levels", "nodes", "kids")
        met = requests.join(known, "digest").select(
            "tree", "rank", "levels", "nodes", *carried, F.posexplode("kids").alias("_at", "kid"))
        steps = [F.when(F.col("levels") > i, F.struct(
            F.get(F.get("nodes", F.lit(i)), F.shiftright("_at", i).bitwiseXOR(F.lit(1))).alias("sibling"),
            (F.shiftright("_at", i).bitwiseAND(F.lit(1)) == 1).alias("right"))) for i in range(LEVELS - 1, -1, -1)]
        longer = F.concat("path", F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("path")
        rank = (F.shiftleft("rank", LEVELS) + F.col("_at")).alias("rank")
        kid = F.col("kid").dropFields("rank")
        requests = met.select("tree", rank, kid.alias("kid"), *[c for c in carried if c != "path"], longer)
        if wanted is not None:
            asked = wanted.select(F.col("tree").alias("_tree"), F.shiftright("rank", g * LEVELS).alias("_rank")).distinct()
            requests = requests.join(asked, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("rank") == F.col("_rank")), "left_semi")
        requests = requests.select("tree", "rank", "kid.*", *carried)
        if g:
            requests = materialize(requests, f"requests-{g}")
    return requests


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the steps of its path, the lowest first."""
    return F.aggregate(path, leaf, lambda node, step: digest(
        F.when(step["right"], F.coalesce(step["sibling"], F.lit(""))).otherwise(F.lit("")), node,
        F.when(step["right"], F.lit("")).otherwise(F.coalesce(step["sibling"], F.lit("")))))


def manifest(df: DataFrame, columns: Sequence[str], id_col: str = "doc_id", by: str = "lang",
             tampered: Column | None = None, changes: Mapping[str, Column] = {}) -> DataFrame:
    """`(id, leaf, subroot, root, proof_sha256, folded_root, verified)` for every row.

    A leaf is the digest of the encoded `columns`. The leaves of a group ascend
    by id (null first, ties by leaf), those of the root by group (null first).
    Each row gets its proof, the digests beside its way to the root from the
    lowest up, by a descent through the records. `folded_root` folds the proof
    over the leaf, or, where `tampered` holds, over the leaf that the row has
    after `changes`; `verified` tells whether this is the root.

    Texts are read once, to make the leaves; digests alone are shuffled, and a
    proof is made and folded in the task that meets its leaf. Null values, empty
    and long texts are encoded like any other; rows with a null group form a
    group; repeated rows are leaves of their own; a row alone in its group is the
    subroot; an empty table gives no rows. Other columns are not read.
    """
    leaf = digest(*[encoded(F.col(c)) for c in columns])
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered, digest(*[encoded(changes.get(c, F.col(c))) for c in columns]))
    leaves = materialize(df.select(
        F.col(by).alias("tree"), leaf.alias("digest"), F.col(id_col).alias("_id"), changed.alias("_changed")), "leaves")
    trees = build(leaves, ["_id", "digest"])
    groups = build(trees.roots.select(F.lit(0).alias("tree"), "digest", F.col("tree").alias("_group")), ["_group"])
    no_steps = F.expr("CAST(array() AS array<struct<sibling: string, right: boolean>>)")
    subroots = descend(groups, groups.roots.select("tree", no_steps.alias("path"), F.col("digest").alias("root")))
    start = subroots.select(F.col("_group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = descend(trees, materialize(start, "subroots")).withColumn("path", F.reverse("path"))
    siblings = F.filter(F.col("path")["sibling"], lambda s: s.isNotNull())
    return found.select(
        F.col("_id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root",
        digest(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.coalesce("_changed", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The manifest of `documents` in SQL, with the change that the query makes.
MANIFEST_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384) + 0 * z)) AS t),
d AS MATERIALIZED (
  SELECT *, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 7 = 0 END AS tampered FROM documents CROSS JOIN crc),
e AS (SELECT doc_id, lang, tampered,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS b, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS b1,
  coalesce(strlen(text) || ':' || text, '-') AS c FROM d),
l AS MATERIALIZED (SELECT doc_id, lang, sha256(a || b || c) AS leaf, CASE WHEN tampered THEN sha256(a || b1 || c) ELSE sha256(a || b || c) END AS used FROM e),
n AS (
  SELECT lang, 0 AS level, row_number() OVER w - 1 AS i, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM l
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM n WHERE n > 1 GROUP BY lang, level, i // 2, n),
s AS MATERIALIZED (SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM n WHERE n = 1),
m AS (
  SELECT 0 AS level, place AS i, subroot AS digest, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM m WHERE n > 1 GROUP BY level, i // 2, n),
nodes AS MATERIALIZED (SELECT * FROM n), tops AS MATERIALIZED (SELECT * FROM m),
r AS (SELECT digest AS root, level AS above FROM tops WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
steps AS (
  SELECT k.lang, k.i, x.level, x.digest, (k.i >> x.level) & 1 AS right_one FROM k JOIN nodes x
    ON x.lang IS NOT DISTINCT FROM k.lang AND x.n > 1 AND x.i = xor(k.i >> x.level, 1)
  UNION ALL
  SELECT k.lang, k.i, s.height + y.level, y.digest, (s.place >> y.level) & 1 FROM k JOIN s ON s.lang IS NOT DISTINCT FROM k.lang
    JOIN tops y ON y.n > 1 AND y.i = xor(s.place >> y.level, 1)),
p AS (SELECT k.lang, k.i, any_value(s.subroot) AS subroot, any_value(r.root) AS root,
    coalesce(string_agg(z.digest, '' ORDER BY z.level), '') AS siblings, any_value(s.height + r.above) AS height,
    map_from_entries(coalesce(list({'k': z.level, 'v': (CASE WHEN z.right_one = 1 THEN 'L' ELSE 'R' END) || z.digest}) FILTER (WHERE z.level IS NOT NULL), [])) AS by_level
  FROM k JOIN s ON s.lang IS NOT DISTINCT FROM k.lang CROSS JOIN r
  LEFT JOIN steps z ON z.lang IS NOT DISTINCT FROM k.lang AND z.i = k.i GROUP BY k.lang, k.i),
f AS (
  SELECT k.doc_id, k.leaf, p.subroot, p.root, sha256(p.siblings) AS proof_sha256,
    list_reduce(list_prepend(k.used, list_transform(range(p.height), lambda h: coalesce(by_level[CAST(h AS INTEGER)], 'N'))),
      lambda a, z: sha256(CASE z[1] WHEN 'L' THEN z[2:] || a WHEN 'R' THEN a || z[2:] ELSE a END)) AS folded_root
  FROM k JOIN p ON p.lang IS NOT DISTINCT FROM k.lang AND p.i = k.i)
SELECT *, folded_root = root AS verified FROM f"""
