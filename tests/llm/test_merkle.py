"""Manifests against a plain Merkle tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyfold.llm.merkle import build, descend, folded, manifest
from tallyfold.llm.queries import ORACLES, QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root, and for each leaf the digests beside its way, the lowest first."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            proofs[leaf].append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i & 1))
            at[leaf] = i >> 1
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def fold(node, path):
    for sibling, right in path:
        node = h(*([sibling or "", node] if right else [node, sibling or ""]))
    return node


def plain(rows):
    """Rows of `(doc_id, source, lang, n_chars, text)`; every seventh crc is tampered with."""
    groups, found = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h(*map(coded, r)), r))
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in ordered}
    root, above = tree([below[g][0] for g in ordered]) if ordered else (None, [])
    for g, up in zip(ordered, above):
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for (key, leaf, r), path in zip(leaves, below[g][1]):
            path = path + up
            used = leaf
            if key is not None and zlib.crc32(str(key).encode()) % 7 == 0 and r[3] is not None:
                used = h(*map(coded, (*r[:3], r[3] + 1, r[4])))
            end = fold(used, path)
            found.append((key, leaf, below[g][0], root, h(*(s for s, _ in path if s)), end, end == root))
    return sorted(map(str, found))


def run(df):
    out = manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                   changes={"n_chars": F.try_add(F.col("n_chars"), F.lit(1))})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(str(tuple(r)) for r in out.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query(spark, sf, db):
    found = QUERIES["op13_merkle_manifest"](spark, sf)
    rows = sorted(str(tuple(r)) for r in found.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert rows == plain([tuple(r) for r in docs.collect()])
    assert rows == sorted(map(str, db.execute(ORACLES["op13_merkle_manifest"]).fetchall()))
    assert 0 < found.where(~F.col("verified")).count() < found.count() / 4


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 1, 2], [31, 32, 33], [1, 64, 65, 1024, 1025], [1] * 40])
def test_groups_of_all_sizes(spark, sizes):
    rows = [(i * 1000 + j, f"s{j % 3}", f"l{i:02d}", j, "é" * (j % 4)) for i, n in enumerate(sizes) for j in range(n)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_rows_of_all_kinds(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (1, "a", "en", 3, "x:y"), (None, "a", "en", 3, ""), (7, "", None, 0, "z"),
            (9, "ü", "", -5, "long " * 200_000), (10, "-", "-", 1, "-"), *[(4, "same", "en", 1, "row")] * 70]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("tree", "digest", "rank", "path", "_id", "kid", "root")})
    assert run(df) == plain(rows)
    assert run(df.limit(0)) == []


def test_requests_for_some_leaves(spark):
    leaves = spark.range(5000).select((F.col("id") % 2).alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    store = build(leaves, ["id"])
    start = store.roots.select("tree", F.expr("CAST(array() AS array<struct<sibling: string, right: boolean>>)").alias("path"), F.col("digest").alias("root"))
    wanted = spark.createDataFrame([(0, 0), (0, 2499), (1, 77)], "tree long, rank long")
    found = descend(store, start, wanted).withColumn("end", folded(F.col("digest"), F.reverse("path")))
    assert sorted((r.tree, r.rank, r.id, r.end == r.root) for r in found.collect()) == [(0, 0, 0, True), (0, 2499, 4998, True), (1, 77, 155, True)]


def test_no_digest_is_asked_for_by_every_row(spark):
    """Requests meet a record as one row per node, so the root is asked for once."""
    leaves = spark.range(3000).select(F.lit("a").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    store = build(leaves, ["id"])
    assert [r.count() for r in store.records] == [94, 3, 1]
