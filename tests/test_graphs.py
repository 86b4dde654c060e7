"""Graph and ontology operators on small graphs and against brute force."""

from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import graph as G, ontology as O, spectral as S
from tallyfold.queries.registry import positioned
from tallyfold.session import materialize


def edge_frame(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "a")]


def brute_depths(pairs):
    nxt = defaultdict(set)
    for c, p in pairs:
        if c != p:
            nxt[c].add(p)
    out = {}
    for s in list(nxt):
        seen, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            for m in nxt[n]:
                if m not in seen:
                    seen[m] = seen[n] + 1
                    queue.append(m)
        out.update({(s, d): k for d, k in seen.items() if d != s})
    return out


def test_closure_of_a_diamond(spark, rows):
    got = {(s, d): k for s, d, k in rows(G.closure(edge_frame(spark, DIAMOND)))}
    assert got == brute_depths(DIAMOND) and got[("a", "d")] == 2


def test_closure_ends_on_cycles_and_matches_brute_force(spark, rows):
    rng = np.random.default_rng(5)
    pairs = [(str(a), str(b)) for a, b in rng.integers(0, 25, (40, 2))] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {(s, d): k for s, d, k in rows(G.closure(edge_frame(spark, pairs)))}
    assert got == brute_depths(pairs)


def test_closure_is_transitive(spark):
    c = G.closure(edge_frame(spark, DIAMOND))
    two = c.alias("x").join(c.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst").distinct()
    assert two.join(c, ["src", "dst"], "left_anti").count() == 0


def test_closure_limits(spark):
    assert G.closure(edge_frame(spark, [("a", "a")])).count() == 0
    with pytest.raises(RuntimeError):
        G.closure(edge_frame(spark, DIAMOND), max_rounds=1)
    seeds = spark.createDataFrame([("b",)], "n string")
    assert G.closure(edge_frame(spark, DIAMOND), seeds).count() == 2


def test_closure_on_a_long_chain(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(22)]
    out = G.closure(edge_frame(spark, chain))
    assert out.count() == 22 * 23 // 2 and out.agg(F.max("depth")).first()[0] == 22


def test_closure_rounds_shuffle_and_extend_little(spark, monkeypatch):
    """What is joined onto the pairs of a round begins at the nodes that far from a start, and no other pair."""
    seen = {}

    def kept(df, label="table"):
        seen.setdefault(label, []).append(df.count())
        return materialize(df, label)

    monkeypatch.setattr(G, "materialize", kept)
    n = 2000
    out = G.closure(spark.range(1, n).select(F.col("id").alias("child"), F.explode(F.array(
        F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("parent")))
    want = brute_depths([(i, i // d) for i in range(1, n) for d in (2, 3)])
    assert {(r.src, r.dst): r.depth for r in out.collect()} == want
    assert len(seen["onward"]) == 4 and all(a <= n // 2 ** 2 ** i for i, a in enumerate(seen["vias"]))
    assert seen["onward"][-1] < len(want) / 100


def test_contraction(spark, rows):
    kept = spark.createDataFrame([("a",), ("d",), ("e",)], "n string")
    out = G.contract(edge_frame(spark, DIAMOND), kept)
    assert rows(out) == [("a", "d", "is_a_transitive", 2), ("a", "e", "is_a_transitive", 3), ("d", "e", "is_a", 1)]


def test_components_match_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    pairs = [(f"{a:02d}", f"{b:02d}") for a, b in rng.integers(0, 60, (35, 2))] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = sorted((n, find(n)) for n in list(root))
    assert rows(G.components(edge_frame(spark, pairs))) == want
    assert G.largest_component(edge_frame(spark, pairs)).count() == 31


def test_depths_from_root(spark, rows):
    down = G.reverse(edge_frame(spark, DIAMOND))
    assert rows(G.depths_from(down, "e")) == [("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 0)]


def test_weights(spark, rows):
    nodes = spark.createDataFrame([("a",), ("b",), ("d",)], "node string")
    w = G.node_weights(nodes, spark.createDataFrame([("a", 4), ("zz", 9)], "node string, abundance int"))
    assert rows(w) == [("a", 4.0, True), ("b", 1.0, False), ("d", 1.0, False)]
    assert rows(G.weighted_edges(edge_frame(spark, DIAMOND), w)) == [("a", "b", 2.0), ("b", "d", 1.0)]


def roots(spark, rows, pairs, members, **kw):
    return rows(O.common_roots(edge_frame(spark, pairs), spark.createDataFrame(members, "cluster int, node string"), **kw), "cluster", "root")


def test_lowest_common_root(spark, rows):
    family = [("s", "p"), ("t", "p"), ("p", "r"), ("u", "r")]
    assert roots(spark, rows, family, [(1, "s"), (1, "t"), (2, "s"), (2, "u"), (3, "s")]) == [(1, "p"), (2, "r"), (3, "s")]


def test_roots_without_common_ancestor(spark, rows):
    assert roots(spark, rows, [("s", "p"), ("q", "z")], [(1, "s"), (1, "p"), (1, "q")]) == [(1, "p"), (1, "q")]


def random_graph(seed, n, acyclic=True):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (2 * n, 2)) if (a > b if acyclic else a != b)}
    members = sorted({(int(c), int(v)) for c, v in zip(rng.integers(0, 6, n), rng.integers(0, n, n))})
    return sorted(pairs), members


def reached(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for p in (b for a, b in pairs if a == at):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("seed, n, acyclic", [(1, 40, True), (2, 60, False)])
def test_coverage_against_single_walks(spark, rows, seed, n, acyclic):
    pairs, members = random_graph(seed, n, acyclic)
    got = O.coverage(spark.createDataFrame(pairs, "child long, parent long"), spark.createDataFrame(members, "cluster long, node long"))
    want = Counter((c, r) for c, v in members for r in reached(pairs, v))
    sizes = Counter(c for c, _ in members)
    assert rows(got) == sorted((c, r, k, sizes[c]) for (c, r), k in want.items())


def test_a_large_cluster_is_a_row_for_each_64_nodes(spark, monkeypatch):
    seen = []
    real = O.write_measured
    monkeypatch.setattr(O, "write_measured", lambda df, path, **m: (real(df, path, **m), seen.append((df.sparkSession, path)))[0])
    # 640 nodes below a chain of 32 terms: ten masks a term, not 640 pairs
    chain = [(f"t{i:02}", f"t{i + 1:02}") for i in range(32)]
    up = edge_frame(spark, [(f"n{i}", "t00") for i in range(640)] + chain)
    members = spark.createDataFrame([(1, f"n{i}") for i in range(640)], "cluster int, node string")
    full = O.coverage(up, members).where("covers = size")
    assert sorted(r.node for r in full.collect()) == [f"t{i:02}" for i in range(33)]
    assert len(seen) <= 10  # four edges a round, and one round that finds nothing
    session, path = seen[-1]
    assert session.read.parquet(path).where("node like 't%'").count() == 33 * 10


def test_roots_do_without_pairs_of_members_and_ancestors(spark, rows, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("closure of the members")
    monkeypatch.setattr(O, "closure", refuse)
    family = [("s", "p"), ("t", "p"), ("p", "r"), ("u", "r")]
    assert roots(spark, rows, family, [(1, "s"), (1, "t"), (2, "s"), (2, "u")]) == [(1, "p"), (2, "r")]


def test_at_most_three_roots_and_other_direction(spark, rows):
    wide = [(c, p) for c in "xy" for p in "abcd"]
    assert roots(spark, rows, wide, [(1, "x"), (1, "y")]) == [(1, "a"), (1, "b"), (1, "c")]
    assert roots(spark, rows, wide, [(1, "a"), (1, "b")], direction="descendants") == [(1, "x"), (1, "y")]
    with pytest.raises(ValueError):
        roots(spark, rows, wide, [(1, "a")], direction="up")


def weighted_frame(spark, matrix):
    n = len(matrix)
    rows = [(f"n{i:04d}", f"n{j:04d}", float(matrix[i, j])) for i in range(n) for j in range(i + 1, n) if matrix[i, j]]
    return spark.createDataFrame(rows, "a string, b string, weight double")


def laplacian(matrix):
    d = 1 / np.sqrt(matrix.sum(axis=1))
    return np.eye(len(matrix)) - matrix * d[:, None] * d[None]


def planted(sizes, inside, between, seed):
    rng = np.random.default_rng(seed)
    own = np.repeat(np.arange(len(sizes)), sizes)
    chance = np.where(own[:, None] == own[None], inside, between)
    links = np.triu(rng.random(chance.shape) < chance, 1) * rng.uniform(0.5, 2, chance.shape)
    ring = np.roll(np.eye(len(own)), 1, axis=1) * 0.05  # so that no node is without an edge
    whole = links + ring * (own[:, None] == own[None])
    return whole + whole.T, own


def test_eigenvalues_of_five_hundred_nodes(spark):
    matrix, _ = planted([200, 120, 100, 80], 0.1, 0.004, 3)
    found = S.smallest_eigenvectors(weighted_frame(spark, matrix), 5)
    want, vectors = np.linalg.eigh(laplacian(matrix))
    assert np.allclose(found.values, want[:5], atol=1e-6) and found.rounds < 60
    rows = sorted(found.vectors.collect(), key=lambda r: r.node)
    got = np.array([r.vector for r in rows])
    # the spaces spanned agree: all of the first four vectors lies within the found ones
    assert np.allclose(np.linalg.norm(got.T @ vectors[:, :4], axis=0), 1, atol=1e-3)


def test_planted_groups_of_unequal_size(spark):
    matrix, own = planted([150, 60, 30, 30, 12], 0.4, 0.01, 5)
    edges = weighted_frame(spark, matrix)
    runs = [{r.node: r.cluster for r in S.spectral_clusters(e, 5).collect()} for e in (edges, edges.repartition(11))]
    assert runs[0] == runs[1] and len(runs[0]) == len(own)
    wrong = 0
    for g in range(5):
        labels = [runs[0][f"n{i:04d}"] for i in np.flatnonzero(own == g)]
        wrong += len(labels) - max(map(labels.count, set(labels)))
    assert wrong <= 3 and len(set(runs[0].values())) == 5


def test_small_graphs(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 0.01), ("a1", "a1", 5.0), ("a1", "zz", 0.0)]
    out = {r.node: r.cluster for r in S.spectral_clusters(spark.createDataFrame(pairs, "a string, b string, weight double"), 2).collect()}
    assert out == {f"{g}{i}": int(g == "b") for g in "ab" for i in range(6)}
    pair = S.spectral_clusters(spark.createDataFrame([("x", "y", 1.0)], "a string, b string, weight double"), 3)
    assert sorted(r.cluster for r in pair.collect()) == [0, 1]


def test_rounds_write_no_tables_and_blocks_do_not_matter(spark, monkeypatch):
    written, real = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, label: (written.append(label), real(df, label))[1])
    matrix, _ = planted([40, 30, 20], 0.2, 0.03, 8)
    edges, found = weighted_frame(spark, matrix), []
    for rounds, block in ((3, 1000), (12, 1000), (12, 7)):
        monkeypatch.setattr(S, "BLOCK", block)
        written.clear()
        spectrum = S.smallest_eigenvectors(edges, 3, rounds, tolerance=0)
        vectors = np.array([r.vector for r in sorted(spectrum.vectors.collect(), key=lambda r: r.node)])
        found.append((len(written), spectrum.values, vectors * np.sign(vectors[0])))
    assert found[0][0] == found[1][0] == found[2][0] and "wide" not in written
    assert np.allclose(found[1][1], found[2][1], atol=1e-10) and np.allclose(found[1][2], found[2][2], atol=1e-8)


def test_product_in_blocks_sends_the_fewer_rows():
    """A hub in one block and its leaves in another: the leaves send one sum, the hub one row."""
    rng = np.random.default_rng(2)
    matrix = np.triu(rng.random((30, 30)) < 0.08, 1) * rng.random((30, 30))
    matrix[0, 10:20] = 1.0
    matrix = matrix + matrix.T
    blocks = []
    for b in range(3):
        place, other = np.nonzero(matrix[10 * b:10 * b + 10])
        blocks.append(S._wired(b, 10, pa.table({"place": place, "peer": other // 10, "other": other % 10, "weight": matrix[10 * b + place, other]})))
    v = rng.random((4, 30))
    came, rows = {b: {} for b in range(3)}, {}
    for b in range(3):
        for peer, (name, sent) in S._sent(blocks[b], v[:, 10 * b:10 * b + 10]):
            came[peer][name], rows[b, peer] = sent, sent.shape[1]
    out = np.concatenate([S._image(blocks[b], v[:, 10 * b:10 * b + 10], came[b]) for b in range(3)], axis=1)
    assert np.allclose(out, v @ matrix)
    for a, b in rows:
        part = matrix[10 * a:10 * a + 10, 10 * b:10 * b + 10]
        assert rows[a, b] == rows[b, a] == min((part > 0).any(axis=0).sum(), (part > 0).any(axis=1).sum())


def test_silhouette_on_the_graph(spark):
    matrix, own = planted([20, 10, 5, 1], 0.3, 0.1, 6)
    clusters = own.copy()
    clusters[[0, 1]] = [2, 1]
    members = spark.createDataFrame([(f"n{i:04d}", int(c)) for i, c in enumerate(clusters)] + [("alone", 7), ("none", None)], "node string, cluster int")
    got = {r.node: r.silhouette for r in S.graph_silhouette(weighted_frame(spark, matrix), members).collect()}
    n = len(own) + 1
    whole = np.zeros((n, n))
    whole[:-1, :-1] = matrix
    labels = np.append(clusters, 7)
    for i in range(n):
        sums = {c: whole[i, labels == c].sum() for c in set(labels.tolist())}
        size = (labels == labels[i]).sum()
        a = sums[labels[i]] / (size - 1) if size > 1 else None
        b = min(sums[c] / (labels == c).sum() for c in sums if c != labels[i])
        want = 0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b)
        assert got["alone" if i == n - 1 else f"n{i:04d}"] == pytest.approx(want)


def test_a_chain_of_a_thousand_takes_ten_rounds(spark, monkeypatch):
    rounds = []
    real = G.write_measured
    monkeypatch.setattr(G, "write_measured", lambda df, path, **m: (rounds.append(path), real(df, path, **m))[1])
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(1000)]
    out = G.closure(edge_frame(spark, chain))
    wrong = out.where((F.col("dst").cast("int") - F.col("src").cast("int")) != F.col("depth")).count()
    assert out.count() == 1000 * 1001 // 2 and wrong == 0 and len(rounds) == 10


def test_closure_from_few_and_many_seeds(spark, rows):
    rng = np.random.default_rng(9)
    pairs = [(str(a), str(b)) for a, b in rng.integers(0, 30, (45, 2))]
    seeds = spark.createDataFrame([("3",), ("7",), ("11",), ("absent",)], "n string")
    want = {p: d for p, d in brute_depths(pairs).items() if p[0] in ("3", "7", "11")}
    for few in (True, False):
        assert {(s, d): k for s, d, k in rows(G.closure(edge_frame(spark, pairs), seeds, few=few))} == want


def test_categories(spark, rows):
    family = [("t1", "T cell"), ("T cell", "leukocyte"), ("m1", "monocyte"), ("monocyte", "leukocyte"), ("n", "neuron")]
    terms = spark.createDataFrame([("t1",), ("m1",), ("n",), ("leukocyte",)], "t string")
    broad = spark.createDataFrame([("T cell",), ("leukocyte",), ("neuron",), ("monocyte",)], "b string")
    found = O.broad_matches(edge_frame(spark, family), terms, broad)
    assert rows(O.category_frequency(found)) == [("T cell", 1), ("leukocyte", 3), ("monocyte", 1), ("neuron", 1)]
    assert rows(O.most_common_category(found)) == [("leukocyte", "leukocyte"), ("m1", "leukocyte"), ("n", "neuron"), ("t1", "leukocyte")]
    ruled = O.ruled_category(found, (("monocyte", "monocyte"), ("T cell", "T cell"), ("leukocyte", "other leukocyte")))
    assert rows(ruled) == [("leukocyte", "other leukocyte"), ("m1", "monocyte"), ("n", "neuron"), ("t1", "T cell")]


def test_distance_of_unrelated_terms_is_null(spark, rows):
    df = spark.createDataFrame([(1, "a", "d"), (2, "d", "a"), (3, "b", "c"), (4, "b", "b")], "id int, x string, y string")
    assert rows(O.term_distance(df, "x", "y", edge_frame(spark, DIAMOND)), "id", "distance") == [(1, 2), (2, 2), (3, None), (4, 0)]


def test_roots_without_a_common_ancestor_stay_rows(spark, rows):
    members = spark.createDataFrame([(1, "s"), (1, "t"), (2, "u")], "cluster int, node string")
    terms = spark.createDataFrame([("s", "S", "d"), ("t", "T", "d"), ("u", "U", "d")], "id string, name string, definition string")
    weights = spark.createDataFrame([("s", 2.0)], "node string, weight double")
    found = O.common_roots(edge_frame(spark, [("s", "p"), ("t", "q"), ("u", "p")]), members)
    assert rows(O.root_names(found, terms)) == [(1, "s", False, "S"), (1, "t", False, "T"), (2, "u", True, "U")]
    report = O.cluster_report(members, found, terms, weights)
    assert rows(report, "node_id", "cluster_root_labels", "abundance") == [
        ("s", "No common root", 2.0), ("t", "No common root", 1.0), ("u", "U", 1.0)]


def test_positions_follow_the_order(spark):
    shuffled = spark.range(100).repartition(7)
    assert all(r.position == 100 - r.id for r in positioned(shuffled.orderBy("id", ascending=False)).collect())
    assert any(r.position != 100 - r.id for r in positioned(shuffled).collect())
