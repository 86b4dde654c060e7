"""Spectral clusters of weighted undirected graphs, and the silhouette of clusters on the graph itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, shared_folder

#: Vectors that are iterated beside the wanted ones, and the residual from which the wanted ones count as found.
EXTRA, TOLERANCE = 4, 1e-4
#: Columns that are shorter than the longest by this factor are rounding errors.
ROUNDING = 1e-9
#: Nodes of a block, about, and rounds after which the vectors are written once.
BLOCK, KEPT_ROUNDS = 100_000, 10
#: Starts of k-means, the rows (of smallest hash, about) that they are chosen on, and rounds over all rows.
STARTS, SAMPLE, MEANS_ROUNDS = 10, 5000, 10


class Spectrum(NamedTuple):
    """`vectors` is `(node, root_degree, vector)`, a component for each of `values`; `rounds` were taken."""

    values: np.ndarray
    vectors: DataFrame
    rounds: int


def _both_ways(weighted: DataFrame) -> DataFrame:
    """`(src, dst, weight)`: each edge from both ends, repeated edges added up."""
    known = weighted.where("weight > 0 AND a <> b").select("a", "b", F.col("weight").cast("double").alias("weight"))
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return materialize(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), "both-ways")


class _Block(NamedTuple):
    """The share of one block of nodes in the matrix, and what it sends to and gets from its neighbours.

    Entries that the block multiplies itself are sorted by row, an entry of
    `starts` for each of `rows`; their columns count the block's own nodes, then
    the vectors that arrive, by number of the neighbour. Of two neighbours each
    sends the other vectors of its nodes or sums for the other's nodes,
    whichever are fewer: `out` has `(neighbour, nodes, weights, starts)`, the
    latter two for sums; `into` `(neighbour, nodes that get sums)`, or None.
    """

    number: int
    rows: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    out: list[tuple]
    into: list[tuple]


class _Share(NamedTuple):
    """Rows of a block in the iterated vectors and last directions with their images, one vector after the other."""

    block: _Block
    x: np.ndarray
    ax: np.ndarray
    p: np.ndarray | None = None
    ap: np.ndarray | None = None
    ar: np.ndarray | None = None


def _dealt(rows: DataFrame, blocks: int, most: int = 1_000_000) -> RDD:
    """One element for each block: the rows with its number in the first column as one Arrow table, or None."""
    def run(source):
        def packed(held):
            table = pa.Table.from_batches(held)
            number = table.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            names, first = np.unique(number[order], return_index=True)
            table = table.take(order)
            for name, start, end in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table.slice(start, end - start).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([sink.getvalue().to_pybytes()])], names=["number", "rows"])

        held, size = [], 0
        for batch in source:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def joined(source):
        found = [pa.ipc.open_stream(data).read_all() for _, data in source]
        yield pa.concat_tables(found) if found else None

    return rows.mapInArrow(run, "number int, rows binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(blocks, int).mapPartitions(joined)


def _wired(number: int, size: int, edges: pa.Table | None) -> _Block:
    """The block of `(place, peer, other, weight)`, the edges from its nodes; each edge is also known to its other end."""
    if edges is None:
        none = np.zeros(0, np.int32)
        return _Block(number, none, none, none, np.zeros(0), [], [])
    place, peer, other, weight = (edges.column(c).to_numpy() for c in ("place", "peer", "other", "weight"))
    order = np.lexsort((place, other, peer))
    place, peer, other, weight = (v[order] for v in (place, peer, other, weight))
    names, first = np.unique(peer, return_index=True)
    rows, columns, weights, out, into, width = [], [], [], [], [], size
    for name, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(peer)]):
        s, o, w = place[a:b], other[a:b], weight[a:b]
        here, there = np.unique(s), np.unique(o)
        if name != number:
            out.append((name, s, w, np.searchsorted(o, there)) if len(there) < len(here) else (name, here, None, None))
            into.append((name, here if len(here) < len(there) else None))
            if len(here) < len(there):
                continue
            o = width + np.searchsorted(there, o)
            width += len(there)
        rows.append(s)
        columns.append(o.astype(np.int32))
        weights.append(w)
    rows, columns, weights = (np.concatenate([v[:0], *vs]) for v, vs in ((place, rows), (np.zeros(0, np.int32), columns), (weight, weights)))
    order = np.argsort(rows, kind="stable")
    rows, starts = np.unique(rows[order], return_index=True)
    return _Block(number, rows, starts, columns[order], weights[order], out, into)


def _sent(block: _Block, v: np.ndarray) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
    """What the neighbours need of the vectors `v` for their part of the product."""
    for name, places, weights, starts in block.out:
        if weights is None:
            yield name, (block.number, v[:, places])
        else:
            yield name, (block.number, np.stack([np.add.reduceat(row[places] * weights, starts) for row in v]))


def _image(block: _Block, v: np.ndarray, came: dict[int, np.ndarray]) -> np.ndarray:
    """Rows of the block in the matrix times the vectors `v`, given what the neighbours sent."""
    wide = np.concatenate([v, *[came[name] for name, places in block.into if places is None]], axis=1)
    out = np.zeros_like(v)
    if len(block.rows):
        for i, row in enumerate(wide):
            out[i, block.rows] = np.add.reduceat(row[block.columns] * block.weights, block.starts)
    for name, places in block.into:
        if places is not None:
            out[:, places] += came[name]
    return out


def _with_image(shares: RDD, blocks: int, of: Callable[[_Share], np.ndarray], name: str) -> RDD:
    """The shares with the matrix times the vectors `of` them as `name`. Only what crosses blocks is shuffled."""
    came = shares.flatMap(lambda s: _sent(s.block, of(s))).partitionBy(blocks, int).mapPartitions(lambda m: [dict(v for _, v in m)])
    return shares.zip(came).map(lambda z: z[0]._replace(**{name: _image(z[0].block, of(z[0]), z[1])})).persist(StorageLevel.MEMORY_AND_DISK)


def _gram(shares: RDD, parts: Callable[[_Share], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the vectors with themselves and with their images; tasks send one small matrix each."""
    def run(share):
        s, a = parts(share)
        return np.stack([s @ s.T, s @ a.T])

    return tuple(np.sum(shares.map(run).collect(), axis=0))


def _parts(share: _Share, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, residuals and last directions one below the other, and their images."""
    s, a = [share.x, _residual(share, values)], [share.ax, share.ar]
    if share.p is not None:
        s, a = [*s, share.p], [*a, share.ap]
    return np.concatenate(s), np.concatenate(a)


def _residual(share: _Share, values: np.ndarray) -> np.ndarray:
    return share.ax - share.x * values[:, None]


def _combined(shares: RDD, values: np.ndarray, mix: np.ndarray, moved: np.ndarray) -> RDD:
    """The next vectors and directions as combinations of the parts, and their images as those of the images."""
    def run(share):
        s, a = _parts(share, values)
        return _Share(share.block, mix.T @ s, mix.T @ a, moved.T @ s, moved.T @ a)

    return shares.map(run)


def _best(gram: np.ndarray, image: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest values on the span of the columns, and the combinations that have them; dependent columns drop out.

    So do columns that are mere rounding, like the residual of a vector found exactly.
    """
    norm = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.where(norm > ROUNDING * norm.max(), 1 / np.maximum(norm, 1e-300), 0)
    size, turn = np.linalg.eigh(gram * scale[:, None] * scale[None])
    kept = size > 1e-10 * size[-1]
    basis = scale[:, None] * turn[:, kept] / np.sqrt(size[kept])
    value, mix = np.linalg.eigh(basis.T @ ((image + image.T) / 2) @ basis)
    return value[::-1][:width], (basis @ mix)[:, ::-1][:, :width]


def _blocks(links: DataFrame, width: int) -> tuple[DataFrame, RDD, int, int]:
    """`(id, root_degree, at)` of all nodes, the shares at the start, the number of blocks and of nodes."""
    spark = links.sparkSession
    degrees = links.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.sum("weight")).alias("root_degree"))
    degrees = materialize(degrees, "degrees")
    nodes = degrees.count()
    width = min(width, nodes)
    blocks = max(-(-nodes // BLOCK), min(spark.sparkContext.defaultParallelism, -(-nodes // 2000)), 1)
    # neighbours by id share a block, which spares shuffles where ids follow the graph and does no harm elsewhere
    numbers = degrees.repartitionByRange(blocks, "id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())
    numbers = materialize(numbers, "numbers")
    blocks = max(blocks, (numbers.agg(F.max(F.shiftright("at", 33)).alias("last")).first().last or 0) + 1)
    block, place = (lambda c: F.shiftright(c, 33).cast("int")), (lambda c: F.col(c).bitwiseAND((1 << 33) - 1).cast("int"))
    d, e = (numbers.select(F.col("id").alias(n), F.col("root_degree").alias(f"_{n}"), F.col("at").alias(f"{n}_at")) for n in ("src", "dst"))
    edges = links.join(d, "src").join(e, "dst").select(
        block("src_at").alias("block"), place("src_at").alias("place"), block("dst_at").alias("peer"), place("dst_at").alias("other"),
        (F.col("weight") / F.col("_src") / F.col("_dst")).alias("weight"))
    draws = [F.xxhash64("id", F.lit(i)) / F.lit(2.0 ** 63) for i in range(width - 1)]
    first = numbers.select(block("at").alias("block"), place("at").alias("place"), F.array("root_degree", *draws).alias("x"))

    def share(number, pairs):
        for rows, start in pairs:
            size = start.num_rows if start else 0
            x = np.zeros((width, size))
            if start:
                x[:, start.column("place").to_numpy()] = start.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width).T
            yield _Share(_wired(number, size, rows), x, np.zeros((width, 0)))

    shares = _dealt(edges, blocks).zip(_dealt(first, blocks)).mapPartitionsWithIndex(share)
    return numbers, shares, blocks, nodes


def _vectors(shares: RDD, numbers: DataFrame, k: int) -> DataFrame:
    """`(node, root_degree, vector)` with the first k components."""
    def run(source):
        for batch in source:
            for number, width, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = np.frombuffer(data).reshape(width, -1).T
                for i in range(0, len(rows), 50_000):
                    part = np.ascontiguousarray(rows[i:i + 50_000])
                    at = (number << 33) + np.arange(i, i + len(part))
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(at), vectors], names=["at", "vector"])

    packed = shares.map(lambda s: (s.block.number, len(s.x[:k]), s.x[:k].tobytes()))
    packed = numbers.sparkSession.createDataFrame(packed, "block int, width int, x binary")
    rows = packed.mapInArrow(run, "at long, vector array<double>")
    return materialize(numbers.join(rows, "at").select(F.col("id").alias("node"), "root_degree", "vector"), "vectors")


def smallest_eigenvectors(weighted: DataFrame, k: int, max_rounds: int = 60, tolerance: float = TOLERANCE, extra: int = EXTRA) -> Spectrum:
    """The k smallest eigenvalues of the normalised Laplacian of `(a, b, weight)` with their vectors.

    Blocks of k and some more vectors are improved together: a round multiplies
    the matrix with the residuals and takes the best combinations of vectors,
    residuals and last directions, for which only their inner products reach
    the driver. It ends when all residuals are below the tolerance. The start
    depends on hashes of the nodes alone, so the result does not depend on
    partitions but for rounding.

    The nodes are dealt to blocks of `BLOCK` about, which keep their rows of all
    vectors and of the matrix, in memory or on the executors' disks; a round
    shuffles only residuals, or sums of them, across blocks. Every
    `KEPT_ROUNDS` rounds the vectors are checkpointed, so that a lost executor
    does not cost all rounds and older shuffles can go.
    """
    links = _both_ways(weighted)
    sc = links.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(links.sparkSession))
    numbers, shares, blocks, nodes = _blocks(links, k + extra)
    if not nodes:
        return Spectrum(np.zeros(0), numbers.select(F.col("id").alias("node"), "root_degree", F.array().cast("array<double>").alias("vector")), 0)
    held = _with_image(shares, blocks, lambda s: s.x, "ax")
    values, mix = _best(*_gram(held, lambda s: (s.x, s.ax)), min(k + extra, nodes))
    shares = held.map(lambda s, m=mix: s._replace(x=m.T @ s.x, ax=m.T @ s.ax))
    for turn in range(1, max_rounds + 1):
        wide = _with_image(shares, blocks, lambda s, v=values: _residual(s, v), "ar")
        if turn % KEPT_ROUNDS == 0:
            wide.checkpoint()
        gram, image = _gram(wide, lambda s, v=values: _parts(s, v))
        n = len(values)
        left = np.sqrt(np.maximum(np.diag(gram)[n:2 * n], 0))
        if (left[:k] < tolerance).all():
            wide.unpersist()
            break
        after, mix = _best(gram, image, n)
        moved = mix.copy()
        moved[:n] = 0
        shares = _combined(wide, values, mix, moved)
        held.unpersist()
        held, values = wide, after
    found = _vectors(shares, numbers, k)
    held.unpersist()
    return Spectrum(1 - values[:k], found, turn)


def _nearest(centres: np.ndarray):
    terms = []
    for i, c in enumerate(centres):
        square = " + ".join(f"pow(place[{j}] - ({float(v)!r}D), 2)" for j, v in enumerate(c))
        terms.append(f"named_struct('d', {square}, 'cluster', {i})")
    return F.expr(f"array_min(array({', '.join(terms)}))")


def _starts(sample: np.ndarray, k: int, starts: int) -> np.ndarray:
    """The centres of the best of several k-means runs on a sample, each from centres drawn far apart."""
    rng, best = np.random.default_rng(0), (np.inf, sample[:k])
    for _ in range(starts):
        centres = sample[[rng.integers(len(sample))]]
        while len(centres) < k:
            far = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            if far.sum() <= 0:
                break
            centres = np.vstack([centres, sample[rng.choice(len(sample), p=far / far.sum())]])
        for _ in range(50):
            far = ((sample[:, None] - centres[None]) ** 2).sum(axis=2)
            own = far.argmin(axis=1)
            after = np.array([sample[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
            if np.allclose(after, centres):
                break
            centres = after
        best = min(best, (far.min(axis=1).sum(), centres), key=lambda b: b[0])
    return best[1]


def spectral_clusters(weighted: DataFrame, k: int, max_rounds: int = 60, starts: int = STARTS) -> DataFrame:
    """`(node, cluster)`: k groups of the nodes of `(a, b, weight)`, numbered from 0 by their smallest node.

    Nodes are placed by the k smallest eigenvectors of the normalised Laplacian
    over the roots of their degrees, and grouped by k-means: several starts on a
    sample of `SAMPLE` nodes about, the best of them refined over all nodes.
    Edges without a positive weight and loops do not count; a graph with fewer
    nodes than k has a group for each.
    """
    spectrum = smallest_eigenvectors(weighted, k, max_rounds)
    placed = materialize(spectrum.vectors.select(
        "node", F.transform("vector", lambda v: v / F.col("root_degree")).alias("place")), "placed")
    nodes = placed.count()
    if not nodes:
        return placed.select("node", F.lit(0).alias("cluster"))
    cut = min(1.0, SAMPLE / nodes)
    sample = placed.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < int(cut * (1 << 20)) + 1)
    sample = np.array([r.place for r in sorted(sample.collect(), key=lambda r: str(r.node))]).reshape(-1, len(spectrum.values))
    centres = _starts(sample, min(k, nodes), starts)
    width = centres.shape[1]
    for _ in range(MEANS_ROUNDS):
        sums = placed.select("place", _nearest(centres)["cluster"].alias("cluster")).groupBy("cluster").agg(
            *[F.avg(F.col("place")[i]).alias(f"m{i}") for i in range(width)]).collect()
        after = centres.copy()
        for r in sums:
            after[r.cluster] = [r[f"m{i}"] for i in range(width)]
        if np.allclose(after, centres, atol=1e-9):
            break
        centres = after
    found = materialize(placed.select("node", _nearest(centres)["cluster"].alias("_own")), "own")
    order = {r["_own"]: i for i, r in enumerate(sorted(found.groupBy("_own").agg(F.min("node").alias("least")).collect(), key=lambda r: r.least))}
    number = F.expr(f"array({','.join(str(order.get(i, 0)) for i in range(len(centres)))})")
    return found.select("node", number[F.col("_own")].alias("cluster"))


def graph_silhouette(weighted: DataFrame, membership: DataFrame) -> DataFrame:
    """`(node, cluster, own, other, silhouette)` with the weights of the edges `(a, b, weight)` taken as distances.

    Pairs without an edge are 0 apart, and count through the sizes of their
    clusters only: no more is held than the sums of each node and cluster that
    an edge joins. `own` is the mean over the other nodes of the cluster,
    `other` the smallest mean over another one; a node alone in its cluster, or
    with both zero, has silhouette 0. Edges count once for each end; nodes
    without a cluster do not count.
    """
    members = materialize(membership.select("node", "cluster").where("cluster IS NOT NULL").distinct(), "members")
    sizes = materialize(members.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    edges = weighted.where("a <> b").select("a", "b", "weight")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    sums = both.join(members.select(F.col("node").alias("b"), F.col("cluster").alias("_to")), "b").groupBy(
        F.col("a").alias("node"), "_to").agg(F.sum("weight").alias("_sum"))
    sums = sums.join(sizes.select(F.col("cluster").alias("_to"), F.col("size").alias("_n")), "_to")
    own = F.col("_to") == F.col("cluster")
    met = members.join(sums, "node").groupBy("node").agg(
        F.sum(F.when(own, F.col("_sum"))).alias("_inside"), F.count(F.when(~own, 1)).alias("_met"),
        F.min(F.when(~own, F.col("_sum") / F.col("_n"))).alias("_least"))
    clusters = sizes.agg(F.count("*")).scalar()
    nothing = F.lit(0.0)
    least = F.when(F.coalesce("_met", F.lit(0)) < clusters - 1, F.least(F.coalesce("_least", nothing), nothing)).otherwise(F.col("_least"))
    rows = members.join(met, "node", "left").join(sizes, "cluster").select(
        "node", "cluster", F.when(F.col("size") > 1, F.coalesce("_inside", nothing) / (F.col("size") - 1)).alias("own"), least.alias("other"))
    largest = F.greatest("own", "other")
    score = F.when(F.col("own").isNull() | F.col("other").isNull() | (largest == 0), nothing).otherwise((F.col("other") - F.col("own")) / largest)
    return rows.withColumn("silhouette", score)
