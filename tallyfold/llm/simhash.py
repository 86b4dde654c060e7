"""SimHash fingerprints and groups of near copies by multi-index hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import components
from ..session import materialize
from .common import Spans, arrow_schema, as_bytes, batches, fields, spans_of, words_of

#: Buckets with more fingerprints than this are linked through shared points instead of pair by pair.
PAIRWISE = 64
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(spans: Spans, size: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in spans.shingles(size)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    per_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
    counts = np.bincount(per_byte.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(spans_of(words_of(text)), size, seed))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """`(id, fingerprint)`: the 64 bits of each whole text as a signed long."""
    schema = StructType([*fields(df, id_col), StructField("fingerprint", LongType())])
    out = arrow_schema(schema)

    def rows(source):
        for batch in source:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = fingerprint(text.as_py(), size, seed)
                yield key, value - (value >> 63 << 64)

    return df.select(id_col, as_bytes(text_col).alias(text_col)).mapInArrow(lambda source: batches(out, rows(source)), schema)


def _halves(f: Column) -> list[tuple[int, Column]]:
    return [(0, F.shiftrightunsigned(f, 32)), (1, f.bitwiseAND(F.lit(0xFFFFFFFF)))]


def _masks(weights: range) -> Column:
    """All 32-bit masks with as many bits as one of `weights`, as an array."""
    masks = [0] if 0 in weights else []
    masks += [1 << i for i in range(32)] if 1 in weights else []
    masks += [1 << i | 1 << j for i in range(32) for j in range(i)] if 2 in weights else []
    return F.array([F.lit(m).cast("long") for m in masks])


def links(distinct: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """`(child, parent)` links among distinct fingerprints that connect all pairs at 3 or fewer differing bits.

    Of two such fingerprints one 32-bit half differs in one bit at most. So each
    half is looked up with its 33 nearest values in the table of all halves, and
    the whole distance is verified. Halves that more than `pairwise` fingerprints
    share are not compared pair by pair: within such a bucket each fingerprint
    names the values near its other half (those within one bit, and for members
    of the bucket those within two), and all that name one value are linked to
    the smallest that lies within one bit of it. A link is always a true one,
    and every pair is connected through a value between the two; rows grow with
    the members, not with their square.
    """
    f = F.col("fingerprint")
    halves = distinct.select(f, F.explode(F.array([F.struct(F.lit(s).alias("half"), v.alias("value")) for s, v in _halves(f)])).alias("h"))
    table = halves.select("fingerprint", _key("h.half", F.col("h.value")).alias("key"))
    probes = halves.select("fingerprint", "h", F.explode(_masks(range(2))).alias("mask")).select(
        "fingerprint", _key("h.half", F.col("h.value").bitwiseXOR(F.col("mask"))).alias("key"), (F.col("mask") != 0).alias("beside"))
    dense = materialize(table.groupBy("key").count().where(F.col("count") > pairwise).select("key"), "dense")

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3
    pairs = (
        probes.select(F.col("fingerprint").alias("a"), "key").hint("merge")  # its size is not seen before it is spread out
        .join(table.join(dense, "key", "left_anti").select(F.col("fingerprint").alias("b"), "key").hint("merge"), "key")
        .where((F.col("a") < F.col("b")) & near).select(F.col("b").alias("child"), F.col("a").alias("parent")))

    owners = probes.join(dense, "key", "left_semi")
    other = F.when(F.shiftrightunsigned("key", 32) == 0, f.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(f, 32))
    points = owners.select("fingerprint", "key", "beside", other.alias("other"), F.explode(F.array(
        F.struct(F.lit(False).alias("far"), _masks(range(2)).alias("masks")),
        F.when(~F.col("beside"), F.struct(F.lit(True).alias("far"), _masks(range(2, 3)).alias("masks"))))).alias("r"))
    points = points.where("r is not null").select(
        "fingerprint", "key", (F.col("beside") | F.col("r.far")).alias("outer"), "other", F.explode("r.masks").alias("mask"))
    points = points.select("fingerprint", "key", "outer", F.col("other").bitwiseXOR(F.col("mask")).alias("point"))
    centres = points.where(~F.col("outer")).groupBy("key", "point").agg(F.min("fingerprint").alias("centre"))
    stars = points.hint("merge").join(centres.hint("merge"), ["key", "point"]).where("fingerprint <> centre").select(
        F.greatest("fingerprint", "centre").alias("child"), F.least("fingerprint", "centre").alias("parent"))
    return pairs.unionByName(stars).distinct()


def _key(half: str, value: Column) -> Column:
    """Number of the half and its 32 bits as one long."""
    return F.shiftleft(F.col(half).cast("long"), 32).bitwiseOR(value)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42,
                pairwise: int = PAIRWISE) -> DataFrame:
    """`(id, fingerprint, component_id)`: the smallest id that can be reached over fingerprints at 3 or fewer differing bits.

    Fingerprints are made once and written out; equal ones are one node of the
    graph, so copies cost one row each. Texts without a word (null, empty, white
    space) have fingerprint zero and are linked like any other. Every row stays,
    also repeated ones and those with a null id; a null id names no component
    unless it has no other. Other columns are not read.
    """
    marks = materialize(fingerprints(df, id_col, text_col, size, seed), "fingerprints")
    distinct = materialize(marks.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct")
    linked = materialize(components(links(distinct.select("fingerprint"), pairwise)), "linked")
    named = distinct.join(linked.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marks.join(named.join(least, "component").select("fingerprint", "component_id"), "fingerprint").select(
        id_col, "fingerprint", "component_id")


def as_hex(f: Column) -> Column:
    return F.lpad(F.lower(F.hex(f)), 16, "0")
