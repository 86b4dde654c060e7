"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType)

from ..session import cleared_shuffles, materialize
from .common import arrow_schema, as_bytes, batches, fields, words_of

#: The model has 2^BITS weights.
BITS = 18
#: Parts that are trained side by side and averaged after each round; in a round a part goes through its rows PASSES times.
PARTS, ROUNDS, PASSES = 4, 4, 3
#: Labelled rows for which there are PARTS parts; so many more parts as there are more rows, and all rows are learnt from.
MAX_ROWS = 20_000
#: Labels that are sent to all tasks; more of them are joined.
MAX_SENT = 4_000_000
#: Sums of parts are added up as multiples of 1 / UNIT, so their order does not show; coarser ones where there are more parts.
UNIT = 2.0 ** 36
#: What may stand at the end of a word.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Hashes of words that a worker remembers.
REMEMBERED = 50_000


@dataclass(frozen=True)
class Rule:
    """Constants of the updates: learning rate, its offset, and the weights of the two penalties."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.005

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weights that minimise the regularised sum of gradients `z`, given the sums of squared gradients `n`."""
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


class _Hashes(dict):
    """The hash of a word in the lower 32 bits, that of the marks at its end in the upper ones."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | zlib.crc32(word[len(word.rstrip(MARKS)):]) << 32
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_hash = _Hashes()


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes of a whole text and their values.

    Two groups of hashed n-grams: the words and the pairs of words; and what
    holds for words never seen before, the marks at the end of each word and
    whether the words of a pair are equal. Their places are 2^bits - 1; the last
    place is the bias, which every text has, so an empty text has a score too.
    A value is `log(1 + count)`, and the values of a group have length one.
    """
    words = words_of(text)
    bias = (1 << bits) - 1
    if not words:
        return np.array([bias], np.int64), np.array([1.0])
    both = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    one, marks = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    pair = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    groups = [[one * np.uint64(0xD6E8FEB86659FD93), pair ^ (pair >> np.uint64(29))],
              [marks * np.uint64(0xA24BAED4963EE407), (one[:-1] == one[1:]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1 << 60)]]
    places, values = [], []
    for group in groups:
        place, count = np.unique((np.concatenate(group) >> np.uint64(24)) % np.uint64(bias), return_counts=True)
        value = np.log1p(count)
        places.append(place.astype(np.int64))
        values.append(value / np.sqrt((value * value).sum()))
    place, at = np.unique(np.concatenate(places), return_inverse=True)
    return np.append(place, bias), np.append(np.bincount(at, np.concatenate(values)), 1.0)


def probability(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, margin)))))


def _packed(places: np.ndarray, values: np.ndarray) -> bytes:
    """A row of features in few bytes: steps between places and numbers of distinct values, bytes of equal place side by side."""
    some, at = np.unique(values.astype("<f4"), return_inverse=True)
    numbers = np.stack([np.diff(places, prepend=0), at]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(len(some).to_bytes(4, "little") + some.tobytes() + numbers.tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    start = 4 + 4 * int.from_bytes(raw[:4], "little")
    steps, at = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=start).reshape(4, -1).T).view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), np.frombuffer(raw, "<f4", len(raw[4:start]) // 4, 4)[at]


def _learnt_from(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bits: int,
                 max_rows: int | None) -> tuple[DataFrame, int]:
    """`(part, turn, label, packed)` of the labelled documents, and the number of parts.

    Up to MAX_SENT labels go to all tasks, so that the texts of other documents
    never leave their scan; more are joined by whatever way Spark finds.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    if max_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows)
    chosen = materialize(chosen, "labels")
    chosen = F.broadcast(chosen) if chosen.count() <= MAX_SENT else chosen
    picked = docs.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("text")).join(chosen, "_id")
    picked = picked.select(F.xxhash64("_id").alias("spot"), F.xxhash64("_id", F.lit(1)).alias("turn"), "label", "text")
    schema = StructType([StructField("spot", LongType()), StructField("turn", LongType()), StructField("label", IntegerType()),
                         StructField("packed", BinaryType())])
    out = arrow_schema(schema)

    def rows(source) -> Iterator[tuple]:
        for batch in source:
            spot, turn, label, texts = batch.columns
            for p, t, y, text in zip(spot.to_pylist(), turn.to_pylist(), label.to_pylist(), texts):
                yield p, t, y, _packed(*features(text.as_py(), bits))

    table = materialize(picked.mapInArrow(lambda s: batches(out, rows(s), lambda r: 60 + len(r[3])), schema), "features")
    parts = PARTS * max(1, math.ceil(table.count() / MAX_ROWS))
    return table.select(F.pmod("spot", F.lit(parts)).cast("int").alias("part"), "turn", "label", "packed"), parts


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  bits: int = BITS, max_rows: int | None = None) -> DataFrame:
    """`(part, turn, label, places, values)` of all labelled documents, or of `max_rows` whose ids have the smallest hashes.

    Null ids and labels other than 0 and 1 are left out; a document with both
    labels counts for each.
    """
    table, _ = _learnt_from(docs, labels, id_col, text_col, label_col, bits, max_rows)
    schema = StructType([
        StructField("part", IntegerType()), StructField("turn", LongType()), StructField("label", IntegerType()),
        StructField("places", ArrayType(IntegerType())), StructField("values", ArrayType(FloatType()))])
    out = arrow_schema(schema)

    def rows(source) -> Iterator[tuple]:
        for batch in source:
            for *others, packed in zip(*(c.to_pylist() for c in batch.columns)):
                yield *others, *_unpacked(packed)

    return table.mapInArrow(lambda s: batches(out, rows(s), lambda r: 40 + 8 * len(r[3])), schema)


def _trained(size: int, rule: Rule, state) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What the rows of one part change in the state, as a function of these rows."""

    def one_part(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in state.value)
        touched = np.zeros(size, bool)
        ordered = rows.sort_values(["turn", "label"])
        ordered = [(label, *_unpacked(packed)) for label, packed in zip(ordered["label"], ordered["packed"])]
        for label, places, values in ordered * PASSES:
            w = rule.weights(z[places], n[places])
            g = (probability(float(w @ values)) - label) * values
            after = n[places] + g * g
            z[places] += g - (np.sqrt(after) - np.sqrt(n[places])) / rule.alpha * w
            n[places] = after
            touched[places] = True
        at = np.flatnonzero(touched)
        return pd.DataFrame({"place": at, "z": z[at] - state.value[0][at], "n": n[at] - state.value[1][at]})

    return one_part


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          bits: int = BITS, max_rows: int | None = None, rounds: int = ROUNDS, rule: Rule = Rule()) -> np.ndarray:
    """2^bits weights, the last one the bias. Without a labelled document all are zero and every score is 0.5.

    It learns from all labelled documents, unless `max_rows` is given. The rows
    fall into parts by the hash of their id, PARTS of them for each MAX_ROWS
    rows. In each round every part goes through its rows in a fixed order,
    PASSES times, updating its own copy of the state, and the states are
    averaged; the result does not depend on the number of tasks. A part holds
    its rows, about MAX_ROWS / PARTS, and the driver 2^bits sums.
    """
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    schema = StructType([StructField("place", IntegerType()), StructField("z", DoubleType()), StructField("n", DoubleType())])
    with cleared_shuffles(docs.sparkSession):
        table, parts = _learnt_from(docs, labels, id_col, text_col, label_col, bits, max_rows)
        unit = UNIT * PARTS / parts
        summed = [F.sum(F.round(F.col(c) * unit).cast("long")).alias(c) for c in ("z", "n")]
        for _ in range(rounds):
            state = table.sparkSession.sparkContext.broadcast((z, n))
            moved = table.groupBy("part").applyInPandas(_trained(size, rule, state), schema)
            moved = moved.groupBy("place").agg(*summed, F.count(F.lit(1)).alias("parts")).toArrow()
            # the mean is over the parts that moved a place, PARTS of them at least; so a place that few have seen keeps its state
            at, of = moved["place"].to_numpy(), np.maximum(moved["parts"].to_numpy(), PARTS) * unit
            z[at] += moved["z"].to_numpy() / of
            n[at] += moved["n"].to_numpy() / of
            state.unpersist()
    return rule.weights(z, n)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`(id, *keep, score)`: probability of label 1 for each whole text, a sparse dot product with the weights.

    Null and empty texts get the score of the bias. Every row is scored on its
    own, also repeated ones and those without an id; no other column is read.
    """
    schema = StructType([*fields(docs, id_col, *keep), StructField("score", DoubleType())])
    out, bits = arrow_schema(schema), int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(source) -> Iterator[tuple]:
        w = shared.value
        for batch in source:
            kept = [c.to_pylist() for c in batch.columns[:-1]]
            for *others, text in zip(*kept, batch.columns[-1]):
                places, values = features(text.as_py(), bits)
                yield *others, probability(float(w[places] @ values))

    texts = docs.select(id_col, *keep, as_bytes(text_col).alias("_text"))
    return texts.mapInArrow(lambda s: batches(out, rows(s)), schema)


def well_scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `least` or more, with all their columns, whatever these are called.

    Tasks see the texts alone; all other columns stay where they are.
    """
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        w, found = shared.value, []
        for text in texts:
            places, values = features(text.as_py(), bits)
            found.append(probability(float(w[places] @ values)))
        return pa.array(found, pa.float64())

    return docs.where(scores(as_bytes(text_col)) >= least)
