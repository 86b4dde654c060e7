"""What several operators share: word splitting, file contents, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType


class Spans(NamedTuple):
    """The words of a text joined by single spaces, with the place of each word."""

    joined: bytes
    starts: np.ndarray
    ends: np.ndarray

    def shingles(self, size: int) -> list[bytes]:
        """Runs of `size` words, repeats included; the whole text where it has fewer; none where it has no words."""
        n = len(self.starts)
        if n == 0:
            return []
        if n <= size:
            return [self.joined]
        text = self.joined
        return [text[a:b] for a, b in zip(self.starts[: n - size + 1].tolist(), self.ends[size - 1:].tolist())]


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; other letters stay as they are."""
    return text.lower().split() if text else []


def spans_of(words: list[bytes]) -> Spans:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return Spans(b" ".join(words), ends - sizes, ends)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once; numpy's `unique` makes a table of hashes first, which is slower."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))]


def as_bytes(column: str) -> Column:
    """A text column as bytes, so that malformed text reaches the tasks unchanged."""
    return F.col(column).cast("binary")


def crc_of(column: str) -> Column:
    """CRC-32 of a value's decimal text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def whole_parts(column: str, scale: float) -> tuple[Column, Column]:
    """Whether a vector is there with all its components finite, and its components as `floor(scale * x)`."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~odd, F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of `most` bytes, where the session leaves the limit at its default; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(most))


def fields(df: DataFrame, *columns: str) -> list[StructField]:
    """The named columns of `df` as fields that may be null."""
    return [StructField(c, df.schema[c].dataType, True) for c in columns]


def batches(schema: pa.Schema, rows: Iterator[tuple], sizes=lambda row: 64, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if size >= most:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
