"""Passages of benchmark items in documents, by fingerprints of windows of the items' sizes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import materialize
from .common import Spans, arrow_schema, as_bytes, batches, distinct, fields, spans_of, words_of

#: Words in a shingle, and the similarity from which a window counts as a copy of an item.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints have 128 bits in blocks of 16, and a block finds the items that differ in BALL of its bits or fewer: one
#: pair of unrelated fingerprints in 59. Two fingerprints that differ in RADIUS bits or fewer always meet so. Windows of
#: similarity 0.8 differ in about 19 bits, 2.4 of a block, and one in 750 of them meets in no block; these are found by the
#: number of their shingles that an item has.
BLOCKS, BALL = 8, 2
RADIUS = BLOCKS * (BALL + 1) - 1
_BALL_MASKS = np.array([m for m in range(1 << 16) if m.bit_count() <= BALL], np.uint16)
#: Bytes of item text that are sent to the tasks at once; a larger benchmark takes several passes over the documents.
MAX_ITEM_BYTES = 16 << 20
#: Hashes of words that a worker remembers, windows that are looked at in one go, and pairs of places and items, about.
REMEMBERED, AT_ONCE, HELD = 50_000, 2048, 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_hash = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash for each run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, size):
        total = total * _STEP + hashes[i:i + n]
    total ^= total >> np.uint64(33)
    total *= np.uint64(0xFF51AFD7ED558CCD)
    total ^= total >> np.uint64(33)
    total *= np.uint64(0xC4CEB9FE1A85EC53)
    return total ^ (total >> np.uint64(33))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_fingerprints(hashes: np.ndarray, shingles: int) -> np.ndarray:
    """Fingerprints, as blocks of 16 bits, of all runs of `shingles` shingles: a bit is 1 if more than half of them have it.

    The second half of the bits comes from another hash of the same shingles.
    """
    other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    bits = np.concatenate([_bits(hashes), _bits(other ^ (other >> np.uint64(35)))], axis=1)
    sums = np.concatenate([np.zeros((1, 16 * BLOCKS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits((sums[shingles:] - sums[:-shingles]) * 2 > shingles, axis=1, bitorder="little").view("<u2")


@dataclass
class Item:
    """A benchmark text: its words, the size of its shingles, their hashes and counts."""

    item_id: object
    words: list[bytes]
    shingle: int
    hashes: np.ndarray
    counts: Counter

    @classmethod
    def of(cls, item_id, text: bytes | None, shingle: int) -> "Item | None":
        words = words_of(text)
        if not words:
            return None
        size = min(shingle, len(words))
        return cls(item_id, words, size, run_hashes(word_hashes(words), size), Counter(spans_of(words).shingles(size)))


class SizeTable:
    """Items of one number of words, with their fingerprints in a table per block.

    The table of a block lists each value in the small Hamming ball of an item's
    block with the item, sorted by value, so its size goes by the items alone. A
    window looks up one value per block.
    """

    def __init__(self, items: list[Item]):
        self.items = items
        self.words, self.shingle = len(items[0].words), items[0].shingle
        self.shingles = self.words - self.shingle + 1
        self.prints = np.concatenate([window_fingerprints(i.hashes, self.shingles) for i in items])
        self.values, self.items_at = [], []
        for b in range(BLOCKS):
            values = (self.prints[:, b, None] ^ _BALL_MASKS[None]).ravel()
            order = np.argsort(values, kind="stable")
            self.values.append(values[order])
            self.items_at.append((order // len(_BALL_MASKS)).astype(np.int32))
        pairs = np.unique(np.array([(h, i) for i, item in enumerate(items) for h in item.hashes.tolist()], np.uint64), axis=0)
        self.known, self.of = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items and distances of all pairs that meet in a block, by distance, then by window."""
        pairs = []
        for b in range(BLOCKS):
            first = np.searchsorted(self.values[b], prints[:, b])
            n = np.searchsorted(self.values[b], prints[:, b], side="right") - first
            window = np.repeat(np.arange(len(prints)), n)
            pairs.append(window * len(self.items) + self.items_at[b][_ranges(first, n)])
        window, item = np.divmod(distinct(np.concatenate(pairs)), len(self.items))
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        order = np.lexsort((window, distance))
        return window[order], item[order], distance[order]

    def crowded(self, places: np.ndarray, runs: np.ndarray, threshold: float) -> set[tuple[int, int]]:
        """Starts and items of all windows with so many shingles of an item that they may reach the threshold.

        `places` are all runs that an item of this size has, in order. Any other
        pair shares fewer shingles, so it does not reach the threshold.
        """
        shingles = min(self.shingles, len(runs))
        need = max(1, math.ceil(threshold * (shingles + self.shingles) / (1 + threshold) - 1e-9))
        if len(places) < need:
            return set()
        first = np.searchsorted(self.known, runs[places])
        n = np.searchsorted(self.known, runs[places], side="right") - first
        counts, held = np.zeros(len(self.items), np.int64), []
        # a shingle may be one of very many items, so only those of items that have enough places are held
        cuts = np.searchsorted(np.cumsum(n), np.arange(HELD, n.sum(), HELD))
        blocks = list(zip(*(np.split(x, cuts) for x in (places, first, n))))
        for _, start, size in blocks:
            counts += np.bincount(self.of[_ranges(start, size)], minlength=len(counts))
        enough = counts >= need
        if not enough.any():
            return set()
        for place, start, size in blocks:
            item = self.of[_ranges(start, size)]
            kept = np.flatnonzero(enough[item])
            held.append((item[kept], np.repeat(place, size)[kept]))
        item, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        to = np.arange(need - 1, len(place))
        at = np.flatnonzero((item[to] == item[to - need + 1]) & (place[to] - place[to - need + 1] < shingles))
        low = np.maximum(0, place[to[at]] - shingles + 1)
        high = np.minimum(place[at], max(0, len(runs) - shingles))
        return {(s, i) for a, b, i in zip(low.tolist(), high.tolist(), item[at].tolist()) for s in range(a, b + 1)}


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """`n` numbers from `first` on, for each of them."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """Items by size, and the shingles that any of them has."""

    def __init__(self, items: list[Item]):
        by_words: dict[int, list[Item]] = {}
        for item in items:
            by_words.setdefault(len(item.words), []).append(item)
        self.tables = {n: SizeTable(group) for n, group in by_words.items()}
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({i.shingle for i in items}):
            pairs = np.unique(np.array([(h, len(i.words)) for i in items if i.shingle == size for h in i.hashes.tolist()], np.uint64), axis=0)
            bits = max(16, int(len(pairs)).bit_length() + 4)
            marks = np.zeros(1 << bits, bool)
            marks[(pairs[:, 0] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.shingles[size] = (pairs[:, 0], pairs[:, 1].astype(np.int64), marks)

    def starts(self, hashes: dict[int, np.ndarray], total: int) -> Iterator[tuple[SizeTable, np.ndarray, np.ndarray]]:
        """For each size the starts of its windows that hold a shingle of an item of that size, and the places of these shingles.

        Other windows have no shingle in common with any such item, so their similarity is zero.
        """
        hits: dict[int, list[np.ndarray]] = {}
        for size, (known, words, marks) in self.shingles.items():
            runs = hashes[size]
            at = np.flatnonzero(marks[(runs >> np.uint64(64 - int(len(marks)).bit_length() + 1)).astype(np.int64)])
            first, last = np.searchsorted(known, runs[at]), np.searchsorted(known, runs[at], side="right")
            for place, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
                for n in words[a:b].tolist():
                    hits.setdefault(n, []).append(place)
        for n, places in sorted(hits.items()):
            table = self.tables[n]
            last = max(0, total - n)
            change = np.zeros(last + 2, np.int64)
            p = np.array(places)
            np.add.at(change, np.clip(p - table.shingles + 1, 0, last), 1)
            np.add.at(change, np.clip(p, 0, last) + 1, -1)
            yield table, np.flatnonzero(np.cumsum(change)[:-1] > 0), p


def similarity(a: Counter, b: Counter) -> float:
    """Shared shingles by their counts: the sum of the smaller counts over the sum of the larger ones."""
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


def matches(text: bytes | None, index: Index, threshold: float) -> Iterator[tuple]:
    """`(item, start, words, distance, similarity)` of the best window for each item that reaches the threshold."""
    words = words_of(text)
    if not words:
        return
    one = word_hashes(words)
    hashes = {size: run_hashes(one, size) for size in index.shingles}
    spans: Spans | None = None
    for table, starts, places in index.starts(hashes, len(words)):
        runs = hashes[table.shingle]
        shingles = min(table.shingles, len(runs))
        left = table.crowded(places, runs, threshold)
        spans = spans or spans_of(words)
        best: dict[int, tuple] = {}

        def look(start: int, item: int, distance: int) -> None:
            if best.get(item, (0,))[0] == 1.0:
                return
            own = Counter(_window(spans, start, min(start + table.words, len(words)), table.shingle))
            value = similarity(own, table.items[item].counts)
            if value >= threshold and (value, -start) > best.get(item, (0, 0))[:2]:
                best[item] = value, -start, distance

        for part in np.split(starts, np.arange(AT_ONCE, len(starts), AT_ONCE)):
            # windows of one stretch share their sums; a stretch ends where the starts have a gap
            for stretch in np.split(part, np.flatnonzero(np.diff(part) > shingles) + 1):
                first = int(stretch[0])
                prints = window_fingerprints(runs[first:int(stretch[-1]) + shingles], shingles)[stretch - first]
                for window, item, distance in zip(*(x.tolist() for x in table.candidates(prints))):
                    start = int(stretch[window])
                    left.discard((start, item))
                    look(start, item, distance)
        # those that met in no block
        for start, item in sorted(left):
            own = window_fingerprints(runs[start:start + shingles], shingles)
            look(start, item, int(np.bitwise_count(own ^ table.prints[item]).sum()))
        for item, (value, start, distance) in sorted(best.items()):
            yield table.items[item].item_id, -start, min(table.words, len(words)), distance, value


def _window(spans: Spans, first: int, end: int, size: int) -> list[bytes]:
    """Shingles of the words from `first` to `end`."""
    a = int(spans.starts[first])
    return Spans(spans.joined[a:int(spans.ends[end - 1])], spans.starts[first:end] - a, spans.ends[first:end] - a).shingles(size)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shingle: int, max_item_bytes: int) -> list[Broadcast]:
    """Broadcast indexes over the items, each over `max_item_bytes` of text, about."""
    items = benchmark.select(F.col(item_col), as_bytes(text_col).alias("_text")).where(F.length("_text") > 0)
    size = items.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    parts, found = max(1, math.ceil(size / max_item_bytes)), []
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("_text"), F.lit(parts)) == part).collect()
        index = Index([i for r in chosen if (i := Item.of(r[0], bytes(r[1]), shingle))])
        found.append(benchmark.sparkSession.sparkContext.broadcast(index))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY,
                 max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """`(id, item, word_start, words, distance, similarity)`: the best window of each document for each item that it holds.

    A window has as many words as the item (all words, where the document has
    fewer). Windows are formed wherever a document has a shingle of an item of
    their size; their fingerprints find the items that come close in a block, and
    the similarity of the shingles, with their counts, decides. Windows that have
    enough shingles of an item, but meet it in no block, are compared as well, so
    none is missed. Ties go to the first window. Items shorter than a shingle are matched as a whole.

    The items are an index in every task, and documents are read where they
    lie, whole and without a shuffle. A benchmark of more than `max_item_bytes`
    is taken in parts, each with a pass of its own. Null and empty texts hold nothing and are
    held by nothing; repeated rows and rows with null ids are compared like any
    other; an empty table holds nothing; other columns are not read.
    """
    item_field = StructField(item_col if item_col != id_col else f"item_{item_col}", benchmark.schema[item_col].dataType)
    schema = StructType([*fields(docs, id_col), item_field, StructField("word_start", LongType()), StructField("words", LongType()),
                         StructField("distance", IntegerType()), StructField("similarity", DoubleType())])
    out, texts = arrow_schema(schema), docs.select(id_col, as_bytes(text_col).alias("_text"))
    result = None
    for index in _indexes(benchmark, item_col, item_text_col, shingle, max_item_bytes):

        def rows(source, index=index) -> Iterator[tuple]:
            for batch in source:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for match in matches(text.as_py(), index.value, threshold):
                        yield key, *match

        found = texts.mapInArrow(lambda s, rows=rows: batches(out, rows(s)), schema)
        result = found if result is None else result.unionByName(found)
    return result


def _holds(index: Broadcast, threshold: float):
    @F.arrow_udf(BooleanType())
    def holds(texts: pa.Array) -> pa.Array:
        return pa.array([next(matches(t.as_py(), index.value, threshold), None) is not None for t in texts], pa.bool_())

    return holds


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY,
                     max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of `docs` that hold no passage of an item, with all their columns; see `contaminated`.

    Each row is judged by its own text, whatever its id, and nothing is
    shuffled. Between the parts of a large benchmark the rows left are written.
    """
    for at, index in enumerate(_indexes(benchmark, item_col, item_text_col, shingle, max_item_bytes)):
        docs = (materialize(docs, "clean") if at else docs).where(~_holds(index, threshold)(as_bytes(text_col)))
    return docs
