"""Sum-of-squares packing of tokenised documents into fixed windows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import arrow_schema, as_bytes, batches, fields

#: Distinct pieces of text whose ids a worker remembers (about 200 bytes each).
REMEMBERED = 400_000
#: Signs that end a word; the pattern of byte-level files makes a run of them one token group. No apostrophe, which opens others.
MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\""
#: Largest tokenizer file that is shipped to the tasks.
MAX_TOKENIZER_BYTES = 64 << 20


class Encoder:
    """Ids of whole texts by a tokenizer file, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    Byte-level files cut a text before every single space or line break that
    stands between other characters, whatever surrounds it. So the ids of such
    pieces are looked up in a bounded table and only new words are encoded.
    Texts with other runs of white space are encoded whole.
    """

    def __init__(self, tokenizer_json: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        said = json.loads(tokenizer_json)
        before = said.get("pre_tokenizer") or {}
        self.by_piece = (
            said.get("normalizer") is None and said["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space", True) and before.get("use_regex", True)
            and (said.get("post_processor") or {}).get("type") in (None, "ByteLevel"))
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.model, self.alphabet = self.whole.model, _byte_alphabet()
        self.line_break = self._whole("\n")
        self.others: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian integers."""
        if not self.by_piece or any(t in text for t in self.added):
            return self._whole(text)
        spaced = text.replace("\n", " \n")
        if "\n \n " in spaced or spaced.endswith("\n \n"):
            return self._whole(text)
        first, *rest = spaced.split(" ")
        found = list(map(self.known.get, rest))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None and (ids := self._learn(rest[i])) is None:
                    return self._whole(text)
                found[i] = ids
        if first:
            if _has_space(first):
                return self._whole(text)
            found.insert(0, self._other(first))
        return b"".join(found)

    def _learn(self, piece: str) -> bytes | None:
        """Ids of a piece after a space, or of one that opens with a line break; None if it has other white space."""
        if piece.isalpha():
            if (ids := self._word(" " + piece)) and len(self.known) < REMEMBERED:
                self.known[piece] = ids
            return ids
        word = piece.rstrip(MARKS)
        if word.isalpha():
            ids = (self.known.get(word) or self._learn(word)) + self._other(piece[len(word):])
            if len(self.known) < REMEMBERED:
                self.known[piece] = ids
            return ids
        if piece.startswith("\n"):
            word = piece[1:]
            if word and (word.isspace() or _has_space(word)):
                return None
            return self.line_break + (self._other(word) if word else b"")
        return None if not piece or _has_space(piece) else self._other(" " + piece)

    def _other(self, text: str) -> bytes:
        """Ids of a text without inner white space, looked up in a table of its own."""
        ids = self.others.get(text)
        if ids is None:
            ids = self._word(text) if text.isalpha() else self._whole(text)
            if len(self.others) < REMEMBERED // 8:
                self.others[text] = ids
        return ids

    def _word(self, text: str) -> bytes:
        """Ids of letters with at most one space before them, which the pattern never cuts."""
        return _packed([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))])

    def _whole(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_alphabet() -> dict[int, str]:
    """The character that byte-level files use for each byte: printable bytes stand for themselves, the others follow
    from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _has_space(text: str) -> bool:
    return text.split() != [text] if text else False


class Windows:
    """Windows of `length` tokens that fill as documents come in.

    `counts[h]` is the number of open windows that hold `h` tokens. A rest of
    `r` tokens goes to the level that leaves the smallest sum of squared counts;
    equal choices go to the fuller level. A full window is given out at once.
    """

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id = length, first_id
        self.counts = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while total - start >= self.length:
            yield from self._given([(doc, start, ids[4 * start:4 * (start + self.length)], total)])
            start += self.length
        if start < total:
            yield from self._place((doc, start, ids[4 * start:], total))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        size, counts = len(piece[2]) // 4, self.counts
        level = self._level(size)
        if level:
            window = self.open[level].pop()
            counts[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.length:
            yield from self._given(window)
        else:
            self.open.setdefault(level + size, []).append(window)
            counts[level + size] += 1

    def _level(self, size: int) -> int:
        """The level to add `size` tokens to; 0 opens a window. Changes of the sum of squares, halved and less 1/2:
        `counts[size]` for a new window, `after - before + 1/2` for an open one, `-before` for one that it fills."""
        counts, top = self.counts, self.length - size
        before = counts[1:top + 1]
        change = (counts[size + 1:] - before).astype(np.float64) + 0.5
        change[-1] = -before[-1]
        change[before == 0] = np.inf
        best = top - int(change[::-1].argmin()) if top else 0
        return best if best and change[best - 1] <= counts[size] else 0

    def close(self) -> Iterator[tuple]:
        """The open windows: the emptiest ones are cut to fill the others, and the tokens of the last one
        go to windows of falling powers of two, so that none needs padding."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.counts[:] = {}, 0
        i, j = 0, len(left) - 1
        while i < j:
            room = self.length - sum(len(p[2]) for p in left[i]) // 4
            while room and i < j:
                doc, start, ids, total = left[j].pop()
                size = len(ids) // 4
                if size > room:
                    keep = size - room
                    left[j].append((doc, start, ids[:4 * keep], total))
                    doc, start, ids, size = doc, start + keep, ids[4 * keep:], room
                left[i].append((doc, start, ids, total))
                room -= size
                j -= not left[j]
            if not room:
                yield from self._given(left[i])
                i += 1
        if i == j and left[i]:
            pieces = left[i][::-1]
            size = sum(len(p[2]) for p in pieces) // 4
            while size:
                room = 1 << (size.bit_length() - 1)
                size, window = size - room, []
                while room:
                    doc, start, ids, total = pieces.pop()
                    if len(ids) // 4 > room:
                        pieces.append((doc, start + room, ids[4 * room:], total))
                        ids = ids[:4 * room]
                    window.append((doc, start, ids, total))
                    room -= len(ids) // 4
                yield from self._given(window)

    def _given(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in window:
            yield doc, start, len(ids) // 4, ids, total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1


_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """One encoder per worker and file, kept from task to task."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def pack(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024,
         end_id: int = 0) -> DataFrame:
    """Pieces of documents with their place: `(id, start, length, ids, doc_tokens, sequence_id, offset)`.

    A document is the ids of its text, then `end_id`. Whole windows are cut off
    first; the rest of each document stays in one piece and goes to a window by
    the sum-of-squares rule. Each task packs the rows that it reads, without a
    shuffle, and holds the open windows only. At its end it cuts the emptiest
    windows to fill the others, so at most one is not full; that one is split
    into windows whose sizes are powers of two. `ids` are unsigned 32-bit
    little-endian integers; `sequence_id` is the task's number times 2^33 plus
    a counter, the same when a task runs again.

    Null text counts as empty, which gives the single id `end_id`. Rows with
    equal or null ids are packed one by one. Other columns are not read. An
    empty table gives no pieces.
    """
    size = len(tokenizer_json.encode())
    if size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"the tokenizer file has {size} bytes; at most {MAX_TOKENIZER_BYTES} are shipped to tasks")
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    file = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = StructType([
        *fields(df, id_col), StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids", BinaryType()), StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()),
        StructField("offset", LongType())])
    out, end = arrow_schema(schema), np.array([end_id], "<u4").tobytes()

    def pieces(source):
        encoder = _encoder(file.value)
        windows = Windows(length, TaskContext.get().partitionId() << 33)
        for batch in source:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = encoder.encode(text.decode("utf-8", "replace")) if text else b""
                yield from windows.add(doc, ids + end)
        yield from windows.close()

    def run(source):
        yield from batches(out, pieces(source), lambda row: 100 + len(row[3]))

    return df.select(id_col, as_bytes(text_col).alias(text_col)).mapInArrow(run, schema)
