"""Packing against the tokenizer itself, by putting all pieces back together."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyfold.llm.packing import Encoder, Windows, pack
from tallyfold.llm.queries import QUERIES, byte_bpe


@pytest.fixture(scope="module")
def encoder():
    return Encoder(byte_bpe())


@pytest.mark.parametrize("text", [
    "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a  b", "a\tb", "a \n b\n", "a\n\nb", "a\n\n\nb", "a\n\n b", "\na", " \na", "a\n",
    "x<|endoftext|> y", "don't we'll it's", "Größe, (über) 12.5%!! ###", "日本 語\n語", "a b c d", "word|word || |", "é́ x", "1st 2nd,",
])
def test_ids_are_those_of_the_tokenizer(encoder, text):
    want = np.array(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.by_piece and encoder.encode(text) == want
    assert encoder.encode(text) == want  # from the table


def check_whole(pieces, ids_of):
    """Every id of every document lies in one piece, and sequences have neither gaps nor overlaps."""
    found, filled = defaultdict(list), defaultdict(list)
    for doc, start, length, ids, total, sequence, offset in pieces:
        assert len(ids) == 4 * length and total == len(ids_of[doc]) // 4
        found[doc].append((start, bytes(ids)))
        filled[sequence].append((offset, length))
    for doc, ids in ids_of.items():
        at = 0
        for start, part in sorted(found[doc]):
            assert start * 4 == at and ids[at:at + len(part)] == part
            at += len(part)
        assert at == len(ids)
    sizes = []
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    return sizes


def test_windows_keep_every_id_and_need_no_padding():
    rng = np.random.default_rng(1)
    docs = {i: rng.integers(1, 9, int(n)).astype("<u4").tobytes() for i, n in enumerate(rng.integers(1, 300, 500))}
    windows = Windows(64, 0)
    pieces = [p for i, ids in docs.items() for p in windows.add(i, ids)] + list(windows.close())
    sizes = check_whole(pieces, docs)
    assert all(s & (s - 1) == 0 for s in sizes) and sum(s < 64 for s in sizes) <= 6


def test_level_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(2)
    windows = Windows(32, 0)
    for i in range(400):
        size = int(rng.integers(1, 32))
        counts, best = windows.counts.copy(), {}
        for level in [0, *np.flatnonzero(counts)]:
            if level + size <= 32:
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 32
                best[int(level)] = int((after[1:32] ** 2).sum())
        assert best[windows._level(size)] == min(best.values())
        list(windows.add(i, b"\1\0\0\0" * size))


def test_rows_of_all_kinds(spark, encoder):
    texts = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (1, "a b c"), (4, "word " * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS ids")
    rows = pack(df, byte_bpe(), length=64).collect()
    total = sum(len(encoder.encode(t or "")) // 4 + 1 for _, t in texts)
    assert sum(r.length for r in rows) == total
    assert {r.doc_tokens for r in rows if r.doc_id in (2, 3)} == {1} and len([r for r in rows if r.doc_id is None]) == 1
    assert pack(df.limit(0), byte_bpe()).count() == 0


def test_query(spark, sf, encoder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {k: encoder.whole.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    done = defaultdict(int)
    for r in QUERIES["op4_sum_of_squares_packing"](spark, sf).collect():
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
        done[r.doc_id] += r.length
    assert done == {k: len(v) for k, v in ids.items()}
