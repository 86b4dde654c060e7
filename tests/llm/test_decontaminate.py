"""Benchmark passages against comparing every window with every item."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import decontaminate
from tallyfold.llm.decontaminate import BLOCKS, RADIUS, Index, Item, SizeTable, contaminated, matches, similarity, without_passages
from tallyfold.llm.queries import QUERIES


def shingles(words, size):
    return Counter(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def plain(text, items, threshold=0.8):
    """Best similarity for each item over all windows of its size."""
    words, found = (text or "").lower().split(), {}
    for key, item in items.items():
        own = item.lower().split()
        if not own or not words:
            continue
        size = min(5, len(own))
        for start in range(max(1, len(words) - len(own) + 1)):
            window = words[start:start + len(own)]
            value = similarity(shingles(window, size), shingles(own, size)) if len(window) >= size else 0
            if value >= threshold and value > found.get(key, (0,))[0]:
                found[key] = value, start
    return found


def test_against_all_windows():
    rng = random.Random(4)
    pool = [f"v{i}" for i in range(300)]
    items = {i: " ".join(rng.choices(pool, k=n)) for i, n in enumerate([3, 5, 8, 20, 20, 40, 60, 60, 90])}
    items[9] = "a b a b a b a b a b a b"
    texts = []
    for i, item in items.items():
        for edits in range(4):
            words = item.split()
            for _ in range(edits):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                words[at:at + (kind != 0)] = [] if kind == 1 and len(words) > 1 else [rng.choice(pool)]
            texts.append(" ".join(rng.choices(pool, k=30) + words + rng.choices(pool, k=rng.randrange(30))))
        texts += [item.upper(), item, " ".join(item.split()[1:]), item + " " + item]
    texts += ["", " ".join(rng.choices(pool, k=3000))]
    index = Index([Item.of(i, t.encode(), 5) for i, t in items.items()])
    hits = 0
    for text in texts:
        got = {i: (value, start) for i, start, _, _, value in matches(text.encode(), index, 0.8)}
        assert got == plain(text, items)
        hits += len(got)
    assert hits > 40


def test_blocks_find_everything_within_the_radius():
    rng = np.random.default_rng(3)
    items = [Item.of(i, " ".join(f"{rng.integers(1e9)}" for _ in range(12)).encode(), 5) for i in range(200)]
    table = SizeTable(items)
    near = table.prints[rng.integers(0, 200, 300)].copy()
    for row in near:
        for bit in rng.choice(16 * BLOCKS, rng.integers(0, RADIUS + 3), replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    window, item, distance = table.candidates(near)
    every = np.bitwise_count(near[:, None] ^ table.prints[None]).sum(axis=2)
    got = set(zip(window.tolist(), item.tolist()))
    assert got >= set(zip(*(x.tolist() for x in np.nonzero(every <= RADIUS)))) and len(got) == len(window)
    assert (every[window, item] == distance).all()


def test_few_unrelated_pairs_meet():
    rng = np.random.default_rng(5)
    items = [Item.of(i, " ".join(f"{rng.integers(1e9)}" for _ in range(30)).encode(), 5) for i in range(300)]
    table = SizeTable(items)
    others = rng.integers(0, 1 << 16, (2000, BLOCKS)).astype(np.uint16)
    assert len(table.candidates(others)[0]) < 0.05 * len(others) * len(items)


def test_recall_at_the_threshold():
    """Pairs of texts whose similarity lies just above 0.8, the hardest that count."""
    rng = random.Random(8)
    met = total = 0
    for trial in range(1500):
        words = [f"{rng.random()}" for _ in range(104)]
        other = list(words)
        for at in rng.sample(range(2), 2):
            other[10 + 50 * at] = "x"
        a, b = (Item.of(0, " ".join(w).encode(), 5) for w in (words, other))
        if 0.8 <= similarity(a.counts, b.counts) < 0.84:
            total += 1
            met += len(SizeTable([a]).candidates(SizeTable([b]).prints)[0])
    assert total > 1000 and met >= 0.99 * total


def test_rows_of_all_kinds(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = [(1, "x " + item), (2, None), (3, ""), (None, item), (1, "x " + item), (4, "filler " * 30_000 + item), (5, "nothing here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words", "3 AS similarity")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "one two three four five six"), (7, item)], "item_id long, text string")
    rows = contaminated(df, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.word_start) for r in rows) == {(1, 7, 1): 4, (None, 7, 0): 2, (4, 7, 30_000): 2}
    assert {r.similarity for r in rows} == {1.0}
    parts = contaminated(df, bench, max_item_bytes=60).collect()
    assert sorted(map(str, parts)) == sorted(map(str, rows))
    for most in (1 << 20, 60):
        left = without_passages(df, bench, max_item_bytes=most)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert without_passages(df.limit(0), bench).count() == 0 and without_passages(df, bench.limit(0)).count() == len(docs)
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_rows_are_judged_one_by_one(spark):
    item = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(8, "clean words"), (8, "x " + item), (None, item + " y"), (None, "clean too")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(map(str, without_passages(df, bench).collect())) == ["Row(doc_id=8, text='clean words')", "Row(doc_id=None, text='clean too')"]


def test_query(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["op9_benchmark_passages"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = pytest.approx(r.similarity)
    vocabulary = {w for t in items.values() for w in t.lower().split()}
    near = {k: t for k, t in docs.items() if any(" ".join(t.lower().split()).find(" ".join(i.lower().split()[3:6])) >= 0 for i in items.values())}
    want = {k: {i: v for i, (v, _) in f.items()} for k in {*near, *got} if (f := plain(docs[k], items))}
    assert vocabulary and got == want and got


def test_windows_that_meet_in_no_block_are_found():
    """Texts whose similarity reaches the threshold, though their fingerprints are too far apart in every block."""
    rng, missed = random.Random(8), 0
    for trial in range(6000):
        words = [f"{rng.random()}" for _ in range(60)]
        other = list(words)
        other[20:22] = ["x", "y"]
        a, b = (Item.of(0, " ".join(w).encode(), 5) for w in (words, other))
        assert similarity(a.counts, b.counts) >= 0.8
        if not len(SizeTable([a]).candidates(SizeTable([b]).prints)[0]):
            missed += 1
            text = " ".join(["before", "it", *other, "after"]).encode()
            found = [(i, start) for i, start, *_ in matches(text, Index([a]), 0.8)]
            assert found == [(0, 2)]
    assert missed > 2


def test_windows_with_enough_shingles_are_those_of_a_plain_count(monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD", 20)
    rng = random.Random(2)
    for trial in range(100):
        items = [Item.of(i, " ".join(rng.choices("abc", k=8)).encode(), 5) for i in range(6)]
        table = SizeTable(items)
        runs = Item.of(0, " ".join(rng.choices("abc", k=rng.choice([6, 8, 40]))).encode(), 5).hashes
        places = np.flatnonzero(np.isin(runs, table.known))
        shingles = min(table.shingles, len(runs))
        need = np.ceil(0.8 * (shingles + table.shingles) / 1.8 - 1e-9)
        want = {(s, i) for i, item in enumerate(items) for s in range(len(runs) - shingles + 1)
                if np.isin(runs[s:s + shingles], item.hashes).sum() >= need}
        assert table.crowded(places, runs, 0.8) == want
