"""The lookup table against claiming slots by whole preference lists."""

import hashlib
from collections import Counter

import pytest

from tallyfold.llm.placement import lookup_table, place, write_shards
from tallyfold.llm.queries import QUERIES, SHARDS


def plain_table(shards, slots):
    lists = {}
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:16], "little") % (slots - 1) + 1
        lists[name] = [(offset + i * skip) % slots for i in range(slots)]
    owner = {}
    while len(owner) < slots:
        for name in sorted(shards):
            if len(owner) < slots:
                owner[next(s for s in lists[name] if s not in owner)] = name
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 7), (3, 7), (7, 7), (5, 101), (13, 251)])
def test_table(n, slots):
    shards = [f"s{i}" for i in range(n)]
    table = [shards[i] for i in lookup_table(shards, slots)]
    assert table == plain_table(shards, slots)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    turned = shards[::-1]
    assert [turned[i] for i in lookup_table(turned, slots)] == table


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{i}" for i in range(20)]
    before = [shards[i] for i in lookup_table(shards, 10_007)]
    after = [shards[1:][i] for i in lookup_table(shards[1:], 10_007)]
    assert sum(a != b for a, b in zip(before, after) if a != "s0") < 0.05 * 10_007


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        lookup_table(shards, slots)


def test_rows_of_all_kinds(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), ("", "c"), ("k", "d"), ("k", "d"), ("x" * 100_000, None)] + [("hot", "h")] * 40
    df = spark.createDataFrame(rows, "key string, text string").selectExpr("*", "'s' AS shard", "1 AS slot", "0 AS _salt")
    placed = place(df.drop("_salt"), "key", ["a", "b", "c"], 101)
    found = placed.collect()
    assert len(found) == len(rows) and placed.columns == ["key", "text", "slot", "shard"]
    by_key = {}
    for r in found:
        by_key.setdefault(r.key, set()).add((r.slot, r.shard))
    assert all(len(v) == 1 for v in by_key.values())
    write_shards(placed, str(tmp_path / "out"), 4)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, again.select(placed.columns).collect())) == sorted(map(str, found))
    assert place(df.limit(0), "key", ["a"], 7).count() == 0


def test_query(spark, sf):
    rows = QUERIES["op5_shard_placement"](spark, sf).collect()
    table = lookup_table(SHARDS)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(SHARDS[table[r.slot]] == r.shard for r in rows)
