"""Fingerprints and groups against brute force."""

import random

import pytest
import xxhash

from tallyfold.llm.queries import QUERIES
from tallyfold.llm.simhash import fingerprint, links, near_copies


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Smallest member that each can reach, over all pairs."""
    least = {p: p for p in prints}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                least[high] = low
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One TWO", "a b c", "a b c d", "a a a a a a", "Ä ä É é x", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint(text.encode() if text else None) == plain_fingerprint(text)


@pytest.mark.parametrize("pairwise", [64, 4, 0])
def test_links_connect_what_is_near(spark, pairwise):
    rng, prints = random.Random(3), {0, 2 ** 64 - 1}
    for _ in range(3):  # dense groups that share halves
        centre = rng.getrandbits(64)
        for _ in range(90):
            prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)})
    signed = [(p - (p >> 63 << 64),) for p in prints]
    found = [(a % 2 ** 64, b % 2 ** 64) for a, b in links(spark.createDataFrame(signed, "fingerprint long"), pairwise).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in found)
    want, least = plain_groups(prints), {p: p for p in prints}
    for _ in range(len(prints)):
        before = dict(least)
        for a, b in found:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert least == want


def test_rows_of_all_kinds(spark):
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, None), (4, ""), (None, "a b c d e"), (2, "A b c d e"), (9, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0L AS fingerprint", "'k' AS key")
    got = sorted((r.doc_id or 0, r.component_id) for r in near_copies(df).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (9, 9)]
    assert near_copies(df.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    root, first = plain_groups(sorted(set(prints.values()))), {}
    for k in sorted(prints, reverse=True):
        first[root[prints[k]]] = k
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_components"](spark, sf).collect()}
    assert got == {k: (f"{p:016x}", first[root[p]]) for k, p in prints.items()}
