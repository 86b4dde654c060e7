"""The classifier: held-out accuracy, updates against a plain loop, and scores of odd rows."""

import math
import zlib
from collections import defaultdict

import numpy as np

from tallyfold.llm import quality
from tallyfold.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op2_quality_scores"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
               for k, r in rows.items())
    unseen = [(rows[k].predicted, y) for k, y in labels.items() if k in rows and rows[k].held_out]
    assert np.mean([p == y for p, y in unseen]) > 0.95
    assert np.mean([p for p, y in unseen if y == 1]) > 0.98


def test_held_out_labels_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    a = quality.train(docs, kept)
    b = quality.train(docs, kept.selectExpr("doc_id", "quality", "1 - quality AS toxic").orderBy("quality"))
    assert a.any() and (a == b).all()


def test_the_sample_is_bounded_and_fixed(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (sorted(r.turn for r in quality.training_rows(d, labels, "doc_id", "text", "quality", max_rows=20).collect())
            for d in (docs, docs.repartition(7)))
    assert len(a) == 20 and a == b


def test_rows_of_all_kinds(spark):
    rows = [(1, "good words here"), (2, "BAD!! BAD!! BAD!!"), (3, None), (4, ""), (None, "good words"), (1, "good words here"), (5, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.3D AS score", "1 AS label", "2 AS part")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 7), (99, 1), (2, 0)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    found = quality.score(docs, weights).collect()
    by_id = {r.doc_id: r.score for r in found}
    assert len(found) == len(rows) and by_id[1] > 0.5 > by_id[2] and by_id[3] == by_id[4]
    assert quality.score(docs.limit(0), weights).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert not none.any() and {r.score for r in quality.score(docs, none).collect()} == {0.5}


def plain_weight(rule, z, n):
    if abs(z) <= rule.l1:
        return 0.0
    return -(z - math.copysign(rule.l1, z)) / ((rule.beta + math.sqrt(n)) / rule.alpha + rule.l2)


def plain_training(rows, rule, rounds):
    """Textbook updates, one weight at a time, on dicts; parts start from the mean state of the round before."""
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(rounds):
        moved_z, moved_n = defaultdict(float), defaultdict(float)
        for part in range(quality.PARTS):
            own_z, own_n = defaultdict(float, z), defaultdict(float, n)
            mine = sorted((r for r in rows if r.part == part), key=lambda r: (r.turn, r.label))
            for _ in range(quality.PASSES):
                for r in mine:
                    w = {i: plain_weight(rule, own_z[i], own_n[i]) for i in r.places}
                    p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(r.places, r["values"]))))
                    for i, v in zip(r.places, r["values"]):
                        g = (p - r.label) * v
                        sigma = (math.sqrt(own_n[i] + g * g) - math.sqrt(own_n[i])) / rule.alpha
                        own_z[i] += g - sigma * w[i]
                        own_n[i] += g * g
            for i in own_z:
                moved_z[i] += own_z[i] - z[i]
                moved_n[i] += own_n[i] - n[i]
        for i in moved_z:
            z[i] += moved_z[i] / quality.PARTS
            n[i] += moved_n[i] / quality.PARTS
    return {i: plain_weight(rule, z[i], n[i]) for i in z}


def test_updates_against_a_plain_loop(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rule = quality.Rule(alpha=0.7, beta=1.5, l1=0.02, l2=0.3)
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality", max_rows=60).collect()
    assert len({r.part for r in rows}) == quality.PARTS and {r.label for r in rows} == {0, 1}
    got = quality.train(docs, labels, max_rows=60, rounds=3, rule=rule)
    want = np.zeros(len(got))
    for i, w in plain_training(rows, rule, 3).items():
        want[i] = w
    assert np.count_nonzero(want) > 100 and np.count_nonzero(want == 0) > 0
    assert np.allclose(got, want, atol=1e-5)


def test_all_labelled_rows_are_learnt_from(spark):
    n = quality.MAX_ROWS + 500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality")
    assert rows.count() == n and rows.select("part").distinct().count() == 2 * quality.PARTS


def test_more_parts_against_a_plain_loop(spark, sf, monkeypatch):
    """More rows are more parts; a place moves by the mean over the parts that have it, or over PARTS if they are fewer."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(quality, "MAX_ROWS", 30)
    rule = quality.Rule()
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality").collect()
    assert len({r.part for r in rows}) > 2 * quality.PARTS
    z, n, seen = defaultdict(float), defaultdict(float), defaultdict(int)
    for part in {r.part for r in rows}:
        own_z, own_n = defaultdict(float), defaultdict(float)
        for r in sorted((r for r in rows if r.part == part), key=lambda r: (r.turn, r.label)) * quality.PASSES:
            w = {i: plain_weight(rule, own_z[i], own_n[i]) for i in r.places}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(r.places, r["values"]))))
            for i, v in zip(r.places, r["values"]):
                g = (p - r.label) * v
                own_z[i] += g - (math.sqrt(own_n[i] + g * g) - math.sqrt(own_n[i])) / rule.alpha * w[i]
                own_n[i] += g * g
        for i in own_z:
            z[i], n[i], seen[i] = z[i] + own_z[i], n[i] + own_n[i], seen[i] + 1
    got, want = quality.train(docs, labels, rounds=1), np.zeros(1 << quality.BITS)
    for i in z:
        of = max(seen[i], quality.PARTS)
        want[i] = plain_weight(rule, z[i] / of, n[i] / of)
    assert np.count_nonzero(want) > 100 and np.allclose(got, want, atol=1e-5)
