"""Personal data: patterns against plain regular expressions, messages against all labellings, and planted repeats."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tallyfold.llm import pii
from tallyfold.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    odd, even = digits[::-1][0::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    found = []
    for at, (kind, pattern) in enumerate(PLAIN.items(), 1):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (
                    kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                found.append((m.start(), at, m.end()))
    return sorted(found)


def test_patterns(spark, sf):
    draw = random.Random(4)
    pieces = ["a", "B", "é", "7", "42", "255", "0300", ".", ".", "@", "@", "-", "+", " ", "(", ")", "%", "_", "\n", "a.b@c-d.e", "1.2.3.4", "4111111111111111",
              "4111 1111 1111-1111", "+1 (234) 555-0100", "٣", "m@x.y_"]
    for _ in range(6000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert pii.base_spans(r.text) == plain(r.text)


def test_long_runs_take_linear_time():
    start = time.time()
    for piece in ("a", "1", "1.", "1 ", "@", "a@", "+1", "+1(", "a.b@c.d_", "é"):
        text = piece * (300_000 // len(piece))
        pii.added_spans(pii.tokens_of(text, pii.base_spans(text)), pii.fit([]))
    assert time.time() - start < 60


def exact(field_, t):
    total = np.zeros((len(t.spans), pii.LABELS))
    for labels in itertools.product(*[[x] if x >= 0 else sorted(a) for x, a in zip(t.labels, t.allowed)]):
        value = sum(field_.unary[s, y] for s, y in zip(t.shapes, labels))
        value += sum(field_.chain[labels[a], labels[b]] for a, b in t.chain) + sum(field_.skip[labels[a], labels[b]] for a, b in t.skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(value)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_give_marginals():
    rng = np.random.default_rng(2)
    half = rng.normal(size=(pii.LABELS, pii.LABELS))
    field_ = pii.Field(rng.normal(size=(len(pii.SHAPES), pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), (half + half.T) / 2)
    tree = pii.Tokens([(i, i + 1) for i in range(5)], [""] * 5, [0, 4, 7, 2, 9], [-1, 2, -1, -1, -1], [{0, 1}, {0}, {0, 2, 3}, {0, 1, 2, 3, 4}, {0, 4}],
                      [(0, 1), (1, 2)], [(2, 3), (0, 4)])
    assert np.allclose(field_.marginals(tree), exact(field_, tree), atol=1e-4)
    loop = pii.Tokens(tree.spans, tree.cores, tree.shapes, tree.labels, tree.allowed, [(0, 1), (1, 2), (2, 3)], [(0, 2), (2, 4), (0, 4)])
    weak = pii.Field(field_.unary, field_.chain * 0.3, field_.skip * 0.3)
    assert np.abs(weak.marginals(loop) - exact(weak, loop)).max() < 0.05


def test_edges_grow_with_tokens():
    t = pii.tokens_of("a1234567@b.cc " * 2000, [])
    assert len(t.skip) <= 3 * 2000 and len(t.chain) == 1999


TEXTS = ["Call +1 (234) 555-0100 now. Later: (234) 555-0100 or 234-555-0100, or page 12.",
         "Card 4111111111111111 and again 4111.1111.1111.1111 here.", "4111111111111111 4111111111111111 twice",
         "mail jane.doe@mail1.example.com or jane.doe@mail1 today", "from 10.20.30.40 and 10.20.30.400 and v1.2.3", "order 1234567890123456 of 2024",
         "page (234) 55 of v2.0.", "nothing here", "", None]


def test_similar_tokens_get_one_label(spark):
    teach = [f"word +1 ({i % 800 + 200}) 555-{i:04d} word x{i}@mail.example.com, 4{i:05d} and 10.0.{i % 200}.7 v2.{i}" + (
        f" again +1 ({i % 800 + 200}) 555-{i:04d} or x{i}@mail.example.com" if i % 2 else "") for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(teach + TEXTS)], "doc_id long, text string")
    field_ = pii.train(docs)
    found = {r.doc_id - 300: r for r in pii.find(docs, field_).collect() if r.doc_id >= 300}

    def said(i):
        return [(s.split(":")[0], TEXTS[i][int(s.split(":")[1]):int(s.split(":")[2])]) for s in found[i].spans.split(",") if s]

    assert said(0) == [("phone", "+1 (234) 555-0100"), ("phone", "(234) 555-0100"), ("phone", "234-555-0100")]
    assert said(1) == [("card", "4111111111111111"), ("card", "4111.1111.1111.1111")]
    assert said(2) == [("card", "4111111111111111")] * 2
    assert said(3) == [("email", "jane.doe@mail1.example.com"), ("email", "jane.doe@mail1")]
    assert said(4)[0] == ("ip", "10.20.30.40")
    assert [found[i].spans for i in (5, 6, 7, 8, 9)] == [""] * 5
    for i, r in found.items():
        base = plain(TEXTS[i] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert sum(r[f"n_{k}"] for k in pii.KINDS) == len(said(i) if TEXTS[i] else []) == len(base) + r.n_added


def test_rows_of_all_kinds(spark):
    rows = [(1, "x@y.z " * 50_000), (1, "x@y.z"), (1, "x@y.z"), (None, "1.2.3.4"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "_text": F.lit("9.9.9.9"), "label": F.lit(2)})
    got = sorted((str(r.doc_id), r.n_email, r.n_ip) for r in pii.find(df, pii.train(df)).collect())
    assert got == [("1", 1, 0), ("1", 1, 0), ("1", 50_000, 0), ("2", 0, 0), ("3", 0, 0), ("None", 0, 1)]
    assert pii.find(df.limit(0), pii.train(df.limit(0))).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_personal_data"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = [f"{pii.KINDS[k - 1]}:{a}:{b}" for a, k, b in plain(docs[r.doc_id])]
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(spans)
        assert [sum(s.startswith(k) for s in spans) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))


def test_counts_of_the_query_are_those_of_the_patterns(spark, tmp_path):
    teach = [f"word +1 ({i % 800 + 200}) 555-{i:04d} word x{i}@mail.example.com, 4{i:05d} and 10.0.{i % 200}.7 v2.{i}" + (
        f" again +1 ({i % 800 + 200}) 555-{i:04d} or x{i}@mail.example.com" if i % 2 else "") for i in range(300)]
    docs = dict(enumerate(teach + TEXTS))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_personal_data"](spark, str(tmp_path)).collect()
    assert sum(r.n_added for r in rows) > 0 and sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = [k for _, k, _ in plain(docs[r.doc_id] or "")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k) for k in range(1, pii.LABELS)]
        assert len(r.spans.split(",") if r.spans else []) == len(base) + r.n_added
