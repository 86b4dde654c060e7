"""Archives: exact round trip, and revisits against a plain dictionary."""

import base64
import gzip
import hashlib

import pytest

from tallyfold.llm.queries import QUERIES
from tallyfold.llm.warc import join_originals, read_archive, records_in, write_archive

ODD = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
ROWS = [(1, "http://a/", "x"), (5, "http://b/\r\nX: y", "x"), (3, None, "x"), (2, "u", None), (4, "u", ""), (None, "n", "only"),
        (None, "n", "x"), (7, "r", "r"), (7, "r", "r"), (8, "w", ODD), (9, "é/ü", "é ü"), (10, "big", "y" * 300_000)]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'q' AS payload", "'z' AS record_id")


def test_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    write_archive(pages, path, date="2026-01-01T00:00:00Z")
    records = join_originals(read_archive(spark, path)).collect()
    assert len(records) == len(ROWS)
    by_digest = {}
    for r in records:
        by_digest.setdefault(r.payload_digest, []).append(r)
    for page_id, _, html in ROWS:
        group = by_digest[digest(html)]
        responses = [r for r in group if r.record_type == "response"]
        assert len(responses) == 1 and bytes(responses[0].payload).decode() == (html or "")
        largest = max((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        assert responses[0].page_id == (None if largest is None else str(largest))
        for r in group:
            assert r.payload_bytes == len((html or "").encode())
            assert (r.refers_to, r.payload) == (None, None) if r.record_type == "response" and r.payload is None else True
            if r.record_type == "revisit":
                assert r.refers_to == responses[0].page_id and r.refers_to_record == responses[0].record_id
    assert len({r.record_id for r in records}) == len(ROWS)


def test_small_payloads_stay_responses(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    write_archive(pages, path, min_bytes=2)
    records = read_archive(spark, path, with_payload=False).collect()
    assert all(r.record_type == "response" for r in records) and len(records) == len(ROWS)


def test_cut_archives_are_refused(spark, pages, tmp_path):
    path = tmp_path / "archive"
    write_archive(pages.where("page_id = 10"), str(path))
    whole = gzip.decompress(next(path.glob("*.gz")).read_bytes())
    assert len(list(records_in(gzip.compress(whole)))) == 1
    with pytest.raises(ValueError):
        list(records_in(gzip.compress(whole[:-9])))


def test_files_follow_the_bytes(spark, pages, tmp_path):
    path = tmp_path / "archive"
    write_archive(pages.coalesce(1), str(path), file_bytes=2_000)
    assert len(list(path.glob("*.gz"))) == len(ROWS)  # every file takes one record, whatever its size
    assert read_archive(spark, str(path)).count() == len(ROWS)


def test_empty(spark, pages, tmp_path):
    write_archive(pages.limit(0), str(tmp_path / "archive"))
    assert read_archive(spark, str(tmp_path / "archive")).count() == 0


def test_query(spark, sf):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    largest = {}
    for k in sorted(pages):
        largest[pages[k]] = k
    want = {k: (len(h.encode()), digest(h), "response" if largest[h] == k else "revisit", None if largest[h] == k else largest[h])
            for k, h in pages.items()}
    rows = QUERIES["op1_warc_revisits"](spark, sf).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == len(want)
