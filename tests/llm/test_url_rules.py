"""URL rules against running every rule on every URL."""

import re

import pytest

from tallyfold.llm.queries import QUERIES, URL_RULES
from tallyfold.llm.url_rules import Rule, index_of, judge

URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/EN/1", "http://net/", "http://net", "x://org/fr/", "http://b.org/fr/x?y#z",
        "http://example.com/de/#a", "http://example.com/de?x=/de/", "http://badexample.com/de/", "no scheme", "", None, "://", "http://",
        "http://a.net?x=/en/", "http://u@h.net:80/p", "http://x/ads/banner1.gif", "http://x/adserver/", "http://cdn.y.org/t*/q.js",
        "http://casino-win.example.com/", "http://a.b.c.d.net/x", "http://x/en/ads/1", "http://é.net/é", "a://b://net/"]
MORE = [*URL_RULES, Rule("/ads/", "block"), Rule("/ads/banner", "allow"), Rule("cdn.*.org/*.js", "block"), Rule("casino-*/", "block"),
        Rule("*/en/*/1", "allow"), Rule("x/ad", "block")]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if host and re.match(r.regex, host + path, re.DOTALL)]
    best = min(fits, key=lambda r: r.rank, default=None)
    return host, path, best and best.pattern, best.verdict if best else default


@pytest.mark.parametrize("rules", [URL_RULES, MORE])
@pytest.mark.parametrize("most", [1 << 20, 0])
def test_both_ways(spark, rules, most):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").selectExpr("*", "'x' AS rule", "'y' AS host")
    rows = judge(df, rules, keep=("page_id",), max_index_bytes=most).collect()
    assert {r.page_id: tuple(r)[1:] for r in rows} == {i: plain(u, rules) for i, u in enumerate(URLS * 2)}
    assert judge(df.limit(0), rules, max_index_bytes=most).count() == 0


def test_rules_by_hand():
    want = {"http://a.example.net/en/1": "allow", "http://net/": "block", "http://b.org/fr/x?y#z": "allow",
            "http://badexample.com/de/": "allow", "https://EXAMPLE.net/EN/1": "block"}
    assert {u: plain(u, URL_RULES)[3] for u in want} == want


def test_rarest_token_and_rules_without_one():
    index, always = index_of(MORE, {"net": 9, "example": 5, "en": 7, "org": 1, "fr": 1, "com": 3, "de": 4})
    assert [r.pattern for r in index["com"]] == ["example.com/de/"] and [r.pattern for r in index["fr"]] == ["org/fr/"]
    assert [r.pattern for r in index["example"]] == ["example.net/en/"]
    assert {r.pattern for r in always} == set() and "x" in index and "ads" in index
    assert [r.tokens for r in (Rule("casino-*/", "b"), Rule("/ad", "b"), Rule("*x/ad*", "b"))] == [["casino"], [], []]


def test_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op3_url_verdicts"](spark, sf).collect()
    assert {r.page_id: tuple(r)[1:] for r in rows} == {k: plain(u, URL_RULES) for k, u in urls.items()}
