"""Targets of canonical links and refreshes are resolved against their page."""

from lexmill.llm import url_filters


def test_targets_are_resolved(spark):
    link, refresh = '<link rel={} href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    cases = [
        ("http://shop.com/old", refresh.format("/de/new"), "shop.com/de/new"),
        ("http://a.net/x", link.format("canonical", "//Example.org/es/1"), "example.org/es/1"),
        ("http://a.net/d/x?q=1", link.format("canonical", "y?a=1&amp;b=2#f"), "a.net/d/y?a=1&b=2"),
        ("http://a.net/d/e/x", link.format("canonical", "../../de/./z"), "a.net/de/z"),
        ("http://a.net/d/x", link.format("canonical", ".."), "a.net/"),
        ("http://a.net", link.format("canonical", "y"), "a.net/y"),
        ("http://a.net/p", link.format("canonical", "?b=1"), "a.net/p?b=1"),
        ("http://a.net/p", link.format("\'nofollow Canonical\'", "https&#58;&#x2F;/b.net/&#233;&#38;lt;"), "b.net/é&lt;"),
        ("http://a.net/p", link.format("canonical", "#top"), None),
        ("http://a.net/p", link.format("canonical", "mailto:x@y.z"), None),
        ("no scheme", link.format("canonical", "/y"), None),
    ]
    pages = spark.createDataFrame([(i, url, html) for i, (url, html, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {(r.a, r.b) for r in url_filters.page_edges(pages).collect()}
    assert got == {(url[7:], want) for url, _, want in cases if want}


def test_relative_refresh_spreads_a_block(spark):
    pages = spark.createDataFrame([(1, "http://shop.com/old", '<meta http-equiv=refresh content="0;url=/de/new">')], "page_id long, url string, html string")
    assert [r.verdict for r in url_filters.judge(pages).collect()] == ["block"]
