"""Rules as a table; tags that are none."""

import random

from pyspark.sql import functions as F

from lexmill.llm import url_filters


def test_rules_as_a_table_equal_the_chained_condition(spark):
    random.seed(6)
    host = lambda: ".".join(random.choice(["a", "b", "com", "org"]) for _ in range(random.randint(1, 4)))
    path = lambda: "".join(random.choice(["/", "x", "y", "/x"]) for _ in range(random.randint(0, 5)))
    rules = sorted({(f"{host()}/{path()}", random.choice(["allow", "block"])) for _ in range(60)})
    rules += [(rules[0][0], "allow"), (rules[0][0], "block")]
    rows = [(i, f"http://{host()}/{path()}") for i in range(300)] + [(900, None), (901, "abc"), (902, "http://a.com"), (903, "http://?q")]
    pages = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string")
    table = spark.createDataFrame(rules, "rule string, verdict string")
    names = ["page_id", "host", "path", "rule", "verdict"]
    one = sorted(url_filters.judge(pages, rules).select(*names).collect())
    two = sorted(url_filters.judge(pages, table).select(*names).collect())
    assert one == two and sum(r.rule is not None for r in one) > 100
    none = url_filters.judge(pages, table.limit(0))
    assert none.where(F.col("rule").isNull() & (F.col("verdict") == "allow")).count() == len(rows)


def test_tags_that_are_none(spark):
    block = "http://example.org/es/1"
    rows = [
        (1, "http://a.net/1", f"<!-- <link rel=canonical href={block}> -->", "allow"),
        (2, "http://a.net/2", f"<script>'<link rel=canonical href={block}>'</script>", "allow"),
        (3, "http://a.net/3", f'<link title="a > b" rel="shortlink canonical" href="{block}">', "block"),
        (4, "http://a.net/4", f"<link title=it's rel=canonical href={block}>", "block"),
        (5, "http://a.net/5", f"<!-- never closed <link rel=canonical href={block}>", "allow"),
        (6, "http://a.net/6", '<link rel="canonical" href="">', "allow"),
        (7, "http://a.net/7", "<link rel=canonical><meta http-equiv=refresh content='5'>", "allow"),
        (8, "http://a.net/8", '<link rel="canonical" href="' + "x" * 100_000 + '">' + "<p>" * 50_000, "allow"),
        (None, "http://a.net/9?" + "q" * 100_000, f"<link rel=canonical href={block}>", "block"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages).collect()}
    assert got == {r[0]: r[3] for r in rows}
