"""Text functions against plain Python and the SQL equivalents."""

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as T
from lexmill.functions import unicode as U
from lexmill.session import ship

ODD = [
    "", " ", "\n", "a\n\nb", "a\r\n12\r\nb", " 12 \n", "--- title\nx", "CHAPTER ONE", "É COLE", "12.5 - 3", "!!! ???", "x" * 1001, "é ﬁ ² ½", "NBSP\xa0\xa0runs line",
    "&amp;lt; &#39;&nbsp;&copy x", "don't can't won't they're it's I'LL", "cities tried trying running action bring there bigger", "a@b.co +1 (555) 123-4567 12345678901 1/2/2024 2024-01-02 $12.50 10:30 PM",
    "http://x.y/Z?q=1<b> https://q", "İstanbul ʼ", "٣ ４", "tab\there", "﻿bom �\x00\x9f", "the cat AND THE hat", "zero​width",
]


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    return spark.createDataFrame(list(enumerate(ODD)), "i int, t string")


def run(rows, column):
    return [r[0] for r in sorted(rows.select(column.alias("x"), "i").collect(), key=lambda r: r.i)]


def py(p):
    m = re.match(r"\(\?([a-zA-Z]+)\)", p)
    flags = (re.M if m and "m" in m[1] else 0) | (re.I if m and "i" in m[1] else 0)
    return re.compile(p[m.end() :] if m else p, flags)


@pytest.mark.parametrize("f,pattern,put", [(T.mask_urls, P.URL, "[URL]"), (T.mask_emails, P.EMAIL, "[EMAIL]"), (T.drop_page_numbers, P.PAGE_NUMBER, ""), (T.drop_rule_lines, P.RULE_LINE, ""), (T.mask_phones, P.PHONE, "[PHONE]")])
def test_masks_equal_python(rows, f, pattern, put):
    assert run(rows, f(F.col("t"))) == [py(pattern).sub(put, t) for t in ODD]


def test_strip_words_lines(rows):
    assert run(rows, T.strip(F.col("t"))) == [t.strip() for t in ODD]
    assert run(rows, T.words(F.col("t"))) == [t.split() for t in ODD]
    assert run(rows, T.tidy_lines(F.col("t"))) == ["\n".join(x for x in (" ".join(y.split()) for y in t.split("\n")) if x) for t in ODD]


def junk(line):
    return len(line) < 3 or sum(c.isalpha() for c in line) / len(line) < 0.3 or any(re.match(p, line) for p in (r"^[0-9\s\-\.]+$", r"^[^\w\s]+$", r"^[A-Z\s]+$"))


def test_filter_lines(rows):
    want = []
    for t in ODD:
        lines = [x.strip() for x in t.split("\n")]
        lines = [x[:1000] for x in lines if x and len(x) >= 10]
        want.append([x for x in lines if not junk(x)])
    assert run(rows, T.filter_lines(F.col("t"))) == want


def test_line_key_and_nfc(rows):
    assert run(rows, U.line_key(F.col("t"))) == [" ".join(html.unescape(unicodedata.normalize("NFKC", t)).lower().split()) for t in ODD]
    assert run(rows, U.nfc(F.col("t"))) == [U.nfc_text(t) for t in ODD]
    assert run(rows, U.unescape(F.col("t"))) == [html.unescape(t) for t in ODD]


def test_dead_contraction_and_stems(spark):
    rows = spark.createDataFrame([("don't can't won't it's",)], "t string")
    assert rows.select(T.expand_contractions(F.col("t"))).first()[0] == "don't cannot will not it is"
    words = "cities tried trying running bring there action bigger"
    assert spark.createDataFrame([(words,)], "t string").select(T.stem_words(F.col("t"))).first()[0] == "city try try runn br there ac bigg"


def test_loader_clean_glues_paragraphs(spark):
    assert spark.createDataFrame([("a\n\nb \n c",)], "t string").select(T.loader_clean(F.col("t"))).first()[0] == "ab\nc"


def test_own_lines_and_chunks(spark):
    row = spark.createDataFrame([(["A ", "b", "a", "B", "c"], "w " * 1030, "")], "l array<string>, t string, e string")
    assert row.select(T.dedup_lines(F.col("l"))).first()[0] == ["A ", "b", "c"]
    assert [len(c.split()) for c in row.select(T.word_chunks(F.col("t"))).first()[0]] == [512, 512, 6]
    assert row.select(T.word_chunks(F.col("e"))).first()[0] == []


def test_names_and_quality(spark):
    paths = ["/a/My File.PDF", "/a/b.c/noext", "x.tar.gz", "/d/é(1).html"]
    rows = spark.createDataFrame(list(enumerate(paths)), "i int, p string")
    assert run(rows, T.output_name(F.col("p"))) == ["MyFile_pdf.txt", "noext.txt", "x.tar_gz.txt", "é1_html.txt"]
    assert run(rows, T.extension(F.col("p"))) == [".pdf", "", ".gz", ".html"]
    q = spark.createDataFrame([("",), ("word " * 200,), ("....." * 40,)], "t string").select(T.text_quality(F.col("t"))).collect()
    assert q[0][0] == 0.0 and abs(q[1][0] - 0.8) < 1e-9 and q[2][0] < 0.3
