"""Queries of the text functions, the cleaner and exact dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as T
from lexmill.functions import unicode as U
from lexmill.operators import cleaning, dedup, reports
from lexmill.plans.registry import query
from lexmill.session import read_table, ship

#: Appended to texts, so that rules fire that the tables alone wouldn't trigger.
SAMPLE = (
    "\n   12  \n--- title ---\nSee http://a.example/x?y=1 or mail me.too@b.example.org, +1 (555) 123-4567.\n"
    "donâ€™t â€œsayâ€ cafÃ©  it's 1/2/2024 at 10:30 PM for $12.50 we'll can't won't\nCHAPTER ONE\n12.5 - 3\n\n\n\n  cities running quickly   \tend  \nx\n"
)
#: SAMPLE as a SQL literal.
SQL_SAMPLE = "'" + SAMPLE.replace("'", "''") + "'"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str, sample: bool = True) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.withColumn("text", F.concat("text", F.lit(SAMPLE))) if sample else docs


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


_T = f"(text || {SQL_SAMPLE})"


@query(
    f"""SELECT doc_id, {strip_sql("replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _T + r", '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^\s+|\s+$', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), '�', '')")} AS cleaned FROM documents"""
)
def b1_loader_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.loader_clean(F.col("text")).alias("cleaned"))


def _fold(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


@query(f"SELECT doc_id, {_fold(_T, P.MOJIBAKE)} AS fixed FROM documents")
def b2_fix_mojibake(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fix_mojibake(F.col("text")).alias("fixed"))


@query("SELECT doc_id, regexp_replace(nfc_normalize(text || 'e' || chr(769) || chr(8203) || chr(7) || chr(9)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]|' || chr(8203), '', 'g') AS normal FROM documents")
def b3_nfc(spark, sf_dir):
    return _docs(spark, sf_dir, False).select("doc_id", U.nfc(F.concat("text", F.lit("é​\x07\t"))).alias("normal"))


_URL_SQL = r"'https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+'"


@query(f"SELECT page_id, regexp_replace('see ' || url || ' \"x\"', {_URL_SQL}, '[URL]', 'g') AS masked FROM pages")
def b4_mask_urls(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", T.mask_urls(F.concat(F.lit("see "), "url", F.lit(' "x"'))).alias("masked"))


@query(f"SELECT doc_id, regexp_replace({_T}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '[EMAIL]', 'g') AS masked FROM documents")
def b5_mask_emails(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.mask_emails(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, regexp_replace({_T}, '(\\+?1[-.\\s]?)?\\(?[0-9]{{3}}\\)?[-.\\s]?[0-9]{{3}}[-.\\s]?[0-9]{{4}}', '[PHONE]', 'g') AS masked FROM documents")
def b6_mask_phones(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.mask_phones(F.col("text")).alias("masked"))


@query(r"SELECT doc_id, regexp_replace(text || chr(7) || 'a' || chr(133) || chr(65533) || chr(65533) || 'b', '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|' || chr(65533), '', 'g') AS cleaned FROM documents")
def b7_drop_controls(spark, sf_dir):
    return _docs(spark, sf_dir, False).select("doc_id", T.drop_controls(F.concat("text", F.lit("\x07a\x85��b"))).alias("cleaned"))


@query(f"SELECT doc_id, regexp_replace({_T}, '(?m)^\\s*\\d+\\s*$', '', 'g') AS cleaned FROM documents")
def b8_drop_page_numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.drop_page_numbers(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, regexp_replace({_T}, '(?m)^[-=_]{{3,}}.*$', '', 'g') AS cleaned FROM documents")
def b9_drop_rule_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.drop_rule_lines(F.col("text")).alias("cleaned"))


_UNWANTED = _T
for _p, _r in (
    (_URL_SQL, "[URL]"),
    (r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'", "[EMAIL]"),
    (r"'(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}'", "[PHONE]"),
    (r"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\x{fffd}'", ""),
    (r"'(?m)^\s*\d+\s*$'", ""),
    (r"'(?m)^[-=_]{3,}.*$'", ""),
):
    _UNWANTED = f"regexp_replace({_UNWANTED}, {_p}, '{_r}', 'g')"


@query(f"SELECT doc_id, {_UNWANTED} AS cleaned FROM documents")
def b10_remove_unwanted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.remove_unwanted(F.col("text")).alias("cleaned"))


def _spaces(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g')"
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: {strip_sql('y')}), chr(10))"


@query(f"SELECT doc_id, {_spaces(_T)} AS cleaned FROM documents")
def b11_clean_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_whitespace(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda y: substr(y, 1, 1000)), chr(10)) AS cut FROM documents")
def b12_truncate_lines(spark, sf_dir):
    return _docs(spark, sf_dir, False).select("doc_id", F.array_join(F.transform(T.lines(F.col("text")), lambda x: F.substring(x, 1, 1000)), "\n").alias("cut"))


@query(f"SELECT doc_id, CASE WHEN {strip_sql('text')} <> '' THEN {strip_sql('text')} || chr(10) ELSE '' END AS cleaned FROM documents")
def b13_final_cleanup(spark, sf_dir):
    return _docs(spark, sf_dir, False).select("doc_id", T.final_cleanup(F.col("text")).alias("cleaned"))


_JUNK = r"""(length(y) < 3 OR length(regexp_replace(y, '[^\p{L}]', '', 'g')) / length(y) < 0.3 OR regexp_matches(y, '^[0-9\s\-.]+$') OR regexp_matches(y, '^[^\p{L}\p{N}_\s]+$') OR regexp_matches(y, '^[A-Z\s]+$'))"""


def _filtered(x: str) -> str:
    bare = f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: {strip_sql('y')}), lambda y: y <> '' AND length(y) >= 10)"
    return f"list_filter(list_transform({bare}, lambda y: substr(y, 1, 1000)), lambda y: NOT {_JUNK})"


@query(f"SELECT doc_id, array_to_string({_filtered(_T)}, chr(10)) AS kept, len({_filtered(_T)})::BIGINT AS n FROM documents")
def c4_filter_lines(spark, sf_dir):
    kept = T.filter_lines(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(kept, "\n").alias("kept"), F.size(kept).cast("long").alias("n"))


@query(f"""SELECT doc_id, len(list_filter(l, lambda y: {strip_sql('y')} <> ''))::BIGINT AS not_blank, len(list_filter(l, lambda y: length({strip_sql('y')}) >= 10))::BIGINT AS long_enough,
  len(list_filter(list_transform(l, lambda y: substr({strip_sql('y')}, 1, 1000)), lambda y: y <> '' AND {_JUNK}))::BIGINT AS junk
FROM (SELECT doc_id, string_split({_T}, chr(10)) AS l FROM documents)""")
def c1_c3_line_predicates(spark, sf_dir):
    """Lines that pass each predicate by itself."""
    bare = F.transform(T.lines(F.col("text")), T.strip)
    cut = F.transform(bare, lambda x: F.substring(x, 1, 1000))
    count = lambda a, p: F.size(F.filter(a, p)).cast("long")
    return _docs(spark, sf_dir).select(
        "doc_id",
        count(bare, lambda x: x != "").alias("not_blank"),
        count(bare, lambda x: F.length(x) >= 10).alias("long_enough"),
        count(cut, lambda x: (x != "") & T.is_junk(x)).alias("junk"),
    )


@query("SELECT doc_id, lang FROM documents WHERE length(text) >= 500")
def c5_min_length(spark, sf_dir):
    return _docs(spark, sf_dir, False).where(F.length("text") >= 500).select("doc_id", "lang")


@query(f"SELECT lang, count(*) FILTER ({strip_sql('text')} <> '') AS extracted, count(*) FILTER ({strip_sql('text')} = '') AS rejected FROM documents GROUP BY lang")
def c6_reject_empty(spark, sf_dir):
    bare = T.strip(F.col("text"))
    return _docs(spark, sf_dir, False).groupBy("lang").agg(F.count(F.when(bare != "", 1)).alias("extracted"), F.count(F.when(bare == "", 1)).alias("rejected"))


_DEDUP = """
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(k, k[i]) = i), lambda i: l[i]), chr(10)) AS text,
  (len(l) - len(list_distinct(k)))::BIGINT AS removed
FROM (SELECT doc_id, l, list_transform(l, lambda y: {strip}) AS k FROM ({lines}))
"""


@query(_DEDUP.format(strip=strip_sql("lower(y)"), lines="SELECT doc_id, list_filter(string_split(text || chr(10) || text, chr(10)), lambda y: " + strip_sql("y") + " <> '') AS l FROM documents"))
def d1_own_line_dedup(spark, sf_dir):
    """Repeated lines within each document (each text stands here twice)."""
    docs = _docs(spark, sf_dir, False)
    all_lines = F.filter(T.lines(F.concat("text", F.lit("\n"), "text")), lambda x: T.strip(x) != "")
    kept = T.dedup_lines(F.col("l"))
    return docs.select("doc_id", all_lines.alias("l")).select("doc_id", F.array_join(kept, "\n").alias("text"), (F.size("l") - F.size(kept)).cast("long").alias("removed"))


_CLEANER = f"""
WITH a AS (SELECT doc_id, text || {SQL_SAMPLE} AS raw FROM documents),
b AS (SELECT doc_id, raw, {_spaces(_UNWANTED.replace(_T, _fold("raw", P.MOJIBAKE)))} AS spaced FROM a),
c AS (SELECT doc_id, raw, {_filtered("spaced")} AS l FROM b),
d AS (SELECT doc_id, raw, l, list_transform(l, lambda y: {strip_sql("lower(y)")}) AS k FROM c),
e AS (SELECT doc_id, raw, len(l) AS n, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(k, k[i]) = i), lambda i: l[i]) AS kept FROM d),
f AS (SELECT doc_id, raw, n, len(kept) AS m, {strip_sql("array_to_string(kept, chr(10))")} AS body FROM e),
g AS (SELECT doc_id, raw, n, m, CASE WHEN body <> '' THEN body || chr(10) ELSE '' END AS cleaned FROM f)
SELECT $columns FROM g
"""


@query(
    _CLEANER.replace(
        "$columns",
        "doc_id, sha256(cleaned) AS cleaned, length(raw)::BIGINT AS original_length, length(cleaned)::BIGINT AS cleaned_length, "
        "(len(string_split(raw, chr(10))) - len(string_split(cleaned, chr(10))))::BIGINT AS lines_removed, (n - m)::BIGINT AS duplicates_removed, "
        "(length(raw) - length(cleaned))::BIGINT AS chars_removed, round(length(cleaned) / length(raw), 6) AS ratio"
    )
)
def b14_clean_documents(spark, sf_dir):
    """The whole cleaner with its counts per document."""
    s = F.col("stats")
    out = cleaning.clean_documents(_docs(spark, sf_dir))
    return out.select(
        "doc_id", F.sha2("cleaned", 256).alias("cleaned"), s.original_length.alias("original_length"), s.cleaned_length.alias("cleaned_length"), s.lines_removed.alias("lines_removed"),
        s.duplicates_removed.alias("duplicates_removed"), s.chars_removed.alias("chars_removed"), F.round(s.compression_ratio, 6).alias("ratio"),
    )


@query(
    _CLEANER.replace(
        "$columns",
        "doc_id, doc_id % 7 = 0 AS failed, CASE WHEN doc_id % 7 = 0 THEN 'FF' ELSE sha256(cleaned) END AS cleaned, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(raw) END::BIGINT AS original_length, "
        "CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(raw) - length(cleaned) END::BIGINT AS chars_removed"
    )
)
def b15_clean_batch(spark, sf_dir):
    """The cleaner over a table in which every seventh text is no UTF-8."""
    docs = _docs(spark, sf_dir)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise(F.col("text")))
    out = cleaning.clean_batch(docs)
    digest = F.when(F.col("failed"), F.hex(F.col("cleaned").cast("binary"))).otherwise(F.sha2("cleaned", 256))
    return out.select("doc_id", "failed", digest.alias("cleaned"), F.col("stats.original_length").alias("original_length"), F.col("stats.chars_removed").alias("chars_removed"))


@query(
    _CLEANER.replace(
        "$columns",
        "count(*) AS total_documents, sum(length(raw))::BIGINT AS total_original_length, sum(length(cleaned))::BIGINT AS total_cleaned_length, "
        "sum(len(string_split(raw, chr(10))) - len(string_split(cleaned, chr(10))))::BIGINT AS total_lines_removed, sum(n - m)::BIGINT AS total_duplicates_removed, "
        "round(sum(length(cleaned)) / sum(length(raw)), 6) AS overall_ratio, round((sum(length(raw)) - sum(length(cleaned))) / 1048576, 6) AS mb_saved"
    )
)
def f1_cleaning_summary(spark, sf_dir):
    return cleaning.cleaning_summary(cleaning.clean_documents(_docs(spark, sf_dir)))


# -- normalization ------------------------------------------------------------------------

_KEY = strip_sql(r"regexp_replace(lower({}), '\s+', ' ', 'g')")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(SAMPLE)).alias("text"))
    return talk.withColumn("k", T.fold_line(F.col("text")))


_TALK = f"(SELECT conv_id, turn, text || {SQL_SAMPLE} AS text FROM conversations)"


@query(f"SELECT conv_id, turn, {_KEY.format("text || ' CAF' || chr(201) || chr(9) || ' End '")} AS k FROM conversations")
def b16_line_key(spark, sf_dir):
    ship(spark)
    talk = read_table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", U.line_key(F.concat("text", F.lit(" CAFÉ\t End "))).alias("k"))


@query(f"SELECT page_id, {_fold(chr(40) + 'url || chr(32) || ' + repr('&lt;b&gt; &quot;q&quot; &amp;amp; &#39;') + chr(41), (('&lt;', '<'), ('&gt;', '>'), ('&quot;', chr(34)), ('&#39;', chr(39)), ('&amp;', '&')))} AS decoded FROM pages")
def b17_unescape(spark, sf_dir):
    """Entities of every page's url and of a sample; the urls' own ampersands start no entity."""
    ship(spark)
    return read_table(spark, sf_dir, "pages").select("page_id", U.unescape(F.concat("url", F.lit(" &lt;b&gt; &quot;q&quot; &amp;amp; &#39;"))).alias("decoded"))


def _contract(x: str) -> str:
    for k, v in P.CONTRACTIONS:
        x = f"regexp_replace({x}, '\\b{k.replace(chr(39), chr(39) * 2)}\\b', '{v}', 'gi')"
    return x


def _masked(x: str) -> str:
    for p, r in (
        (r"https?://[^\s]+", "URL"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL"), (r"[\+]?[1-9]?[0-9]{7,15}", "PHONE"), (r"[$£€¥₹]\s*\d+(?:\.\d{2})?", "CURRENCY"),
        (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "DATE"), (r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b", "TIME"),
    ):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


def _semantic(x: str) -> str:
    x = rf"regexp_replace({_masked(_contract(x))}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return strip_sql(rf"regexp_replace(regexp_replace({x}, '\d+', 'NUM', 'g'), '\s+', ' ', 'g')")


@query(f"SELECT conv_id, turn, {_contract(_KEY.format('text'))} AS expanded FROM {_TALK}")
def b18_expand_contractions(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.expand_contractions(F.col("k")).alias("expanded"))


@query(f"SELECT conv_id, turn, {_masked('text')} AS masked FROM {_TALK}")
def b19_mask_structured(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.mask_structured(F.col("text")).alias("masked"))


@query(f"SELECT conv_id, turn, {_semantic(_KEY.format('text'))} AS folded FROM {_TALK}")
def b20_semantic_fold(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.semantic_fold(F.col("k")).alias("folded"))


_STOP = "(" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + ")"


def _no_stop(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN {_STOP}), ' ')"


def _stems(x: str) -> str:
    cases = " ".join(f"WHEN ends_with(w, '{s}') THEN left(w, length(w) - {len(s)}) || '{r}'" for s, r in P.SUFFIXES)
    return f"array_to_string(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 4 THEN w {cases} ELSE w END), ' ')"


@query(f"SELECT conv_id, turn, {_no_stop('text')} AS kept FROM {_TALK}")
def b21_drop_stopwords(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.drop_stopwords(F.col("text")).alias("kept"))


@query(f"SELECT conv_id, turn, {_stems('text')} AS stems FROM {_TALK}")
def b22_stem_words(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.stem_words(F.col("text")).alias("stems"))


_AGGRESSIVE = strip_sql(r"regexp_replace({}, '\s+', ' ', 'g')")


@query(f"SELECT conv_id, turn, {_AGGRESSIVE.format(_stems(_no_stop(_semantic(_KEY.format('text')))))} AS folded FROM {_TALK}")
def b23_aggressive_fold(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.aggressive_fold(T.semantic_fold(F.col("k"))).alias("folded"))


@query(f"SELECT conv_id, turn, sha256({_KEY.format('text')}) AS sha, md5({_KEY.format('text')}) AS md FROM {_TALK}")
def b24_line_hash(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.line_hash(F.col("k")).alias("sha"), T.line_hash(F.col("k"), "md5").alias("md"))


@query(f"""SELECT conv_id, turn, length(text)::BIGINT AS original_length, length(k)::BIGINT AS normalized_length, length(s)::BIGINT AS semantic_length,
  length(g)::BIGINT AS aggressive_length, round(1.0 - length(g) / length(text), 6) AS reduction_ratio, regexp_matches(text, 'https?://[^\\s]+') AS urls, regexp_matches(text, '\\d') AS numbers
FROM (SELECT *, {_AGGRESSIVE.format(_stems(_no_stop('s')))} AS g FROM (SELECT *, {_semantic('k')} AS s FROM (SELECT *, {_KEY.format('text')} AS k FROM {_TALK})))""")
def b25_normalization_stats(spark, sf_dir):
    s = F.col("s")
    return _talk(spark, sf_dir).withColumn("s", T.normalization_stats(F.col("text"), F.col("k"))).select(
        "conv_id", "turn", s.original_length.alias("original_length"), s.normalized_length.alias("normalized_length"), s.semantic_length.alias("semantic_length"),
        s.aggressive_length.alias("aggressive_length"), F.round(s.reduction_ratio, 6).alias("reduction_ratio"), s.contains_urls.alias("urls"), s.contains_numbers.alias("numbers"),
    )


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def b26_alphabetic_ratio(spark, sf_dir):
    return _docs(spark, sf_dir, False).where(F.length("text") > 0).select("doc_id", F.round(T.alphabetic_ratio(F.col("text")), 6).alias("ratio"))


@query(r"""
WITH a AS (SELECT doc_id, text, length(text) AS total, length(regexp_replace(text, '\s', '', 'g')) AS chars, regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([a-zA-Z]{2,})(?:$|[^\p{L}\p{N}_])') AS x FROM documents WHERE length(text) > 0),
b AS (SELECT *, list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[a-zA-Z]{2,}$')) AS w FROM a),
c AS (SELECT *, len(w) AS n, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS letters FROM b)
SELECT doc_id, round(greatest(0, least(1, chars / total * 0.3 + least(1, n / 100) * 0.3 + CASE WHEN n > 0 THEN least(1, greatest(0, (letters / n - 1) / 10)) ELSE 0 END * 0.2 + least(1, n / total * 50) * 0.2
  - least(0.3, len(regexp_extract_all(text, '[^\x00-\x7F]+')) / total * 10) - least(0.3, len(regexp_extract_all(text, '\.{3,}')) / total * 10) - least(0.3, len(regexp_extract_all(text, '\s{5,}')) / total * 10))), 6) AS score
FROM c
""")
def b27_text_quality(spark, sf_dir):
    return _docs(spark, sf_dir, False).where(F.length("text") > 0).select("doc_id", F.round(T.text_quality(F.col("text")), 6).alias("score"))


@query(f"SELECT doc_id, length({strip_sql('text')}) < 50 OR (length({strip_sql('text')}) > 0 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length({strip_sql('text')}) < 0.1) AS ocr FROM documents")
def b28_needs_ocr(spark, sf_dir):
    return _docs(spark, sf_dir, False).select("doc_id", T.needs_ocr(F.col("text")).alias("ocr"))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_TIDY = "array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda y: " + strip_sql(r"regexp_replace(y, '\s+', ' ', 'g')") + "), lambda y: y <> ''), chr(10))"
_NODES = "html"
for _tag in ("script", "style", "noscript"):
    _NODES = f"regexp_replace({_NODES}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', chr(10), 'g')"
_NODES = _fold(f"regexp_replace(regexp_replace({_NODES}, '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]+>', chr(10), 'g')", _ENTITIES)


@query(f"SELECT page_id, sha256({_TIDY.format(_NODES)}) AS text FROM pages")
def b29_html_nodes(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_nodes(F.col("html")), 256).alias("text"))


_BASIC = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
for _tag in P.BLOCK_TAGS:
    _BASIC = f"regexp_replace(regexp_replace({_BASIC}, '(?i)<{_tag}[^>]*>', chr(10), 'g'), '(?i)</{_tag}>', chr(10), 'g')"


@query(f"SELECT page_id, sha256({_fold(f'regexp_replace({_BASIC}, {chr(39)}<[^>]+>{chr(39)}, {chr(39) * 2}, {chr(39)}g{chr(39)})', _ENTITIES)}) AS text FROM pages")
def b30_html_basic(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_basic(F.col("html")), 256).alias("text"))


@query(f"SELECT doc_id, {_TIDY.format(_T)} AS text FROM documents")
def b31_tidy_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.tidy_lines(F.col("text")).alias("text"))


#: Markdown in front of each document's text.
_MD = "# Head **bold** and `code`\n\n```\ndrop me\n```\n> quote\n- item\n12. twelve\n[link](http://x) ![alt](u) [r][1] ![i][2]\n|a|b|\n|:-|-:|\n[1]: http://y\n<!-- gone -->\n\\# star\n"
_MD_SQL = "('" + _MD + "' || replace(replace(text, '*', ''), '_', ''))"
for _i, (_p, _r) in enumerate((*P.MARKDOWN, *P.MARKDOWN_REST)):
    if "(?<!" not in _p:
        _q = _p.replace("(?Udm)", "(?m)").replace("(?dm)", "(?m)").replace("(?d)", "").replace("'", "''")
        _MD_SQL = f"regexp_replace({_MD_SQL}, '{_q}', '{_r.replace('$1$2', chr(92) + '1' + chr(92) + '2').replace('$1', chr(92) + '1')}', 'g')"


@query(f"SELECT doc_id, {_MD_SQL} AS plain FROM documents")
def b33_b34_markdown(spark, sf_dir):
    """Markdown as text; the made-up markdown has no single stars or underscores in pairs."""
    docs = _docs(spark, sf_dir, False)
    return docs.select("doc_id", T.markdown_plain(F.concat(F.lit(_MD), F.regexp_replace("text", "[*_]", ""))).alias("plain"))


@query(r"""SELECT page_id, CASE WHEN e <> '' THEN b || '_' || e || '.txt' ELSE b || '.txt' END AS name FROM (
  SELECT page_id, regexp_replace(CASE WHEN x <> '' THEN regexp_replace(n, '\.[^.]+$', '') ELSE n END, '[^\p{L}\p{N}._-]', '', 'g') AS b, regexp_replace(x, '[^\p{L}\p{N}]', '', 'g') AS e
  FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS n, lower(regexp_extract(url, '[^/.][^/]*(\.[^./]+)$', 1)) AS x FROM pages))""")
def b35_output_name(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.output_name(F.col("url")).alias("name"))


@query(f"SELECT doc_id, length({_T})::BIGINT AS char_count, len(list_filter(string_split_regex({_T}, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count, len(string_split({_T}, chr(10)))::BIGINT AS line_count FROM documents")
def b36_metadata(spark, sf_dir):
    m = F.col("m")
    return _docs(spark, sf_dir).withColumn("m", T.metadata(F.col("text"))).select("doc_id", m.char_count.alias("char_count"), m.word_count.alias("word_count"), m.line_count.alias("line_count"))


@query(r"""SELECT doc_id, c::BIGINT AS chunk, array_to_string(w[c * 512 + 1 : c * 512 + 512], ' ') AS text FROM (
  SELECT doc_id, w, unnest(range(0, (len(w) + 511) // 512)) AS c FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda y: y <> '') AS w FROM documents))""")
def b37_word_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir, False)
    return docs.select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


@query(r"SELECT ext, count(*) AS n, ext IN ('.txt', '.pdf', '.docx', '.pptx', '.md', '.markdown', '.html') AS supported FROM (SELECT lower(regexp_extract(url, '[^/.][^/]*(\.[^./]+)$', 1)) AS ext FROM pages WHERE regexp_matches(url, '[0-9]+\.html')) GROUP BY ext")
def a8_c7_c8_extensions(spark, sf_dir):
    """Suffix membership of paths whose name matches a pattern."""
    named = read_table(spark, sf_dir, "pages").where(F.col("url").rlike(r"[0-9]+\.html")).select(T.extension(F.col("url")).alias("ext"))
    return named.groupBy("ext").agg(F.count("*").alias("n")).withColumn("supported", F.col("ext").isin(*P.LOADER_EXTENSIONS, ".html"))


# -- exact dedup --------------------------------------------------------------------------

_LINES = f"""WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
), k AS (SELECT doc_id, pos, line, {_KEY.format('line')} AS k FROM l),
r AS (SELECT *, k = '' OR row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) = 1 AS kept FROM k)
"""


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _docs(spark, sf_dir, False)


@query(_LINES + "SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS text, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept FROM r GROUP BY doc_id")
def d5_corpus_line_dedup(spark, sf_dir):
    out = dedup.dedup_corpus_lines(_lined(spark, sf_dir))
    return out.select("doc_id", F.sha2("text", 256).alias("text"), "n_lines", "n_kept")


@query(_LINES + "SELECT lang, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_removed, count(DISTINCT CASE WHEN kept AND k <> '' THEN k END) AS n_distinct FROM r JOIN documents USING (doc_id) GROUP BY lang")
def d5_corpus_line_dedup_stats(spark, sf_dir):
    """Lines of each language kept and removed by corpus-wide dedup."""
    return dedup.line_dedup_stats(_lined(spark, sf_dir), "lang")


@query(_LINES + "SELECT lang, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_removed, round(100.0 * count(*) FILTER (NOT kept) / count(*), 2) AS reduction, round(count(*) / 4.0, 2) AS lines_per_second FROM r JOIN documents USING (doc_id) GROUP BY lang")
def f4_dedup_summary(spark, sf_dir):
    """Lines, removed lines, the reduction in percent and the speed, had it taken four seconds."""
    return reports.dedup_summary(dedup.line_dedup_stats(_lined(spark, sf_dir), "lang"), 4).drop("n_distinct")


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
r AS (SELECT *, k = '' OR row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) = 1 AS kept FROM (SELECT *, {_KEY.format('line')} AS k FROM l))
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS text, count(*) FILTER (NOT kept) AS n_removed FROM r GROUP BY doc_id""")
def d4_own_line_dedup(spark, sf_dir):
    return dedup.dedup_own_lines(_lined(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text"), "n_removed")


@query(_LINES + "SELECT doc_id, count(DISTINCT k) AS n FROM k WHERE k <> '' GROUP BY doc_id")
def d2_line_hash_set(spark, sf_dir):
    return dedup.line_hash_set(_lined(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_LINES + "SELECT count(DISTINCT k) AS n FROM k WHERE k <> ''")
def f14_distinct_lines(spark, sf_dir):
    return dedup.line_hash_set(_lined(spark, sf_dir)).agg(F.count_distinct("h").alias("n"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY.format('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def d6_record_dedup(spark, sf_dir):
    return dedup.dedup_records(_lined(spark, sf_dir), "doc_id", "text").select("doc_id")


@query(_LINES + f"SELECT doc_id, pos::INT AS pos FROM k WHERE k <> '' AND k NOT IN (SELECT {_KEY.format('line')} FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)))")
def d3_e3_unseen_lines(spark, sf_dir):
    """Incremental dedup: lines of all documents that neither the benchmark nor a conversation holds."""
    lined = dedup.keyed_lines(_lined(spark, sf_dir), columns=("doc_id", "pos")).where("h is not null")
    seen = read_table(spark, sf_dir, "benchmark").select("text").unionByName(read_table(spark, sf_dir, "conversations").select("text"))
    return dedup.unseen(lined, dedup.keyed_lines(seen, columns=())).select("doc_id", "pos")


@query(_LINES + "SELECT k AS line, count(DISTINCT doc_id) AS n FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 2")
def i6_shared_lines(spark, sf_dir):
    """Lines that several documents share."""
    lined = dedup.keyed_lines(_lined(spark, sf_dir), key=lambda c: T.fold_line(F.coalesce(c, F.lit(""))))
    return lined.where("h is not null").groupBy("h").agg(F.min(T.fold_line(F.col("line"))).alias("line"), F.count_distinct("doc_id").alias("n")).where("n >= 2").select("line", "n")


@query(f"SELECT count(*) AS records, sum(length(line))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {strip_sql('line')} <> ''")
def a21_line_records(spark, sf_dir):
    """Every line that is not blank is a record."""
    each = _docs(spark, sf_dir, False).select(F.explode(T.lines(F.col("text"))).alias("line")).where(T.strip(F.col("line")) != "")
    return each.agg(F.count("*").alias("records"), F.sum(F.length("line")).alias("chars"))


_LETTERS = "list_transform(range(97, 123), lambda c: (length(k) - length(replace(k, chr(c::INT), '')))::DOUBLE)"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An embedding that SQL can compute too: how often each of a to z stands in a text."""
    return [[float(t.count(chr(c))) for c in range(97, 123)] for t in texts]


@query(
    _LINES
    + f""", t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '') AS text FROM r GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '') AS w FROM t),
c AS (SELECT doc_id, c, array_to_string(w[c * 64 + 1 : c * 64 + 64], ' ') AS piece FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 63) // 64)) AS c FROM w)),
v AS (SELECT doc_id, c, {_LETTERS} AS v FROM (SELECT doc_id, c, {_KEY.format('piece')} AS k FROM c) WHERE k <> ''),
gone AS (SELECT DISTINCT b.doc_id, b.c FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.c < b.c WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0 AND list_cosine_similarity(a.v, b.v) >= 0.985),
j AS (SELECT c.doc_id, count(*) AS n_chunks, count(gone.c) AS n_similar, coalesce(string_agg(piece, ' ' ORDER BY c.c) FILTER (gone.c IS NULL), '') AS joined FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.c = gone.c GROUP BY c.doc_id)
SELECT doc_id, sha256(CASE WHEN n_chunks > 1 THEN joined ELSE text END) AS text, coalesce(n_chunks, 0)::BIGINT AS n_chunks, CASE WHEN n_chunks > 1 THEN n_similar ELSE 0 END::BIGINT AS n_similar FROM t LEFT JOIN j USING (doc_id)"""
)
def d7_d10_dedup_texts(spark, sf_dir):
    """Exact line dedup, chunks of 64 words, their letter counts, similar chunks of a text removed."""
    out = dedup.dedup_texts(_lined(spark, sf_dir), 0.985, 64, letter_counts)
    return out.select("doc_id", F.sha2("text", 256).alias("text"), "n_chunks", F.col("n_similar").cast("long").alias("n_similar"))
