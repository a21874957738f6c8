"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontamination, line_dedup, minhash, pii, quality, suffix_dedup, token_counts, toxicity, url_filters
from lexmill.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: File name of the byte-level vocabulary.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer file is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what they decode to."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False, with_text=False)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path(), limit=512)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is rejected."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the target are documents labelled good."""
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality(read_table(spark, sf_dir, "documents"), trusted)


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii(read_table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and a digest of what stays."""
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), details=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, site, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines
), boiler AS (
  SELECT k, min((doc_id, pos)) AS first FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10
), marked AS (
  SELECT x.doc_id, x.pos, x.line, b.k IS NOT NULL AND (x.doc_id, x.pos) > b.first AS gone
  FROM keyed x LEFT JOIN boiler b ON x.k = b.k
), texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM texts
"""


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_filters.judge(read_table(spark, sf_dir, "pages")).drop("alias_of")


ORACLES["op1_url_filters"] = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^#]*)', 1) AS tail FROM parts
), pages_n AS (
  SELECT page_id, html, host, path, CASE WHEN host <> '' THEN host || tail END AS node FROM named
), rules(rule, rhost, rpath, decision) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
    ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), tags AS (
  SELECT node AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages_n WHERE node IS NOT NULL
), targets AS (
  SELECT a, CASE
      WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical["''\s>]') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh["''\s>]') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1)
    END AS target FROM tags
), split AS (
  SELECT a, substr(target, instr(target, '://') + 3) AS rest FROM targets WHERE instr(target, '://') > 0
), edges AS (
  SELECT DISTINCT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM split
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(x, y) AS (
  SELECT DISTINCT a, a FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a
), judged AS (
  SELECT x, max(CASE WHEN d = 'block' THEN 1 ELSE 0 END) AS blocked FROM (
    SELECT x, y, (SELECT arg_max(decision, length(rule)) FROM rules
      WHERE (regexp_extract(y, '^[^/?#]*') = rhost OR ends_with(regexp_extract(y, '^[^/?#]*'), '.' || rhost)) AND starts_with(regexp_extract(y, '^[^/?#]*([^?#]*)', 1), rpath)) AS d
    FROM reach) GROUP BY x
), fitted AS (
  SELECT p.page_id, p.host, p.path, p.node, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.decision, length(r.rule)) AS own
  FROM pages_n p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY ALL
)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.own, CASE WHEN j.blocked = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted f LEFT JOIN judged j ON f.node = j.x
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    out = decontamination.decontamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op2_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s + 1 : s + m], ' ') AS t FROM (
    SELECT item_id, w, least(13, len(w)) AS m, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, m, array_to_string(w[s + 1 : s + m], ' ') AS t FROM (
    SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), f AS (
  SELECT DISTINCT doc_id, s, dw.m AS m, item_id FROM dw JOIN iw USING (m, t)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM f) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM f GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


# by a prefix-filtered join on whole shingles
ORACLES["op7_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT doc_id, n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s JOIN n USING (doc_id) GROUP BY doc_id, n
), reps AS (
  SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY k
), r AS (
  SELECT rep, n, g, count(*) OVER (PARTITION BY g) AS f FROM s JOIN reps ON doc_id = rep
), p AS (
  SELECT rep, n, g FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS i FROM r) WHERE i <= n - ceil(0.85 * n) + 1
), c AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM c JOIN r x ON x.rep = a JOIN r y ON y.rep = b AND y.g = x.g GROUP BY a, b
  HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), e AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(x, y) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a
), comp AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, rep, d.doc_id) AS component_id, coalesce(m, rep, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (k) LEFT JOIN comp ON x = rep
"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier ones."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


# by the whole bytes of every window, in hexadecimal
ORACLES["op6_suffix_dedup"] = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1
), runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY doc_id, run
), gone AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM runs GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN ss IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(ss) + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE es[j] END) + 1, 2 * ((CASE WHEN j = len(ss) THEN n ELSE ss[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE es[j] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


# The columns of two operators that SQL can express, so that SQL holds against them.


@query
def pii_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base patterns in every document."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


ORACLES["pii_base_columns"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
    regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
    list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t
)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || right(ltrim(p, '0'), 3))::INT <= 255))))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse(x), i + 1, 1)::INT
    ELSE 2 * substr(reverse(x), i + 1, 1)::INT - CASE WHEN substr(reverse(x), i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m
"""


@query
def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether they fail it."""
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ORACLES["quality_base_columns"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
