"""URL filters with redirect equivalence, in DataFrame functions alone.

Rules name a host and a path prefix; the longest fitting rule judges a url. URLs that
redirect to each other, or name each other as canonical, are one page under several names:
connected components over those edges carry a block decision to every alias. An explicit
allow always wins for the url it fits; it doesn't spread.

Nodes are urls without scheme and fragment, hosts in lower case (A-Z). Edges come from the
pages' ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` and from an optional table
of redirects. Urls of the same node need no edge.

Defined results: null and urls without ``://`` have an empty host and path, fit no rule and
are allowed; rows with equal ids or urls are judged one by one; null html has no edges;
comments, scripts, styles, templates and noscript hold no tags; targets are resolved against the
page's url after their character references are decoded (a ``base`` element is not read); empty ones, mere fragments and other schemes without ``://``
are no edges; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.session import materialise

#: (rule, verdict) as ``host/path``; the production rules of the query (fixed values).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The url's name in the alias graph; null without a host."""
    name = F.concat(host(url), F.regexp_extract(_rest(url), r"\A[^/?#]*([^#]*)", 1))
    return F.when(host(url) != "", name)


def fitting_rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as one chained condition for a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), *r)):  # longer ones are asked first
        name, _, tail = text.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith("/" + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def longest_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of all distinct names (host, path) that a rule of the table
    ``rules`` (rule, verdict) fits.

    Names meet rules by equal keys alone: every suffix of the host that has rules, with the
    path's prefix of every length that those rules have. No list of rules is too long for it,
    and a host with many rules is dealt by their paths.
    """
    tail = F.substring("rule", F.length(F.substring_index("rule", "/", 1)) + 2, F.length("rule"))
    table = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("name"), F.concat(F.lit("/"), tail).alias("start"))
    sizes = table.groupBy("name").agg(F.collect_set(F.length("start")).alias("sizes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = names.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("name"))
    starts = ends.join(sizes, "name").select("host", "path", "name", F.explode("sizes").alias("n")).where(F.length("path") >= F.col("n"))
    hits = starts.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(table, ["name", "start"])
    return hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("r")).select("host", "path", "r.rule", "r.verdict")


def with_rule(names: DataFrame, rules) -> DataFrame:
    """``names`` with the ``rule`` that fits host and path, and its verdict as ``own``; null without one."""
    if not isinstance(rules, DataFrame):
        rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
        return names.withColumns({"rule": rule, "own": verdict})
    return names.join(longest_rules(names, rules).withColumnRenamed("verdict", "own"), ["host", "path"], "left")


_ATTRIBUTE = r"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name=name)
    found = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.concat(*found)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Named character references of markup; &amp; is decoded last.
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def unescape(c: Column) -> Column:
    """``c`` with numeric and the five basic named character references decoded once."""

    def decoded(part: Column) -> Column:
        hexed, digits = F.regexp_extract(part, r"\A[xX]([0-9A-Fa-f]{1,6});", 1), F.regexp_extract(part, r"\A([0-9]{1,7});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # only a valid code reaches the decoder
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(63))), 8, "0")), "UTF-32")
        # an ampersand from a number starts no named reference
        char = F.when(char == "&", F.lit("&amp;")).otherwise(char)
        return F.when(valid, F.concat(char, F.regexp_replace(part, r"\A[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), part))

    out = _let(F.split(c, "&#"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), "")))
    for name, char in (*_NAMED, ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def _no_dots(name: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    return _let(F.split(name, "/"), lambda parts: _joined(F.slice(parts, 2, F.size(parts))))


def _joined(parts: Column) -> Column:
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))


def resolve(target: Column, url: Column) -> Column:
    """The absolute url that ``target`` means on the page ``url``; null if it names no other page."""
    return _let(F.regexp_replace(target, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), lambda t: _resolved(t, url))


def _resolved(t: Column, url: Column) -> Column:
    scheme = F.substring_index(url, "://", 1)
    place = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), r"\A[^/?#]*", 0))
    own = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    name = F.regexp_extract(t, r"\A[^?#]*", 0)
    query = F.substring(t, F.length(name) + 1, F.length(t))
    whole = F.when(t.startswith("/"), name).otherwise(F.concat(F.regexp_extract(own, r"\A.*/", 0), name))
    return (
        F.when((t == "") | t.startswith("#"), F.lit(None).cast("string"))
        .when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("?"), F.concat(place, own, t))
        .otherwise(F.concat(place, _no_dots(whole), query))
    )


#: What holds no tags of the page itself.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\z)"
#: A tag to its end; a > in a quoted value is no end (for the first 500 values).
_TAG = r"""(?is)<(?:link|meta)\b[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+){0,500}+>"""


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): canonical links and refresh redirects of the pages, as nodes."""
    tags = (
        pages.where(F.col("url").isNotNull() & (F.col("html").rlike(r"(?i)canonical") | F.col("html").rlike(r"(?i)http-equiv")))
        .select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0))).alias("tag"))
    )
    rel = F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+")
    canonical = F.when(F.array_contains(rel, "canonical"), unescape(_attribute(F.col("tag"), "href")))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(unescape(_attribute(F.col("tag"), "content")), r"(?is)url\s*=\s*['\"]?([^'\"\s]+)", 1))
    target = resolve(F.coalesce(canonical, refresh), F.col("url"))
    return tags.select(node(F.col("url")).alias("a"), _let(target, node).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and ``alias_of`` (its component).

    ``rules`` are pairs (rule, verdict), for short lists, or a table of them of any length; of a
    rule with both verdicts, block holds.
    ``redirects`` (source, target) are further urls known to redirect to each other.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b"))
    edges = materialise(edges.distinct(), "aliases")
    h, p = host(F.col("url")), path(F.col("url"))
    named = with_rule(pages.select("page_id", h.alias("host"), p.alias("path"), node(F.col("url")).alias("node")), rules)
    member = components(edges)
    # every node of the graph has a name, so it is judged by the rules whether it has a page or not
    name_host, name_path = F.regexp_extract("node", r"\A[^/?#]*", 0), F.regexp_extract("node", r"\A[^/?#]*([^?#]*)", 1)
    blocked = (
        with_rule(member.withColumns({"host": name_host, "path": name_path}), rules)
        .groupBy("component")
        .agg(F.max(F.when(F.col("own") == "block", 1).otherwise(0)).alias("blocked"))
    )
    spread = member.join(blocked, "component").select("node", F.col("component").alias("alias_of"), "blocked")
    return named.join(spread, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("blocked") == 1, "block").otherwise("allow").alias("verdict"),
        F.coalesce("alias_of", "node").alias("alias_of"),
    )
