"""Text functions, Column -> Column, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import patterns as P

LETTERS = r"[^\p{L}]+"


#: Every character that is white space (a fixed value).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def words(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def replace_all(c: Column, rules) -> Column:
    """Regex rewrites in order."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


# -- cleaning -----------------------------------------------------------------------------


def fix_mojibake(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), P.MOJIBAKE, c)


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, P.URL, "[URL]")


def mask_emails(c: Column) -> Column:
    return F.regexp_replace(c, P.EMAIL, "[EMAIL]")


def mask_phones(c: Column) -> Column:
    return F.regexp_replace(c, P.PHONE, "[PHONE]")


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, P.CONTROLS, ""), P.REPLACEMENT, "")


def drop_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, P.PAGE_NUMBER, "")


def drop_rule_lines(c: Column) -> Column:
    return F.regexp_replace(c, P.RULE_LINE, "")


def remove_unwanted(c: Column, urls: bool = True, emails: bool = True, phones: bool = True) -> Column:
    """Masks, then artifacts, in order."""
    for on, step in ((urls, mask_urls), (emails, mask_emails), (phones, mask_phones)):
        c = step(c) if on else c
    return drop_rule_lines(drop_page_numbers(drop_controls(c)))


def clean_whitespace(c: Column, preserve_formatting: bool = False) -> Column:
    if preserve_formatting:
        return c
    c = replace_all(c, ((" {2,}", " "), ("\n{3,}", "\n\n"), (r"(?dm)[ \t]+$", "")))
    return F.array_join(F.transform(lines(c), strip), "\n")


def alphabetic_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, LETTERS, "")) / F.length(c)


def is_junk(line: Column) -> Column:
    """Short, hardly alphabetic, only numbers, only punctuation or only ASCII capitals."""
    return (
        (F.length(line) < 3)
        | (alphabetic_ratio(line) < 0.3)
        | line.rlike(r"(?Ud)\A[0-9\s\-.]+\n?\z")
        | line.rlike(r"(?Ud)\A[^\p{L}\p{N}_\s]+\n?\z")
        | line.rlike(r"(?Ud)\A[A-Z\s]+\n?\z")
    )


def filter_lines(c: Column, min_length: int = 10, max_length: int = 1000) -> Column:
    """Array of stripped lines: long enough, cut at the most, without junk."""
    bare = F.filter(F.transform(lines(c), strip), lambda x: (x != "") & (F.length(x) >= min_length))
    return F.filter(F.transform(bare, lambda x: F.substring(x, 1, max_length)), lambda x: ~is_junk(x))


def dedup_lines(array: Column) -> Column:
    """First of each line, equal without case and outer white space, in order.

    Lines are sorted by key and place, so a text of many lines costs little more than its length.
    """
    placed = F.sort_array(F.transform(array, lambda x, i: F.struct(strip(F.lower(x)).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = F.transform(F.array(placed), lambda rows: F.filter(rows, lambda r, i: (i == 0) | (r.k != F.get(rows, i - 1).k)))
    return F.transform(F.sort_array(F.transform(F.element_at(firsts, 1), lambda r: F.struct(r.i.alias("i"), r.x.alias("x")))), lambda r: r.x)


def final_cleanup(c: Column) -> Column:
    bare = strip(c)
    return F.when(bare != "", F.concat(bare, F.lit("\n"))).otherwise(F.lit(""))


def loader_clean(c: Column) -> Column:
    """The file loader's cleaning. Its line stripping also eats blank lines and newlines."""
    c = replace_all(c, ((r"(?U)\n\s*\n\s*\n", "\n\n"), (r"[ \t]+", " "), (r"(?Udm)^\s+|\s+$", ""), (P.CONTROLS, ""), ("�", "")))
    return strip(c)


# -- normalization ------------------------------------------------------------------------


def expand_contractions(c: Column) -> Column:
    return replace_all(c, [(r"(?iUd)\b" + k.replace("'", "'") + r"\b", v) for k, v in P.CONTRACTIONS])


def mask_structured(c: Column) -> Column:
    return replace_all(c, ((P.URL_LOOSE, "URL"), (P.EMAIL, "EMAIL"), (P.PHONE_DIGITS, "PHONE"), (P.CURRENCY, "CURRENCY"), (P.DATE, "DATE"), (P.TIME, "TIME")))


def fold_line(c: Column, preserve_case: bool = False) -> Column:
    """Line key of text that is NFKC and free of entities already."""
    return F.trim(collapse(c if preserve_case else F.lower(c)))


def semantic_fold(line_key: Column, preserve_numbers: bool = False) -> Column:
    """From a line key to the form compared for meaning."""
    c = mask_structured(expand_contractions(line_key))
    c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", " ")
    c = c if preserve_numbers else F.regexp_replace(c, r"(?U)\d+", "NUM")
    return strip(collapse(c))


def drop_stopwords(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(*P.STOPWORDS)), " ")


def stem(word: Column) -> Column:
    """First fitting suffix rule on words of more than four characters."""
    out = word
    for suffix, put in reversed(P.SUFFIXES):
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put))
        out = F.when(word.endswith(suffix), cut).otherwise(out)
    return F.when(F.length(word) > 4, out).otherwise(word)


def stem_words(c: Column) -> Column:
    return F.array_join(F.transform(words(c), stem), " ")


def aggressive_fold(semantic: Column) -> Column:
    return strip(collapse(stem_words(drop_stopwords(semantic))))


def line_hash(line_key: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"unknown hash algorithm: {algorithm}")
    return F.sha2(line_key, 256) if algorithm == "sha256" else F.md5(line_key)


def normalization_stats(text: Column, line_key: Column) -> Column:
    """Lengths of each form and what the raw text contains."""
    semantic = semantic_fold(line_key)
    aggressive = aggressive_fold(semantic)
    n = F.length(text)
    return F.struct(
        n.cast("long").alias("original_length"),
        F.length(line_key).cast("long").alias("normalized_length"),
        F.length(semantic).cast("long").alias("semantic_length"),
        F.length(aggressive).cast("long").alias("aggressive_length"),
        F.when(n > 0, 1.0 - F.length(aggressive) / n).otherwise(0.0).alias("reduction_ratio"),
        text.rlike(P.URL_LOOSE).alias("contains_urls"),
        text.rlike(P.EMAIL).alias("contains_emails"),
        text.rlike(r"(?U)\d").alias("contains_numbers"),
        text.rlike(P.ENTITY).alias("contains_html_entities"),
    )


# -- extraction ---------------------------------------------------------------------------


def tidy_lines(c: Column) -> Column:
    """White space collapsed in every line, empty lines dropped."""
    return F.array_join(F.filter(F.transform(lines(c), lambda x: strip(collapse(x))), lambda x: x != ""), "\n")


def basic_entities(c: Column) -> Column:
    """The entities of plain pages, the ampersand last."""
    for entity, put in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(put))
    return c


def html_basic(c: Column) -> Column:
    """Scripts, styles and comments go, block tags break lines, other tags vanish."""
    c = replace_all(c, ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?s)<!--.*?-->", "")))
    for tag in P.BLOCK_TAGS:
        c = replace_all(c, ((f"(?i)<{tag}[^>]*>", "\n"), (f"(?i)</{tag}>", "\n")))
    return basic_entities(F.regexp_replace(c, "<[^>]+>", ""))


def html_nodes(c: Column) -> Column:
    """Every text node on a line of its own, for well-formed pages."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "\n")
    c = replace_all(c, ((r"(?s)<!--.*?-->", "\n"), ("<[^>]+>", "\n")))
    return tidy_lines(basic_entities(c))


def markdown_plain(c: Column) -> Column:
    return replace_all(replace_all(c, P.MARKDOWN), P.MARKDOWN_REST)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)\z", 1))


def output_name(path: Column) -> Column:
    """stem_ext.txt of the letters, digits and ._- of the file's name."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    ext = F.regexp_replace(extension(path), r"[^\p{L}\p{N}]", "")
    stem_ = F.when(extension(path) != "", F.regexp_replace(name, r"\.[^.]+\z", "")).otherwise(name)
    base = F.regexp_replace(stem_, r"[^\p{L}\p{N}._-]", "")
    return F.when(ext != "", F.concat(base, F.lit("_"), ext, F.lit(".txt"))).otherwise(F.concat(base, F.lit(".txt")))


def needs_ocr(c: Column, min_length: int = 50, min_density: float = 0.1) -> Column:
    bare = F.length(strip(c))
    dense = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / bare
    return (bare < min_length) | ((bare > 0) & (dense < min_density))


def text_quality(c: Column) -> Column:
    """Score of extracted text from 0 to 1: readable words against artifacts."""
    total = F.length(c)
    chars = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    found = F.regexp_extract_all(c, F.lit(r"(?U)\b[a-zA-Z]{2,}\b"), F.lit(0))
    n = F.size(found)
    letters = F.aggregate(found, F.lit(0), lambda s, w: s + F.length(w))
    mean = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (letters / n - 1) / 10))).otherwise(0.0)
    penalty = sum(F.least(F.lit(0.3), F.regexp_count(c, F.lit(p)) / total * 10) for p in (r"[^\x00-\x7F]+", r"\.{3,}", r"(?U)\s{5,}"))
    score = chars / total * 0.3 + F.least(F.lit(1.0), n / 100) * 0.3 + mean * 0.2 + F.least(F.lit(1.0), n / total * 50) * 0.2 - penalty
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def metadata(c: Column) -> Column:
    """Characters, words and lines."""
    return F.struct(
        F.length(c).cast("long").alias("char_count"),
        F.size(words(c)).cast("long").alias("word_count"),
        F.when(c == "", 0).otherwise(F.size(lines(c))).cast("long").alias("line_count"),
    )


def word_chunks(c: Column, size: int = 512) -> Column:
    """Groups of ``size`` words, each joined by one blank."""
    w = words(c)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
