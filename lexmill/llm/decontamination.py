"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Every benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window).
A document contains a window exactly if the words stand in it in order. The join runs on
hashed shingles of up to ``SHINGLE`` words:

1. order: the shingles of all windows are counted in all documents;
2. prefix: for exact containment one token of a window suffices, its rarest shingle; a
   window with a shingle that no document has can't occur and is dropped;
3. bounds: a hit of the prefix shingle at a position fixes the window's start, which must
   leave the whole window inside the document;
4. verification: the document's words at that place must equal the window's.

Documents are never shuffled with their text. The windows' side is measured and split into
blocks of at most ``BLOCK_BYTES``, each broadcast to the scan of all documents, so a
benchmark of any size is joined exactly.

Shingles are looked up on a fold that lower-cases every script (a coarser key than the
contract's A-Z); verification compares words that are lower-cased in A-Z only.

Defined results: null and empty texts have no words, are never hit and not contaminated;
items without words are ignored; equal items all count; words of an item with a null id are hit,
but it has no id to list or count; rows with equal ids are judged each by its own text; a null
doc_id is an id like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise

#: Words in a window, and in a shingle.
WINDOW, SHINGLE = 13, 5
#: Most bytes of window text that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Percent of hit words from which a document is contaminated.
PERCENT = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators in texts of any case: ASCII but letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _row(text: Column) -> Column:
    """A number that tells rows with the same id apart."""
    return F.xxhash64(text)


def _word_count(parts: Column) -> Column:
    """Words among the parts of a text between gaps, of which the outer ones may be empty."""
    outer = [F.when(F.element_at(parts, i) == "", 1).otherwise(0) for i in (1, -1)]
    return F.when(parts.isNull(), 0).otherwise(F.greatest(F.size(parts) - outer[0] - outer[1], F.lit(0))).cast("long")


def _fold(text: Column) -> Column:
    """A key coarser than A-Z lower-casing that maps each word by itself."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _shingle(keys: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(keys, at + j) for j in range(size)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, length, items): distinct windows and the sorted ids of their items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(_ascii_lower(F.col("text").cast("string"))).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    each = items.withColumn("length", length).select("item", "w", "length", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("s"))
    texts = each.select("item", "length", F.array_join(F.slice("w", F.col("s") + 1, F.col("length")), " ").alias("window"))
    return texts.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _tokens(wins: DataFrame, size: int) -> DataFrame:
    """(window, length, offset, h): the shingles of ``size`` words of each window."""
    keys = wins.withColumn("k", F.split(_fold(F.col("window")), " "))
    spots = keys.select("window", "length", "k", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
    return spots.select("window", "length", "offset", _shingle(F.col("k"), F.col("offset"), size).alias("h"))


def _lookup(docs: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """(doc_id, row, raw, pos, found): the word positions where a known shingle starts.

    ``tables`` maps the words of a shingle to (h, found), one row for each known hash, where
    found is an array. All sizes are looked up in one pass over the texts.
    """
    text = F.col("text").cast("string")
    both = docs.select("doc_id", _row(text).alias("row"), _words(text).alias("raw"), _words(_fold(text)).alias("keys"))
    # outer: keeps the optimizer from adding a filter that would split every text twice
    spots = both.select("doc_id", "row", "raw", "keys", F.posexplode_outer("keys").alias("pos", "word"))
    for size, table in tables.items():
        h = F.when(F.col("pos") + size <= F.size("keys"), _shingle(F.col("keys"), F.col("pos"), size))
        spots = spots.join(F.broadcast(table.select(F.col("h").alias(f"h{size}"), F.col("found").alias(f"f{size}"))), h == F.col(f"h{size}"), "left")
    found = [F.col(f"f{size}") for size in tables]
    hit = spots.where(F.coalesce(*found).isNotNull())
    # functions with lambdas would end the generated loop here, and whole texts be buffered for every position
    none = F.array().cast(hit.schema[f"f{min(tables)}"].dataType)
    return hit.select("doc_id", "row", "raw", "pos", F.concat(*(F.coalesce(f, none) for f in found)).alias("found"))


def _block_matches(docs: DataFrame, wins: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """Every occurrence of the given windows, whose tokens fit a broadcast."""
    parts = {size: _tokens(wins.where(F.least("length", F.lit(shingle)) == size), size) for size in sizes}
    known = {size: part.select("h").distinct().withColumn("found", F.array("h")) for size, part in parts.items()}
    seen = materialise(_lookup(docs, known).select(F.explode("found").alias("h")).groupBy("h").agg(F.count("*").alias("n")), "rarity")
    prefixes = {}
    for size, part in parts.items():
        rarest = part.join(F.broadcast(seen), "h").groupBy("window", "length").agg(F.min(F.struct("n", "h", "offset")).alias("p"), F.count("*").alias("k"))
        # a window with a shingle that no document has can't occur
        sure = rarest.where(F.col("k") == F.col("length") - size + 1)
        prefixes[size] = sure.groupBy(F.col("p.h").alias("h")).agg(F.collect_list(F.struct("window", "length", F.col("p.offset").alias("offset"))).alias("found"))
    hit = _lookup(docs, prefixes).select("doc_id", "row", "raw", "pos", F.explode("found").alias("w")).select("doc_id", "row", "raw", "w.*", (F.col("pos") - F.col("w.offset")).alias("start"))
    bounded = hit.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("raw")))
    same = _ascii_lower(F.array_join(F.slice("raw", F.col("start") + 1, F.col("length")), " ")) == F.col("window")
    return bounded.where(same).select("doc_id", "row", "start", "length", "window")


def matches(docs: DataFrame, wins: DataFrame, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row, start, length, window): every occurrence of every window.

    Two passes over the documents for each block of windows, whatever the windows' lengths.
    """
    shape = wins.agg(F.sum(F.octet_length("window") + 32).alias("bytes"), F.collect_set(F.least("length", F.lit(shingle))).alias("sizes")).first()
    blocks = max(1, -(-(shape.bytes or 0) // block_bytes))
    sizes = sorted(shape.sizes or [shingle])
    out = None
    for block in range(blocks):
        part = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        found = _block_matches(docs, part, sizes, shingle)
        out = found if out is None else out.unionByName(found)
    return out


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, and ``row``, which
    tells texts with the same id apart."""
    wins = materialise(windows(benchmark, window), "windows")
    found = materialise(matches(docs, wins, shingle, block_bytes), "matches")
    spans = found.select("doc_id", "row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("doc_id", "row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    sets = found.select("doc_id", "row", "window").distinct().join(wins.select("window", "items"), "window").groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    both = hits.join(sets, hits.doc_id.eqNullSafe(sets.doc_id) & (hits.row == sets.row)).select(hits.doc_id.alias("_id"), hits.row.alias("_row"), "n_hit", "items")
    text = F.col("text").cast("string")
    size = docs.select("doc_id", _row(text).alias("row"), F.split(text, _GAP).alias("parts")).select("doc_id", "row", _word_count(F.col("parts")).alias("n_words"))
    joined = size.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
        "row",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = decontamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (_row(F.col("text").cast("string")) == F.col("__row")), "left_anti")
