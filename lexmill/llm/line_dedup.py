"""Line dedup by distinct-site spread.

A line found on many sites is boilerplate. A HyperLogLog sketch of the sites is kept for
every line hash; sketches merge by aggregation, so a line that a third of all documents
holds is merged on the map side like any other. Lines whose estimate lies within the
sketch's error of the threshold get an exact distinct count, so the verdict equals an exact
count for every line. The first occurrence (smallest document, then position) stays, later
ones are removed.

Defined results: a line counts by its text without outer blanks, tabs and carriage returns;
lines of nothing else are never removed; null text stays null and has no lines; a null
source is a site of its own; rows whose doc_id is null are returned unchanged; lines of rows
with equal ids are ordered by position, then by a hash of the row's text, and every row loses its
own lines alone; rows with equal ids and texts are one document; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise

#: Distinct sites from which a line is boilerplate.
SITES = 10
#: log2 of the sketch's registers: 1.6 % standard error.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over 12 standard errors.
BAND = 0.2


def _key(line: Column) -> Column:
    """128-bit line hash, null for blank lines."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, site, pos, key) of every line that is not blank.

    ``row`` tells texts with the same id apart. Sites are never empty strings, which sketches
    leave out.
    """
    text = F.col("text").cast("string")
    return (
        docs.where("doc_id is not null")
        .select("doc_id", F.xxhash64(text).alias("row"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row", "site", "pos", _key(F.col("line")).alias("key"))
        .where("key is not null")
    )


#: Where a line stands, in the order of occurrences.
_PLACE = ("doc_id", "pos", "row")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(key, first) of every line on at least ``sites`` sites; first is its first occurrence."""
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct(*_PLACE)).alias("first"))
    estimated = spread.select("key", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - BAND))
    estimated = materialise(estimated, "spread")
    near = estimated.where(F.col("estimate") <= sites * (1 + BAND))
    exact = (
        lines.join(near.select("key"), "key", "left_semi")
        .groupBy("key")
        .agg(F.count_distinct("site").alias("n"))
        .where(F.col("n") >= sites)
        .select("key")
    )
    sure = estimated.where(F.col("estimate") > sites * (1 + BAND)).select("key", "first")
    return sure.unionByName(near.join(exact, "key").select("key", "first"))


def removed_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(doc_id, row, removed): the positions of each text's removed lines.

    Texts are split and hashed once; the lines' places and hashes are written and read again.
    """
    lines = materialise(lines_of(docs), "lines")
    # the keys of boilerplate lines are far fewer than lines; the planner broadcasts them when their size allows
    later = lines.join(boilerplate(lines, sites), "key").where(F.struct(*_PLACE) > F.col("first"))
    return later.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("removed"))


def dedup_lines(docs: DataFrame, sites: int = SITES, details: bool = False) -> DataFrame:
    """``docs`` with the removed lines gone from ``text`` (and ``n_chars`` recounted).

    ``details=True`` adds ``n_lines`` (all lines) and ``n_removed``.
    """
    own = docs.columns
    hits = removed_lines(docs, sites).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("removed").alias("__removed"))
    joined = docs.join(hits, (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__row")), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed")), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own]
    if details:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
        columns += [n.cast("long").alias("n_lines"), F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed")]
    out = joined.select(*columns)
    # in a projection of its own: the text must be put together once
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out
