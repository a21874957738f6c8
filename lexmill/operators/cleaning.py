"""The document cleaner with statistics, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import unicode as U


def clean_documents(
    docs: DataFrame,
    urls: bool = True,
    emails: bool = True,
    phones: bool = True,
    preserve_formatting: bool = False,
    min_line: int = 10,
    max_line: int = 1000,
    dedup: bool = True,
    normalize: bool = True,
) -> DataFrame:
    """``docs`` with ``cleaned`` and a struct of counts per row; no shuffle.

    Mojibake, NFC, masks and artifacts, white space, line filters, repeated lines, end.
    Null text becomes empty.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    fixed = T.fix_mojibake(raw)
    fixed = U.nfc(fixed) if normalize else fixed
    out = docs.withColumn("__raw", raw).withColumn("__spaced", T.clean_whitespace(T.remove_unwanted(fixed, urls, emails, phones), preserve_formatting))
    out = out.withColumn("__lines", T.filter_lines(F.col("__spaced"), min_line, max_line))
    kept = T.dedup_lines(F.col("__lines")) if dedup else F.col("__lines")
    out = out.withColumn("__kept", kept).withColumn("cleaned", T.final_cleanup(F.array_join("__kept", "\n")))
    before, after = F.length("__raw"), F.length("cleaned")
    stats = F.struct(
        before.cast("long").alias("original_length"),
        after.cast("long").alias("cleaned_length"),
        (F.size(T.lines(F.col("__raw"))) - F.size(T.lines(F.col("cleaned")))).cast("long").alias("lines_removed"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("duplicates_removed"),
        (before - after).cast("long").alias("chars_removed"),
        F.when(before > 0, after / before).otherwise(0.0).alias("compression_ratio"),
    )
    return out.withColumn("stats", stats).drop("__raw", "__spaced", "__lines", "__kept")


def clean_batch(docs: DataFrame, **options) -> DataFrame:
    """``clean_documents``, but a text that can't be processed comes back as it is, with counts of
    zero and ``failed``: bytes that aren't UTF-8 would end the whole job otherwise."""
    valid = F.col("text").isNull() | F.is_valid_utf8("text")
    marked = docs.withColumn("__text", F.col("text")).withColumn("failed", ~valid).withColumn("text", F.when(valid, F.col("text")).otherwise(""))
    out = clean_documents(marked, **options)
    zero = F.struct(*(F.lit(0).cast(f.dataType).alias(f.name) for f in out.schema["stats"].dataType.fields))
    bad = F.col("failed")
    return out.withColumns({"text": F.col("__text"), "cleaned": F.when(bad, F.col("__text")).otherwise(F.col("cleaned")), "stats": F.when(bad, zero).otherwise(F.col("stats"))}).drop("__text")


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """One row: documents, sums, ratio of sums, MB saved."""
    s = F.col("stats")
    total = F.coalesce(F.sum(s.original_length), F.lit(0))
    rest = F.coalesce(F.sum(s.cleaned_length), F.lit(0))
    return cleaned.agg(
        F.count("*").alias("total_documents"),
        total.alias("total_original_length"),
        rest.alias("total_cleaned_length"),
        F.coalesce(F.sum(s.lines_removed), F.lit(0)).alias("total_lines_removed"),
        F.coalesce(F.sum(s.duplicates_removed), F.lit(0)).alias("total_duplicates_removed"),
        F.round(F.when(total > 0, rest / total).otherwise(0.0), 6).alias("overall_ratio"),
        F.round((total - rest) / 1048576, 6).alias("mb_saved"),
    )
