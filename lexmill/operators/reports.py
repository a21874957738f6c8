"""Counters and summaries of processing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def processing_stats(files: DataFrame, by: list[str], size: Column, failed: Column | None = None) -> DataFrame:
    """Per group ``by``: files_processed, files_failed and total_size (of those processed)."""
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    return files.groupBy(*by).agg(
        F.count(F.when(~bad, 1)).alias("files_processed"), F.count(F.when(bad, 1)).alias("files_failed"), F.coalesce(F.sum(F.when(~bad, size)), F.lit(0)).alias("total_size")
    )


def processing_summary(files: DataFrame, error: Column, size: Column, seconds: float | None = None) -> DataFrame:
    """One row: files, successes, failures, success rate in percent, MB, distinct errors, files a second.

    A file failed if its ``error`` is not null; without files the rate is 0.
    """
    total, good = F.count("*"), F.count(F.when(error.isNull(), 1))
    rate = F.when(total > 0, F.round(100.0 * good / total, 2)).otherwise(0.0)
    speed = F.round(total / F.lit(float(seconds)), 2) if seconds else F.lit(None).cast("double")
    return files.agg(
        total.alias("total_files"), good.alias("successful"), (total - good).alias("failed"), rate.alias("success_rate"),
        F.round(F.coalesce(F.sum(F.when(error.isNull(), size)), F.lit(0)) / 1048576, 4).alias("total_mb"), F.count_distinct(error).alias("error_types"), speed.alias("files_per_second"),
    )


def dedup_summary(stats: DataFrame, seconds: float | None = None) -> DataFrame:
    """The rows of ``line_dedup_stats`` with removed lines in percent and, if timed, lines a second."""
    percent = F.when(F.col("n_lines") > 0, F.round(100.0 * F.col("n_removed") / F.col("n_lines"), 2)).otherwise(0.0)
    out = stats.withColumn("reduction", percent)
    return out.withColumn("lines_per_second", F.round(F.col("n_lines") / float(seconds), 2)) if seconds else out


def first_errors(files: DataFrame, error: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows with an error, in order."""
    return files.where(F.col(error).isNotNull()).orderBy(order).limit(n)


def vector_norms(rows: DataFrame, by: list[str], vector: str, kind: float = 2.0) -> DataFrame:
    """Per group: the norm over all numbers of all its vectors, and how many numbers there are.

    ``kind`` is the order of the norm; infinity gives the largest absolute value. Null numbers
    are left out.
    """
    each = rows.select(*by, F.explode(vector).alias("x")).select(*by, F.abs(F.col("x").cast("double")).alias("x"))
    norm = F.max("x") if kind == float("inf") else F.pow(F.sum(F.pow("x", F.lit(float(kind)))), F.lit(1.0 / kind))
    return each.groupBy(*by).agg(norm.alias("norm"), F.count("x").alias("n"))


def override(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key; where the right side has a value, it wins.

    Both sides have ``key`` once and the same other columns; a null on the right overrides nothing.
    """
    values = [c for c in left.columns if c != key]
    other = right.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in values))
    both = left.join(other, F.col(key) == F.col("__key"), "full")
    return both.select(F.coalesce("__key", key).alias(key), *(F.coalesce(f"__{c}", c).alias(c) for c in values))
