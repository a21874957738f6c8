"""All registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import io_queries, table_queries, text_queries  # noqa: F401  (they register)
from lexmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: lines kept and removed by corpus-wide exact line dedup."""
    return QUERIES["d5_corpus_line_dedup_stats"](spark, sf_dir)
