"""Streaming forms: stateless columns stream as they are; dedup and rollups keep bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder, or a single file, as a stream.

    The path is given as a pattern, since only then may it name a file.
    """
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def unique_lines(docs: DataFrame, key=lambda c: T.fold_line(F.coalesce(c, F.lit("")))) -> DataFrame:
    """(doc_id, line, h): first arrival of every line hash; state is one hash for each line.

    Unlike in batch, first means first to arrive.
    """
    each = docs.select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).withColumn("k", key(F.col("line"))).where("k <> ''")
    return each.select("doc_id", "line", T.line_hash(F.col("k")).alias("h")).dropDuplicates(["h"])


def recent_unique(events: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """First arrival of each key within ``delay``; older state is dropped."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_metrics(events: DataFrame, time_col: str, metric: Column, value: Column, width: str, delay: str) -> DataFrame:
    """Counts, mean and extremes by event-time window; rows later than ``delay`` are left out."""
    w = F.window(time_col, width)
    rolled = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).groupBy(w, metric.alias("metric")).agg(F.count("*").alias("n"), F.avg(value).alias("average"), F.min(value).alias("min"), F.max(value).alias("max"))
    return rolled.select(F.col("window.start").alias("start"), "metric", "n", "average", "min", "max")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, then stop; the rows written to ``path``.

    In complete mode every trigger rewrites the result under its own number, and the last is read.
    """
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last = [-1]

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{number}")
        last[0] = number

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}")
