"""Token tables are written in row groups that fit a reader's memory, and every token comes back."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexmill.sources import sinks


def test_token_tables_have_small_row_groups(spark, tmp_path):
    tokens = spark.range(4_000, numPartitions=1).selectExpr("id AS doc_id", "transform(sequence(0, 999), i -> cast((i * 7919 + id * 31) % 50000 AS int)) AS tokens")
    rows = tokens.unionByName(spark.createDataFrame([(-1, []), (-2, None)], "doc_id long, tokens array<int>")).coalesce(1)
    path = str(tmp_path / "tokens")
    sinks.write_tokens(rows, path)
    (file,) = glob.glob(f"{path}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    values = [meta.row_group(i).column(1).num_values for i in range(meta.num_row_groups)]
    assert sum(values) == 4_000_002 and max(values) < 1_000_000  # 4,096 rows of one group were all of them
    back = spark.read.parquet(path)
    same = back.join(rows.withColumnRenamed("tokens", "own"), "doc_id").where(F.col("tokens").eqNullSafe(F.col("own")))
    assert back.count() == same.count() == 4_002
