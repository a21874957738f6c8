"""Sinks: corpora, one text per document, token tables, samples, JSON. Inputs are never overwritten."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise, ship


def write_corpus(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """All texts as lines of text files."""
    docs.select(text_col).write.mode("errorifexists").text(path)


def write_named(docs: DataFrame, path: str, name_col: str = "output", text_col: str = "text") -> None:
    """A folder for each document's name, holding its text."""
    docs.select(name_col, F.col(text_col).alias("value")).write.mode("errorifexists").partitionBy(name_col).text(path)


def _exists(place: str) -> bool:
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(place)
    return store.get_file_info(folder).type != fs.FileType.NotFound


def write_texts(docs: DataFrame, path: str, name_col: str = "output", text_col: str = "text") -> DataFrame:
    """One file for each document, by its name, in a new folder; (name, bytes) of what was written.

    Tasks write the files themselves, so the folder must be one that every executor reaches. A
    task that runs again writes its files again. Of equal names the one with the greatest text
    stays; null texts are empty.
    """
    place = path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
    if _exists(place):
        raise FileExistsError(path)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(place)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            size = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = text.encode()
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
                size.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64())], ["name", "bytes"])

    named = docs.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.max(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    safe = named.where(~F.col("name").contains("/") & ~F.col("name").isin("", ".", ".."))
    return materialise(safe.mapInArrow(run, "name string, bytes bigint"), "written")


#: Bytes of a row group of token arrays. Spark reads up to 4,096 rows of a group into one batch and
#: gives each token a value and two levels there, in buffers that grow by doubling.
TOKEN_GROUP = 1 << 20


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token arrays as Parquet, in row groups small enough to be read back in little memory."""
    tokens.write.mode("errorifexists").option("parquet.block.size", TOKEN_GROUP).parquet(path)


def write_samples(samples: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Input ids of all samples as one token column in sample order; overlaps repeat, labels go.

    Rows are (id, sample, position, token), range-partitioned in that order.
    """
    flat = samples.select(id_col, "sample", F.posexplode("input_ids").alias("position", "token"))
    flat.repartitionByRange(id_col, "sample").sortWithinPartitions(id_col, "sample", "position").write.mode("errorifexists").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("errorifexists").json(path)
