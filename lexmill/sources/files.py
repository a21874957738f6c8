"""File sources: directories, path lists and line records as DataFrames of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.patterns import INGEST_EXTENSIONS, LOADER_EXTENSIONS
from lexmill.session import ship
from lexmill.sources.extractors import EXTRACTORS, processor_name


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = True, extensions: tuple[str, ...] | None = None, name_pattern: str | None = None, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of matching files; missing ones are skipped.

    ``name_pattern`` is a regular expression that must be found in the file's name. The
    contents are read only by plans that use them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    if extensions:
        found = found.where(T.extension(F.col("path")).isin(*extensions))
    if name_pattern:
        found = found.where(F.regexp_extract("path", r"([^/]*)\z", 1).rlike(name_pattern))
    return found


def checked(files: DataFrame) -> DataFrame:
    """``files`` with ``valid`` and, where a file can't be processed, the ``reason``: no extractor
    serves its suffix, it is empty, or it couldn't be read."""
    reason = F.when(processor(F.col("path")).isNull(), "unsupported format").when(F.col("content").isNull(), "unreadable").when(F.length("content") == 0, "empty")
    return files.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else Latin-1; every line end becomes \\n."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def extracted(files: DataFrame, instead: dict[str, str] | None = None) -> DataFrame:
    """``path``, ``length``, ``text`` and ``error`` of every file; exactly one of the last two is null.

    ``instead`` names suffixes that are read as another one.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lexmill.sources.extractors import extract

        for b in batches:
            found = [extract(s, c, instead) for s, c in zip(b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "length": b["length"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    rows = files.select("path", F.col("length").cast("long").alias("length"), T.extension(F.col("path")).alias("suffix"), "content")
    return rows.mapInPandas(run, "path string, length long, text string, error string")


#: The loader reads markdown as it stands.
AS_PLAIN = {".md": ".txt", ".markdown": ".txt"}


def load_documents(files: DataFrame, clean: bool = True, min_length: int = 50, max_length: int | None = None) -> DataFrame:
    """The loader: extract, clean, drop short texts, cut long ones; with metadata columns."""
    docs = extracted(files.where(T.extension(F.col("path")).isin(*LOADER_EXTENSIONS)), AS_PLAIN).where("error is null")
    text = T.loader_clean(F.col("text")) if clean else F.col("text")
    docs = docs.withColumn("text", text).where(F.length("text") >= min_length)
    if max_length:
        docs = docs.withColumn("text", F.substring("text", 1, max_length))
    meta = T.metadata(F.col("text"))
    return docs.select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("filename"), F.col("length").alias("file_size"), "text", meta.char_count.alias("char_count"), meta.word_count.alias("word_count"), meta.line_count.alias("line_count"), T.extension(F.col("path")).alias("file_type"))


def ingest(files: DataFrame, extensions: tuple[str, ...] = INGEST_EXTENSIONS) -> DataFrame:
    """The ingestion pipeline: every supported file with its text or error and output name."""
    found = extracted(files.where(T.extension(F.col("path")).isin(*extensions)))
    return found.withColumn("output", T.output_name(F.col("path"))).withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("failed"))


def line_records(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(line): every stripped line that isn't blank."""
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(paths)
    return lines.select(T.strip(F.col("value")).alias("line")).where("line <> ''")


def records(spark: SparkSession, path: str, kind: str, text_col: str = "text") -> DataFrame:
    """(text) of csv, json (lines) or parquet files."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"') if kind == "csv" else spark.read
    return reader.format(kind).load(path).select(F.col(text_col).cast("string").alias("text"))


def load_inputs(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Documents of a file, a list of files or a folder, by the loader; a folder is searched to its bottom.

    Broken files are left out of a folder or a list; a single file that can't be read raises.
    """
    one = isinstance(paths, str) and _FILE_NAME.search(paths) is not None
    found = scan(spark, paths)
    if one:
        failed = extracted(found, AS_PLAIN).where("error is not null").select("path", "error").head()
        if failed is not None:
            raise ValueError(f"{failed.path}: {failed.error}")
    return load_documents(found, **options)


#: A path that ends like a file's name.
_FILE_NAME = re.compile(r"[^/.][^/]*\.[^./]+$")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the ``*.txt`` files of a folder itself; blank files are skipped."""
    found = scan(spark, path, recursive=False, glob="*.txt")
    return found.select("path", decoded(F.col("content")).alias("text")).where(T.strip(F.col("text")) != "")


def processor(path: Column) -> Column:
    """Name of the extractor that serves a path's suffix, null if there is none."""
    names = {suffix: processor_name(suffix) for suffix in EXTRACTORS}
    out = F.lit(None).cast("string")
    for suffix, name in names.items():
        out = F.when(T.extension(path) == suffix, name).otherwise(out)
    return out


# -- PDF ----------------------------------------------------------------------------------


def _pdf(files: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(path, content)`` of every PDF file."""
    ship(files.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for path, content in zip(b["path"], b["content"], strict=True) for r in rows(path, content)]
            yield pd.DataFrame(found, columns=names)

    return files.where(T.extension(F.col("path")) == ".pdf").select("path", "content").mapInPandas(run, schema)


def pdf_pages(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(path, page, text, error): every page, or those of ``pages`` (from 0) that a file has.

    A file that is no PDF has one row with its error.
    """

    def rows(path, content):
        from lexmill.sources import pdf

        try:
            texts = pdf.page_texts(content, pages)
            wanted = range(len(texts)) if pages is None else [p for p in pages if 0 <= p < len(pdf.Document(content).pages())]
            return [(path, p, t, None) for p, t in zip(wanted, texts, strict=True)]
        except ValueError as e:
            return [(path, None, None, str(e))]

    return _pdf(files, "path string, page int, text string, error string", rows)


def pdf_texts(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, text, score, good): pages joined by line ends, and whether the text reads well enough
    to do without OCR."""
    pages = pdf_pages(files).where("error is null")
    whole = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text), "\n").alias("text"))
    return whole.withColumn("score", T.text_quality(F.col("text"))).withColumn("good", F.col("score") >= threshold)


def pdf_info(files: DataFrame) -> DataFrame:
    """(path, page_count, metadata, encrypted, file_size, has_images, error) of every PDF file."""

    def rows(path, content):
        from lexmill.sources import pdf

        try:
            x = pdf.info(content)
            return [(path, x["page_count"], x["metadata"], x["encrypted"], x["file_size"], x["has_images"], None)]
        except ValueError as e:
            return [(path, None, None, None, None, None, str(e))]

    return _pdf(files, "path string, page_count int, metadata map<string,string>, encrypted boolean, file_size long, has_images boolean, error string", rows)


# -- tokens -------------------------------------------------------------------------------


def _saved_tensor(content: bytes):
    """The one tensor of a saved ``.pt`` archive as an array, without running anything in it.

    The archive holds a pickle that names the tensor's storage; only the names below resolve.
    """
    import io
    import pickle
    import zipfile

    import numpy as np

    kinds = {"LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1"}

    def rebuild(storage, offset, size, stride, *_):
        return np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride]) if size else storage[offset : offset + 1]

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        top = next(n for n in z.namelist() if n.endswith("/data.pkl")).removesuffix("data.pkl")

        class Loader(pickle.Unpickler):
            def find_class(self, module, name):
                if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
                    return rebuild
                if module == "torch" and name in kinds:
                    return name
                if (module, name) == ("collections", "OrderedDict"):
                    return dict
                raise pickle.UnpicklingError(f"{module}.{name} is no part of a tensor file")

            def persistent_load(self, key):
                return np.frombuffer(z.read(f"{top}data/{key[2]}"), kinds[key[1]])[: key[4]]

        found = Loader(io.BytesIO(z.read(f"{top}data.pkl"))).load()
    if isinstance(found, dict):
        found = next(iter(found.values()))
    return np.array(found)


def token_files(files: DataFrame) -> DataFrame:
    """(path, tokens): token files of NumPy (``.npy``) or saved integer tensors (``.pt``)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for b in batches:
            arrays = [np.load(io.BytesIO(c)) if p.lower().endswith(".npy") else _saved_tensor(c) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "tokens": [a.astype("int64").ravel() for a in arrays]})

    return files.where(T.extension(F.col("path")).isin(".npy", ".pt")).select("path", "content").mapInPandas(run, "path string, tokens array<bigint>")
