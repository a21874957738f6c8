"""Pre-token frequencies, vocabulary ids, and use of a public tokenizer file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.sequences import numbered
from lexmill.session import ship

SPECIALS = ("<pad>", "<unk>", "<s>", "</s>")
PRETOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def pretokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PRETOKEN), F.lit(0))


def frequencies(docs: DataFrame, least: int = 2) -> DataFrame:
    """(token, freq) of pre-tokens found at least ``least`` times; counts combine before the shuffle."""
    return docs.select(F.explode(pretokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def vocabulary(docs: DataFrame, least: int = 2, size: int | None = None) -> DataFrame:
    """(token, freq, id): most frequent first, behind the special tokens."""
    ranked = numbered(frequencies(docs, least), [F.col("freq").desc(), F.col("token")], "id").withColumn("id", F.col("id") + len(SPECIALS))
    return ranked if size is None else ranked.where(F.col("id") < size)


def model_rows(ranked: DataFrame) -> DataFrame:
    """(token, id) of a whole vocabulary, special tokens first, as it is written by the JSON sink."""
    special = ranked.sparkSession.createDataFrame(list(zip(SPECIALS, range(len(SPECIALS)), strict=True)), "token string, id long")
    return special.unionByName(ranked.select("token", "id"))


# -- tokenizer files ----------------------------------------------------------------------


class Tokenizer(Protocol):
    """What every kind of tokenizer file offers."""

    size: int

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[list[int]]) -> list[str]: ...


class _Json:
    """A file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.size = self.library.get_vocab_size()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode_batch(ids, skip_special_tokens=False)


class _Pieces:
    """A model of the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.size = self.library.vocab_size()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


class _Ranks:
    """A table of byte strings and ranks, for the tiktoken library."""

    #: The byte-level pre-token pattern (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tiktoken import Encoding

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.library = Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = len(ranks)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(t) for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) for x in ids]


#: Which kind of tokenizer serves a suffix.
KINDS: dict[str, type] = {".json": _Json, ".model": _Pieces, ".tiktoken": _Ranks}
_models: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, by its suffix; one for each process and file."""
    if path not in _models:
        suffix = os.path.splitext(path)[1].lower()
        if suffix not in KINDS:
            raise ValueError(f"no tokenizer reads {suffix or path}; known are {', '.join(KINDS)}")
        _models[path] = KINDS[suffix](path)
    return _models[path]


#: Bytes of texts, or number of ids, that a tokenizer gets at once: what it makes of them takes
#: about a hundred times the ids while they are in work.
SLICE = 1 << 20


def slices(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Neighbours of at most ``most`` together, or a larger one by itself."""
    first = at = total = 0
    for at, size in enumerate(sizes):
        if at > first and total + size > most:
            yield slice(first, at)
            first, total = at, 0
        total += size
    yield slice(first, at + 1)


def encoded(model: Tokenizer, batch: pa.RecordBatch, max_length: int | None = None, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches (id, tokens) of a batch (id, text), one for each slice of the texts."""
    for part in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), most):
        rows = batch[part]
        ids = [np.array(x[:max_length], np.int32) for x in model.encode([t or "" for t in rows.column(1).to_pylist()])]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], [batch.schema.names[0], "tokens"])


def decoded(model: Tokenizer, ids: pd.Series, most: int = SLICE) -> list[str]:
    """The text of every array of ids, slice by slice; null is the empty text."""
    out: list[str] = []
    for part in slices((0 if x is None else len(x) for x in ids), most):
        out += model.decode([[] if x is None else np.asarray(x).tolist() for x in ids.iloc[part]])
    return out


def encode(docs: DataFrame, path: str, max_length: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens): ids of a tokenizer file, cut at ``max_length`` if given; null text has none."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for b in batches:
            yield from encoded(model, b, max_length)

    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, tokens array<int>")


def decode(tokens: Column, path: str) -> Column:
    """Text of an array of ids; null is the empty text."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(decoded(tokenizer(path), s), index=s.index, dtype="object")

    return F.pandas_udf(run, "string")(tokens)
