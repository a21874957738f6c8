"""From documents to token samples: the stages in one plan, under one configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions import text as T
from lexmill.operators import cleaning, dedup, sequences, vocabulary
from lexmill.session import materialise


def cleaned(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, text): cleaned and without lines seen anywhere before; emptied ones go."""
    c = config.cleaning
    out = cleaning.clean_documents(docs, c.urls, c.emails, c.phones, False, c.min_line, c.max_line, c.dedup).select("doc_id", F.col("cleaned").alias("text"))
    out = materialise(out, "cleaned")  # the line dedup reads it twice
    return dedup.dedup_corpus_lines(out, algorithm=config.dedup.algorithm).where(T.strip(F.col("text")) != "").select("doc_id", "text")


def deduplicated(docs: DataFrame, config: Config, embed=dedup.hashed_vectors) -> DataFrame:
    """Lines seen before and chunks like earlier ones of their text removed, with counts."""
    d = config.dedup
    return dedup.dedup_texts(docs, d.similarity, d.chunk_words, embed, d.algorithm)


def samples(docs: DataFrame, vocabulary_path: str, config: Config) -> DataFrame:
    """(doc_id, sample, input_ids, labels, split) of the cleaned corpus."""
    s = config.samples
    tokens = vocabulary.encode(cleaned(docs, config), vocabulary_path)
    windows = sequences.sample_windows(tokens, s.block, s.stride)
    return sequences.split_rows(windows.withColumn("__key", F.concat_ws(":", "doc_id", "sample")), "__key", s.ratios, s.seed).drop("__key")
