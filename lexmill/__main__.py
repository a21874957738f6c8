"""Command line: ``python -m lexmill COMMAND ...``; every command reads and writes folders."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill import config, logs
from lexmill.operators import cleaning, corpus, dedup, reports, vocabulary
from lexmill.sources import files, sinks


def _load(spark: SparkSession, a: argparse.Namespace, c: config.Config) -> None:
    docs = files.load_inputs(spark, a.input, clean=not a.raw, min_length=a.min_length)
    sinks.write_corpus(docs, a.output)


def _ingest(spark: SparkSession, a: argparse.Namespace, c: config.Config) -> None:
    found = files.ingest(files.scan(spark, a.input)).cache()
    sinks.write_texts(found.where("error is null"), a.output)
    reports.processing_summary(found, F.col("error"), F.col("length")).show(truncate=False)
    reports.first_errors(found, "error", "path").select("path", "error").show(truncate=False)


def _clean(spark: SparkSession, a: argparse.Namespace, c: config.Config) -> None:
    docs = files.text_folder(spark, a.input).withColumn("output", F.regexp_extract("path", r"([^/]*)\z", 1))
    out = cleaning.clean_batch(docs, urls=c.cleaning.urls, emails=c.cleaning.emails, phones=c.cleaning.phones, min_line=c.cleaning.min_line, max_line=c.cleaning.max_line, dedup=c.cleaning.dedup).cache()
    sinks.write_texts(out, a.output, text_col="cleaned")
    cleaning.cleaning_summary(out).show(truncate=False)


def _dedup(spark: SparkSession, a: argparse.Namespace, c: config.Config) -> None:
    docs = files.text_folder(spark, a.input).withColumnRenamed("path", "doc_id")
    out = corpus.deduplicated(docs, c) if a.semantic else dedup.dedup_corpus_lines(docs, algorithm=c.dedup.algorithm)
    sinks.write_texts(out.withColumn("output", F.regexp_extract("doc_id", r"([^/]*)\z", 1)), a.output)


def _encode(spark: SparkSession, a: argparse.Namespace, c: config.Config) -> None:
    docs = files.text_folder(spark, a.input).withColumnRenamed("path", "doc_id")
    sinks.write_tokens(vocabulary.encode(docs, a.vocabulary), a.output)


def _samples(spark: SparkSession, a: argparse.Namespace, c: config.Config) -> None:
    docs = files.text_folder(spark, a.input).withColumnRenamed("path", "doc_id")
    sinks.write_tokens(corpus.samples(docs, a.vocabulary, c), a.output)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    out.add_argument("--config", help="JSON or YAML file")
    out.add_argument("--preset", default="default", choices=sorted(config.PRESETS))
    out.add_argument("--log", help="file for JSON log lines")
    commands = out.add_subparsers(dest="command", required=True)
    for name, run, about in (
        ("load", _load, "documents to one corpus"), ("ingest", _ingest, "every supported file to a text file"), ("clean", _clean, "texts to cleaned texts"),
        ("dedup", _dedup, "texts without repeated lines"), ("encode", _encode, "texts to token ids"), ("samples", _samples, "texts to training samples"),
    ):
        c = commands.add_parser(name, help=about)
        c.add_argument("input")
        c.add_argument("output")
        c.set_defaults(run=run)
        if name == "load":
            c.add_argument("--raw", action="store_true", help="without cleaning")
            c.add_argument("--min-length", type=int, default=50)
        if name == "dedup":
            c.add_argument("--semantic", action="store_true", help="similar chunks too")
        if name in ("encode", "samples"):
            c.add_argument("--vocabulary", required=True, help="tokenizer file")
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    log = logs.log_to(a.log)
    settings = config.load(a.config, a.preset) if a.config else config.build(preset=a.preset)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    log.info("started", extra={"command": a.command, "input": a.input, "output": a.output})
    try:
        a.run(spark, a, settings)
    except Exception:
        log.exception("failed", extra={"command": a.command})
        return 1
    log.info("done", extra={"command": a.command})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
