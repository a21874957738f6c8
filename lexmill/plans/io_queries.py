"""Queries of sources, sinks, tokenizer use and streams.

Contents come from the tables and files go to the session's shared folder, so the queries
run on a cluster as they do locally.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import sequences, vocabulary
from lexmill.plans import formats
from lexmill.plans.registry import query
from lexmill.plans.text_queries import strip_sql
from lexmill.sources import files, sinks
from lexmill.session import read_table, shared_dir
from lexmill.streaming import streams


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, every third in Latin-1, and pages as html files."""
    docs = read_table(spark, sf_dir, "documents")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    texts = docs.select(F.concat(F.lit("/in/doc "), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), content.alias("content"))
    pages = read_table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return texts.unionByName(pages).withColumn("length", F.length("content").cast("long"))


@query("SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text FROM documents")
def a2_a20_decode_ladder(spark, sf_dir):
    """Bytes in two encodings give the same text."""
    f = _files(spark, sf_dir).where(F.col("path").endswith(".TXT"))
    return f.select(F.regexp_extract("path", r"doc (\d+)", 1).cast("long").alias("doc_id"), F.sha2(files.decoded(F.col("content")), 256).alias("text"))


@query(f"SELECT 'doc ' || doc_id || '.TXT' AS filename, length(text)::BIGINT AS char_count, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_count FROM documents WHERE length(text) >= 50 AND {strip_sql('text')} <> ''")
def a1_a7_load_documents(spark, sf_dir):
    """The loader without cleaning over text files."""
    return files.load_documents(_files(spark, sf_dir), clean=False).select("filename", "char_count", "line_count")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'unsupported format' WHEN 1 THEN 'empty' WHEN 2 THEN 'unreadable' END AS reason FROM documents WHERE text <> '') GROUP BY 1""")
def c9_valid_files(spark, sf_dir):
    """Every document as a file of one of four kinds, three of them invalid."""
    docs = read_table(spark, sf_dir, "documents").where("text <> ''")
    kind = F.col("doc_id") % 4
    made = docs.select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(kind == 0, ".xyz").otherwise(".Md")).alias("path"),
        F.when(kind == 1, F.lit(b"")).when(kind == 2, F.lit(None).cast("binary")).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    return files.checked(made).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total_files, count(*) AS successful, 0::BIGINT AS failed, 0::BIGINT AS error_types FROM pages")
def a9_a17_ingest_summary(spark, sf_dir):
    """Ingestion of html files, summed up."""
    return files.ingest(_files(spark, sf_dir)).agg(
        F.count("*").alias("total_files"), F.count(F.when(F.col("status") == "processed", 1)).alias("successful"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.count_distinct("error").alias("error_types")
    )


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with every document as a file of its own, the suffix by its id, and a folder below."""
    place = _place(spark, "texts")
    docs = read_table(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".log")
    named = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), suffix).alias("output"), "text", "doc_id")
    sinks.write_texts(named.where("doc_id % 2 = 0"), place)
    sinks.write_texts(named.where("doc_id % 2 = 1"), f"{place}/below")
    return place


def _back(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """The text of every document after it was a file of the format; null where it has none."""
    found = files.extracted(formats.as_files(read_table(spark, sf_dir, "documents"), suffix))
    return found.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), F.sha2("text", 256).alias("text"), "error")


def _formatted(x: str) -> str:
    return f"SELECT doc_id, CASE WHEN {strip_sql('t')} <> '' THEN sha256(t) END AS text, CASE WHEN {strip_sql('t')} <> '' THEN NULL ELSE 'no text content' END AS error FROM (SELECT doc_id, {x} AS t FROM documents)"


_FULL_LINES = f"list_filter(string_split(text, chr(10)), lambda y: {strip_sql('y')} <> '')"
_PAGES = "list_transform(range(0, (len(string_split(text, chr(10))) + 39) // 40), lambda p: string_split(text, chr(10))[p * 40 + 1 : p * 40 + 40])"


@query(_formatted(f"array_to_string({_FULL_LINES}, chr(10) || chr(10))"))
def a4_docx(spark, sf_dir):
    """Documents as office texts, a paragraph a line, read again."""
    return _back(spark, sf_dir, "docx")


@query(_formatted(f"array_to_string(list_filter(list_transform({_PAGES}, lambda p: array_to_string(p, chr(10))), lambda y: {strip_sql('y')} <> ''), chr(10) || chr(10))"))
def a5_pptx(spark, sf_dir):
    """Documents as slides of 40 lines, read again."""
    return _back(spark, sf_dir, "pptx")


@query(_formatted("array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda y: " + strip_sql(r"regexp_replace(y, '\s+', ' ', 'g')") + "), lambda y: y <> ''), chr(10))"))
def a11_epub(spark, sf_dir):
    """Documents as books of one chapter, read again."""
    return _back(spark, sf_dir, "epub")


_PDF_PAGES = f"list_transform({_PAGES}, lambda p: array_to_string(list_filter(p, lambda y: y <> ''), chr(10)))"


@query(_formatted(f"array_to_string(list_filter({_PDF_PAGES}, lambda y: {strip_sql('y')} <> ''), chr(10) || chr(10))"))
def a3_a12_pdf(spark, sf_dir):
    """Documents as PDF files of 40 lines a page, read again."""
    return _back(spark, sf_dir, "pdf")


@query(f"SELECT doc_id, page::INT AS page, sha256(p[page + 1]) AS text FROM (SELECT doc_id, p, unnest([0, 2]) AS page FROM (SELECT doc_id, {_PDF_PAGES} AS p FROM documents)) WHERE page < len(p)")
def a15_pdf_pages(spark, sf_dir):
    """The first and third page of every PDF file that has them."""
    pages = files.pdf_pages(formats.as_files(read_table(spark, sf_dir, "documents"), "pdf"), [0, 2, 9999])
    return pages.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), "page", F.sha2("text", 256).alias("text"))


@query("SELECT doc_id, ((len(string_split(text, chr(10))) + 39) // 40)::INT AS page_count, false AS encrypted, false AS has_images FROM documents")
def a16_pdf_info(spark, sf_dir):
    info = files.pdf_info(formats.as_files(read_table(spark, sf_dir, "documents"), "pdf"))
    return info.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), "page_count", "encrypted", "has_images")


@query(f"SELECT doc_id, sha256(array_to_string({_PDF_PAGES}, chr(10))) AS text FROM documents")
def a13_pdf_texts(spark, sf_dir):
    """Pages of every PDF file joined by line ends; the score is that of b27."""
    texts = files.pdf_texts(formats.as_files(read_table(spark, sf_dir, "documents"), "pdf"))
    return texts.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), F.sha2("text", 256).alias("text"))


_PLACED = "SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t, doc_id % 3 AS kind, doc_id % 2 AS below FROM documents"


@query(f"SELECT 'doc-' || doc_id || CASE kind WHEN 0 THEN '.md' ELSE '.txt' END AS filename, CASE kind WHEN 0 THEN '.md' ELSE '.txt' END AS file_type, sha256(t) AS text FROM ({_PLACED}) WHERE kind < 2 AND length(t) >= 50 AND {strip_sql('t')} <> ''")
def a1_a6_a24_a26_load_folder(spark, sf_dir):
    """The loader over a folder to its bottom; markdown is read as it stands."""
    docs = files.load_inputs(spark, _folder(spark, sf_dir), clean=False)
    return docs.select("filename", "file_type", F.sha2("text", 256).alias("text"))


@query(f"SELECT 'doc-' || doc_id || '.txt' AS filename, sha256(t) AS text FROM ({_PLACED}) WHERE kind = 1 AND below = 0 AND {strip_sql('t')} <> ''")
def a18_text_folder(spark, sf_dir):
    """The text files of a folder itself that aren't blank."""
    found = files.text_folder(spark, _folder(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("filename"), F.sha2("text", 256).alias("text"))


@query("SELECT lower(suffix) AS suffix, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.log' END AS suffix FROM documents WHERE doc_id >= 100) GROUP BY 1 HAVING suffix IN ('.md', '.txt')")
def a7_a17_a19_scans(spark, sf_dir):
    """A recursive scan by suffix and name pattern."""
    found = files.scan(spark, _folder(spark, sf_dir), True, (".txt", ".md", ".html"), r"^doc-\d{3,}\.")
    return found.groupBy(T.extension(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))


@query("SELECT 'doc-' || doc_id || '.txt' AS name, octet_length(encode(text))::BIGINT AS bytes, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text FROM documents")
def l1_l2_named_texts(spark, sf_dir):
    """One file for each document by its name, read again."""
    place = _place(spark, "named")
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("output"), "text")
    written = sinks.write_texts(docs, place)
    back = files.scan(spark, place).select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.sha2(files.decoded(F.col("content")), 256).alias("text"))
    return written.join(back, "name")


@query("""SELECT count(*) AS n, sum(t)::BIGINT AS total FROM (SELECT unnest(tokens[s * 8 + 1 : least(s * 8 + 16, len(tokens) - 1)]) AS t
  FROM (SELECT tokens, unnest(range(0, (len(tokens) - 16) // 8 + 1)) AS s FROM (SELECT list_transform(string_split(text, ''), lambda c: ord(c)::BIGINT) AS tokens FROM conversations WHERE length(text) >= 16)))""")
def j3_saved_samples(spark, sf_dir):
    """Input ids of overlapping samples as one token column, written and read again."""
    place = _place(spark, "samples")
    talk = read_table(spark, sf_dir, "conversations").where("text <> ''")
    tokens = talk.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("long")).alias("tokens"))
    sinks.write_samples(sequences.sample_windows(tokens, 16, 8), place)
    return spark.read.parquet(place).agg(F.count("*").alias("n"), F.sum("token").alias("total"))


@query(r"""SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 3)::BIGINT AS id FROM (SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS token FROM conversations) GROUP BY token HAVING count(*) >= 2)
UNION ALL VALUES ('<pad>', 0), ('<unk>', 1), ('<s>', 2), ('</s>', 3)""")
def k5_saved_vocabulary(spark, sf_dir):
    """A vocabulary written as JSON and read again."""
    place = _place(spark, "vocabulary")
    sinks.write_json(vocabulary.model_rows(vocabulary.vocabulary(read_table(spark, sf_dir, "conversations"))), place)
    return spark.read.schema("token string, id long").json(place)


@query("SELECT doc_id, sha256(text) AS text FROM documents")
def l3_l5_l7_json_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    path = _place(spark, "json")
    sinks.write_json(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.sha2("text", 256).alias("text"))


@query(f"SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {strip_sql('line')} <> ''")
def l1_l3_corpus_round_trip(spark, sf_dir):
    """Texts written as a corpus, read again as line records."""
    path = _place(spark, "corpus")
    sinks.write_corpus(read_table(spark, sf_dir, "documents"), path)
    return files.line_records(spark, path).agg(F.count("*").alias("n"))


def _vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("SELECT doc_id, sha256(text) AS text, length(text) > 0 AS full FROM documents")
def b42_k6_k8_token_round_trip(spark, sf_dir):
    """Texts encoded and decoded again."""
    t = vocabulary.encode(read_table(spark, sf_dir, "documents"), _vocabulary_path())
    return t.select("doc_id", F.sha2(vocabulary.decode(F.col("tokens"), _vocabulary_path()), 256).alias("text"), (F.size("tokens") > 0).alias("full"))


@query("SELECT conv_id, turn, sha256(text) AS text, true AS same, true AS pieces FROM conversations")
def k8_tokenizer_files(spark, sf_dir):
    """One vocabulary as two kinds of files gives the same ids; a third kind finds every word."""
    talk = read_table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    by = {name: vocabulary.encode(talk, _vocabulary_path(name), id_col="id").withColumnRenamed("tokens", name[:5] + name[-4:]) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")}
    out = talk.select("id", "conv_id", "turn", "text")
    for table in by.values():
        out = out.join(table, "id")
    a, b, c = (n[:5] + n[-4:] for n in by)
    back = F.regexp_replace(vocabulary.decode(F.col(c), _vocabulary_path("piece_bpe_32k.model")), r"\s+", "")
    return out.select("conv_id", "turn", F.sha2(vocabulary.decode(F.col(b), _vocabulary_path("byte_bpe_50k.tiktoken")), 256).alias("text"), (F.col(a) == F.col(b)).alias("same"), (back == F.regexp_replace("text", r"\s+", "")).alias("pieces"))


@query()
def f11_f12_k7_k10_token_stats(spark, sf_dir):
    """Characters, tokens, ratio and vocabulary of the corpus, written as a token table and read again."""
    path = _place(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sinks.write_tokens(vocabulary.encode(docs, _vocabulary_path()), path)
    t = spark.read.parquet(path)
    size = docs.agg(F.sum(F.length("text")).alias("chars"))
    used = t.agg(F.sum(F.size("tokens")).alias("tokens"), F.avg(F.size("tokens")).alias("mean"), (F.max(F.array_max("tokens")) + 1).alias("vocab_size"))
    return size.crossJoin(used).withColumn("chars_per_token", F.round(F.col("chars") / F.col("tokens"), 4))  # one row each


@query(f"SELECT count(DISTINCT k) AS n FROM (SELECT {strip_sql(chr(114) + 'egexp_replace(lower(line), ' + repr(chr(92) + 's+').replace(chr(92) * 2, chr(92)) + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE k <> ''")
def o_stream_unique_lines(spark, sf_dir):
    """Line dedup over a stream of files."""
    source = f"{sf_dir}/documents.parquet"
    stream = streams.unique_lines(streams.file_stream(spark, source, spark.read.parquet(source).schema, 8))
    place = _place(spark, "stream")
    return streams.run_once(stream, f"{place}/out", f"{place}/state").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS metric, count(*) AS n, round(avg(value), 6) AS average, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def o_stream_windowed_metrics(spark, sf_dir):
    """Daily metric rollups over a stream."""
    source = f"{sf_dir}/events.parquet"
    events = streams.file_stream(spark, source, spark.read.parquet(source).schema)
    stream = streams.windowed_metrics(events, "ts", F.col("event_type"), F.col("value"), "1 day", "1 hour")
    place = _place(spark, "windows")
    out = streams.run_once(stream, f"{place}/out", f"{place}/state", "complete")
    return out.withColumn("average", F.round("average", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))
