"""Exact and similarity dedup. First occurrence in (id, position) order always stays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import unicode as U
from lexmill.session import materialise, ship


def _size(name: str) -> Column:
    """Elements of an array column; null has none."""
    return F.when(F.col(name).isNull(), 0).otherwise(F.size(name)).cast("long")


def keyed_lines(docs: DataFrame, key=None, algorithm: str = "sha256", columns: tuple[str, ...] = ("doc_id", "pos", "line")) -> DataFrame:
    """``columns`` and h of every line; h is null for blank lines, which never repeat.

    ``key`` makes a line's key; the default folds case, white space, compatible characters and
    entities, and sends only texts to Python that hold any of the latter two.
    """
    own = [c for c in columns if c not in ("pos", "line")]
    text = F.col("text")
    both = docs.select(*own, T.lines(text).alias("__raw"), T.lines(U.compatible_lines(text) if key is None else text).alias("__ready"))
    # outer: keeps the optimizer from adding a filter on the exploded expression, with the Python function in it
    each = both.select(*own, "__raw", F.posexplode_outer("__ready").alias("pos", "__line")).where("pos is not null")
    k = T.fold_line(F.col("__line")) if key is None else key(F.col("__line"))
    line = F.get("__raw", F.col("pos")).alias("line")
    return each.select(*(line if c == "line" else c for c in columns), k.alias("k")).select(*columns, F.when(F.col("k") != "", T.line_hash(F.col("k"), algorithm)).alias("h"))


def first_places(lined: DataFrame) -> DataFrame:
    """(doc_id, pos) of every line that stays: the first of each hash, and all blank ones.

    The minimum is combined before the shuffle, so a line that everyone has moves once per task.
    """
    place = F.when(F.col("h").isNull(), F.struct("doc_id", "pos"))
    return lined.select(F.unhex("h").alias("h"), place.alias("blank"), "doc_id", "pos").groupBy("h", "blank").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("f.*")


def dedup_corpus_lines(docs: DataFrame, key=None, algorithm: str = "sha256") -> DataFrame:
    """(doc_id, text, n_lines, n_kept): texts without lines seen anywhere before; blanks stay.

    Hashes and places of lines are shuffled, not the lines; what stays is put together from the
    texts.
    """
    kept = first_places(keyed_lines(docs, key, algorithm, columns=("doc_id", "pos"))).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    split = docs.select("doc_id", T.lines(F.col("text")).alias("lines"))
    text = F.array_join(F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda i: F.get("lines", i)), "\n")
    return split.join(kept, "doc_id", "left").select("doc_id", text.alias("text"), _size("lines").alias("n_lines"), _size("kept").alias("n_kept"))


def line_dedup_stats(docs: DataFrame, by: str, key=None) -> DataFrame:
    """Per group ``by``: lines, kept, removed and distinct ones of corpus-wide dedup.

    One pass over the lines: counts per hash and group first, so what is shuffled to a hash
    is a row per group, however often the line is found.
    """
    lined = keyed_lines(docs, key, columns=(by, "doc_id", "pos"))
    per = lined.select(by, "doc_id", "pos", F.unhex("h").alias("h")).groupBy("h", by).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("f"))
    hashes = per.groupBy("h").agg(F.min(F.struct("f", by)).alias("first"), F.collect_list(F.struct(by, "n")).alias("all"))
    groups = hashes.select("h", F.col("first")[by].alias("owner"), F.explode("all").alias("g")).select("h", F.col("g")[by].alias(by), F.col("g.n").alias("n"), F.col("g")[by].eqNullSafe(F.col("owner")).cast("long").alias("own"))
    kept = F.when(F.col("h").isNull(), F.col("n")).otherwise(F.col("own"))
    return groups.groupBy(by).agg(
        F.sum("n").alias("n_lines"), F.sum(kept).alias("n_kept"), F.sum(F.col("n") - kept).alias("n_removed"), F.sum(F.when(F.col("h").isNull(), 0).otherwise(F.col("own"))).alias("n_distinct")
    )


def dedup_own_lines(docs: DataFrame, key=None) -> DataFrame:
    """(doc_id, text, n_removed): the same within each document; places are shuffled by document and hash."""
    lined = keyed_lines(docs, key, columns=("doc_id", "pos"))
    place = F.when(F.col("h").isNull(), F.col("pos"))
    firsts = lined.groupBy("doc_id", "h", place.alias("blank")).agg(F.min("pos").alias("pos"))
    kept = firsts.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    split = docs.select("doc_id", T.lines(F.col("text")).alias("lines"))
    joined = split.join(kept, "doc_id", "left")
    text = F.array_join(F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda i: F.get("lines", i)), "\n")
    return joined.select("doc_id", text.alias("text"), (_size("lines") - _size("kept")).alias("n_removed"))


def line_hash_set(docs: DataFrame, key=None) -> DataFrame:
    """(doc_id, h): distinct hashes of each document's lines."""
    return keyed_lines(docs, key, columns=("doc_id",)).where("h is not null").distinct()


def dedup_records(records: DataFrame, id_col: str, text_col: str, key=U.line_key) -> DataFrame:
    """Whole records, first of each key by id; empty keys count as a key.

    Keys are made once; records are found again by their id and a hash of their text.
    """
    mark = F.xxhash64(F.col(text_col))
    first = records.select(F.unhex(T.line_hash(key(F.col(text_col)))).alias("h"), F.struct(F.col(id_col).alias("i"), mark.alias("m")).alias("r")).groupBy("h").agg(F.min("r").alias("r"))
    chosen = first.select(F.col("r.i").alias("__i"), F.col("r.m").alias("__m"))
    return records.join(chosen, F.col(id_col).eqNullSafe(F.col("__i")) & (mark == F.col("__m")), "left_semi")


def unseen(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Incremental dedup: rows whose hash is not in the persisted table ``seen`` (h)."""
    return lines.join(seen.select("h").distinct(), "h", "left_anti")


# -- similarity ---------------------------------------------------------------------------

#: Vectors in a block; two blocks are multiplied at once.
BLOCK = 1024


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(i, j, sim) with i < j and cosine >= threshold: exact, by multiplying blocks.

    Work and shuffle grow with the square of the number of vectors; ``near_pairs`` scales.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return _pairs_in_groups(rows.select(F.lit(0).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), threshold, block)


def near_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", bands: int = 24, bits: int = 12, block: int = BLOCK) -> DataFrame:
    """(i, j, sim): as ``similar_pairs``, among the vectors that share a bucket of random hyperplanes.

    Pairs are confirmed by their exact cosine, so none is wrong; of the pairs at the threshold
    0.85 a share of 0.91 is found with the defaults, of those at 0.9 over 0.98. A pair is reported
    once, in its first common bucket. Lower thresholds need fewer bits or more bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(7).normal(size=(m.shape[1], bands * bits))
            side = (m @ planes > 0).reshape(len(m), bands, bits)
            keys = (side * (1 << np.arange(bits))).sum(2).astype(np.int16 if short else np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "v", "keys"])

    ship(vectors.sparkSession)
    short = bits < 16
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    coded = materialise(rows.mapInArrow(run, f"id long, v {kind}, keys array<{'short' if short else 'int'}>"), "codes")
    bucket = lambda band, key: F.shiftleft(band.cast("long"), bits) + key
    narrow = coded.select(F.posexplode("keys").alias("band", "key")).select(bucket(F.col("band"), F.col("key")).alias("g"))
    crowded = materialise(narrow.groupBy("g").agg(F.count("*").alias("__n")).where(F.col("__n") > block).select("g"), "crowded")
    each = coded.select("id", "v", "keys", F.posexplode("keys").alias("band", "key")).select(bucket(F.col("band"), F.col("key")).alias("g"), "id", "v", "keys")
    # a bucket of one block, as nearly all are, meets itself where it is gathered; of the others there
    # is at most one for each ``block`` rows, so their numbers are broadcast
    packed = each.join(F.broadcast(crowded), "g", "left_anti").groupBy("g").agg(F.collect_list(F.struct("id", "v", "keys")).alias("rows"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in enumerate(batch.column(0).to_pylist()):
                here = _matrix(batch.column(1)[at].values)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _block_pairs(here, here, True, threshold, group >> bits)], ["i", "j", "sim"])

    out = packed.where(F.size("rows") > 1).mapInArrow(alone, "i long, j long, sim double")
    if crowded.isEmpty():
        return out
    return out.unionByName(_pairs_in_groups(each.join(F.broadcast(crowded), "g", "left_semi"), threshold, block, bits=bits))


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, vectors of length 1 and, if there are any, keys of the rows of a block."""
    lists = lambda name: rows.field(name).flatten().to_numpy().reshape(len(rows), -1)
    m = lists("v").astype(np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    keyed = rows.type.get_field_index("keys") >= 0
    return rows.field("id").to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), lists("keys") if keyed else None


def _block_pairs(here: tuple, other: tuple, same_block: bool, threshold: float, band: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sim) of two blocks; with keys, of the pairs whose first common key is that of ``band``."""
    (x, mx, kx), (y, my, ky) = here, other
    sim = mx @ my.T
    i, j = np.nonzero(sim >= threshold)
    keep = x[i] < y[j] if same_block else x[i] != y[j]
    i, j = i[keep], j[keep]
    if kx is not None and len(i):
        first = (kx[i] == ky[j]).argmax(1) == band
        i, j = i[first], j[first]
    return np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), sim[i, j]


def _pairs_in_groups(rows: DataFrame, threshold: float, block: int, named: bool = False, bits: int = 0) -> DataFrame:
    """Similar pairs of rows (g, id, v) with the same g; with ``keys`` (of ``bits`` each, g is
    the band and one of them), a pair counts in its first common group alone; ``named`` adds g to the pairs.

    Rows of a group are dealt to blocks by a hash of the id; every pair of blocks meets through an
    equi-join on the second block's number, as one row with two matrices, so no row of two
    single vectors is ever made.
    """
    ship(rows.sparkSession)
    keyed = "keys" in rows.columns
    sizes = rows.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).alias("n"))
    own = F.struct("id", "v", "keys") if keyed else F.struct("id", "v")
    packed = rows.join(sizes, "g").select("g", "n", F.pmod(F.xxhash64("id"), "n").alias("b"), own.alias("r")).groupBy("g", "n", "b").agg(F.collect_list("r").alias("rows"))
    packed = materialise(packed, "blocks")
    left = packed.select("g", "rows", F.explode(F.sequence(F.col("b"), F.col("n") - 1)).alias("o"), F.col("b").alias("a"))
    both = left.join(packed.select("g", F.col("b").alias("o"), F.col("rows").alias("others")), ["g", "o"]).select("g", "a", "o", "rows", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, here, other = batch.column(0), batch.column(3), batch.column(4)
            for at, (a, o) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                band = group[at].as_py() >> bits if keyed else None
                found = [pa.array(x) for x in _block_pairs(_matrix(here[at].values), _matrix(other[at].values), a == o, threshold, band)]
                yield pa.RecordBatch.from_arrays([*([pa.array([group[at].as_py()] * len(found[0]), group.type)] if named else []), *found], [*(["g"] if named else []), "i", "j", "sim"])

    kind = f"g {rows.schema['g'].dataType.simpleString()}, " if named else ""
    return both.mapInArrow(run, f"{kind}i long, j long, sim double")


def drop_similar(vectors: DataFrame, pairs: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows that are no pair's second end (also if the first end goes itself)."""
    return vectors.join(pairs.select(F.col("j").alias(id_col)).distinct(), id_col, "left_anti")


def hashed_vectors(texts: list[str], width: int = 256) -> np.ndarray:
    """Word counts by hash, one row for each text: an embedding that needs no model."""
    out = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in t.split():
            out[i, zlib.crc32(w.encode()) % width] += 1
    return out


def embed_chunks(docs: DataFrame, embed=hashed_vectors, chunk_words: int = 512, key=U.line_key) -> DataFrame:
    """(doc_id, chunk, embedding) of every chunk whose normalized text isn't empty.

    ``embed`` maps a list of texts to a matrix; chunks keep their numbers, so leaving empty ones
    out shifts nothing.
    """
    ship(docs.sparkSession)
    chunks = docs.select("doc_id", F.posexplode(T.word_chunks(F.col("text"), chunk_words)).alias("chunk", "piece"))
    folded = chunks.select("doc_id", "chunk", key(F.col("piece")).alias("k")).where("k <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "chunk": b["chunk"], "embedding": list(np.asarray(embed(b["k"].tolist()), np.float64))})

    return folded.mapInPandas(run, f"doc_id {kind}, chunk int, embedding array<double>")


def dedup_texts(docs: DataFrame, threshold: float = 0.85, chunk_words: int = 512, embed=hashed_vectors, algorithm: str = "sha256") -> DataFrame:
    """Exact line dedup, then similar chunks within each text, with the counts of both (``dedup_chunks``)."""
    lined = materialise(dedup_corpus_lines(docs, algorithm=algorithm), "lines")
    return _without_similar(lined, embed_chunks(lined, embed, chunk_words), threshold, chunk_words)


def dedup_chunks(docs: DataFrame, vectors: DataFrame, threshold: float, key=None, chunk_words: int = 512) -> DataFrame:
    """(doc_id, text, n_lines, n_kept, n_chunks, n_similar): exact line dedup, then similar chunks.

    ``vectors`` (doc_id, chunk, embedding) are the embeddings of each document's chunks after
    the line dedup. Chunks are compared within their document; a text of several chunks comes
    back with its remaining chunks joined by blanks, as one line.
    """
    return _without_similar(dedup_corpus_lines(docs, key), vectors, threshold, chunk_words)


def _without_similar(lined: DataFrame, vectors: DataFrame, threshold: float, chunk_words: int) -> DataFrame:
    """The rows of ``dedup_corpus_lines`` without chunks that are like an earlier one of their text."""
    chunks = lined.select("doc_id", F.posexplode(T.word_chunks(F.col("text"), chunk_words)).alias("chunk", "piece"))
    own = vectors.where("doc_id is not null and embedding is not null").select(F.col("doc_id").alias("g"), F.col("chunk").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    gone = _pairs_in_groups(own, threshold, BLOCK, named=True).select(F.col("g").alias("doc_id"), F.col("j").cast("int").alias("chunk")).distinct().withColumn("gone", F.lit(True))
    marked = chunks.join(gone, ["doc_id", "chunk"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("chunk", "piece"))))
    joined = marked.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("gone").alias("n_similar"), F.array_join(F.transform(kept, lambda s: s.piece), " ").alias("joined"))
    several = F.col("n_chunks") > 1
    out = lined.join(joined, "doc_id", "left")
    return out.select(
        "doc_id", F.when(several, F.col("joined")).otherwise(F.col("text")).alias("text"), "n_lines", "n_kept",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(several, F.col("n_similar")).otherwise(0).alias("n_similar"),
    )
