"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the corpus.

Two multinomials over 2**BITS hashed word uni- and bigrams are counted, one from trusted
documents and one from all documents. A document's score is the sum of
log p_target - log p_raw over its n-grams, divided by their number, and every document
scoring below a fixed threshold is dropped, in every run alike. The target is shrunk
towards the raw distribution with ``PRIOR`` of the corpus's n-grams as pseudo-counts, so n-grams
without evidence score near zero and the shrinkage is the same at every size.

Beside it stand the base rules: word and character counts, symbols, repeated lines and
repeated 3-word windows.

Every trusted row counts in the target and every document in the raw counts.

Defined results: null and empty texts have no words, fail the base rules and are dropped;
rows with equal ids are judged one by one; without trusted rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernels as K
from lexmill.session import ship

#: Hash buckets of the n-grams.
BITS = 22
#: Buckets whose counts are packed and merged at once.
BLOCK = 1 << 16
#: Most trusted ids that are broadcast (about 60 MB in each executor); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pseudo-counts of the target as a share of the n-grams of the corpus.
PRIOR = 0.5
#: Mean log-likelihood ratio below which a document is dropped.
THRESHOLD = -0.12
#: Base rules: fewest words, and percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False  # continuation bytes


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every hashed uni- and bigram (A-Z lower-cased), n-grams per row."""
    s, e, wo = K.words(data, offsets)
    w = K.span_hashes(data, s, e, K.LOWER)
    row = K.row_of(wo)
    pair = np.flatnonzero(row[1:] == row[:-1])
    bucket = np.concatenate([w, K.gram_hashes(w, 2)[pair]]) >> np.uint64(64 - bits)
    size = np.diff(wo)
    return bucket.astype(np.int64), np.concatenate([row, row[pair]]), size + np.maximum(size - 1, 0)


def rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every row."""
    s, e, wo = K.words(data, offsets)
    row = K.row_of(wo)
    n = len(data)

    def per_row(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[offsets[1:]] - c[offsets[:-1]]

    covered = np.zeros(len(s), bool)
    if len(s) >= 3:
        inside = np.flatnonzero(row[2:] == row[:-2])
        again = _repeats(K.gram_hashes(K.span_hashes(data, s, e), 3)[inside], row[inside])[0]
        for j in range(3):
            covered[inside[again] + j] = True
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < n]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, starts)], offsets[line_row + 1])
    with_word = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends, line_row = starts[with_word], ends[with_word], line_row[with_word]
    later = _repeats(K.span_hashes(data, starts, ends), line_row)[1]
    return {
        "n_words": np.diff(wo),
        "word_chars": per_row(K.WORD_BYTE[data] & _POINT[data]),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[later], minlength=len(offsets) - 1),
        "n_repeat_words": K.row_sums(covered.astype(np.int64), wo),
    }


def _repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of items found twice or more in their row, and of those with an earlier equal."""
    key = K.mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def _pack(x: np.ndarray) -> bytes:
    """Counts as compressed byte planes; most of their bytes are zero."""
    return pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def train(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> np.ndarray:
    """Log-likelihood ratio of every bucket: target ``trusted`` (doc_id) against all ``docs``.

    Every task adds up its own rows and writes its sums in packed blocks of buckets; the blocks
    of all tasks are added up by key, and 2**bits pairs of numbers come to the driver. The
    trusted ids grow with the corpus: they are counted, up to ``BROADCAST_IDS`` of them go to
    every task, and beyond that texts and ids are dealt by id.
    """
    ship(docs.sparkSession)
    block = min(BLOCK, 1 << bits)
    chosen = trusted.where("doc_id is not null").select("doc_id").distinct().withColumn("mark", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            mark = np.asarray(batch.column(1).to_pylist(), bool)
            data, offsets = K.buffers(batch.column(0))
            for a, b, d, o in K.slices(data, offsets):
                bucket, row, _ = ngrams(d, o, bits)
                np.add.at(raw, bucket, 1)
                np.add.at(target, bucket[mark[a:b][row]], 1)
        parts = [(i, raw[i : i + block], target[i : i + block]) for i in range(0, 1 << bits, block)]
        parts = [x for x in parts if x[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), *(pa.array([_pack(x[k]) for x in parts], pa.binary()) for k in (1, 2))], ["at", "raw", "target"])

    def merge(rows: pa.Table) -> pa.Table:
        total = [pa.array([sum(_unpack(x, block) for x in rows.column(k).to_pylist()).tobytes()], pa.binary()) for k in ("raw", "target")]
        return pa.Table.from_arrays([rows.column("at").slice(0, 1), *total], ["at", "raw", "target"])

    ids = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen.hint("shuffle_hash")
    marked = docs.select("doc_id", F.col("text").cast("string")).join(ids, "doc_id", "left").select("text", F.coalesce("mark", F.lit(False)).alias("mark"))
    kind = "at int, raw binary, target binary"
    rows = marked.mapInArrow(run, kind).groupBy("at").applyInArrow(merge, kind).toArrow().to_pylist()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in rows:
        raw[r["at"] : r["at"] + block] = np.frombuffer(r["raw"], np.int64)
        target[r["at"] : r["at"] + block] = np.frombuffer(r["target"], np.int64)
    return ratio(raw, target)


def ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket; the target is shrunk towards the raw."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    p = (raw + 1) / (raw.sum() + len(raw))
    prior = PRIOR * raw.sum()
    t = (target + prior * p) / (target.sum() + prior)
    return np.log(t) - np.log(p)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, the base counts, ``score``, ``base_failed`` and ``kept``."""
    ship(docs.sparkSession)
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b, d, o in K.slices(data, offsets):
                found = rules(d, o)
                bucket, row, size = ngrams(d, o, bits)
                mean = np.round(np.bincount(row, shared.value[bucket], b - a) / np.maximum(size, 1), 9)
                failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                columns = [batch.column(0).slice(a, b - a), *(pa.array(found[c].astype(np.int64)) for c in names), pa.array(mean), pa.array(failed), pa.array(~failed & (mean >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "score", "base_failed", "kept"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in names)}, score double, base_failed boolean, kept boolean")


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``trusted`` (doc_id) against all ``docs`` and judge every row of ``docs``."""
    return score(docs, train(docs, trusted), threshold)
