"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K - 1 share one weight vector w over hashed features and
differ in ordered thresholds: P(grade > k) = sigmoid(w.x - theta[k]). The operator's output
is the expected severity, the sum of those probabilities.

Features of a text are the hashed words and the hashed first 4 and 5 bytes of longer words
(lower-cased, punctuation dropped), each present or not. Only features whose document
counts differ between clean and graded texts by a multiple of the standard deviation (``Z``,
which is lower where few labels can't reach it) take part, so that long clean texts don't add
up the small weights of thousands of chance features.

Labels say only toxic or not. Toxic training texts with more indicative features than the
median toxic one are the severe grade, so the thresholds grade what the features measure.

Training uses at most ``train_rows`` labelled documents (a documented bound; chosen by a
hash of the id, so the choice is the same in every run); scoring reads every document.

Defined results: null and empty texts have no features and get the severity of the
intercept alone, which rejects nothing: a rejected text's own features speak for a grade above
0. Rows with equal ids are scored one by one, and the smallest of their feature lists trains;
labels without a document, with null grades, or documents without labels don't train; without
any labelled row, or without a feature that tells grades apart, nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernels as K
from lexmill.session import ship

#: Hashed features.
BITS = 20
#: Most labelled documents that train the model.
TRAIN_ROWS = 12_000
#: Expected severity from which a document is rejected.
REJECT_AT = 0.25
#: Standard deviations by which a feature's count among graded texts must differ from chance: the
#: first of these with which the share COVER of the graded texts holds a feature in their favour.
Z = (6.0, 5.0, 4.0, 3.0)
COVER = 0.9
#: Training documents that must hold a feature.
LEAST_DOCS = 3

#: Letters and digits of any script; ASCII punctuation and white space end a word.
_WORDISH = np.ones(256, bool)
_WORDISH[:0x30] = _WORDISH[0x3A:0x41] = _WORDISH[0x5B:0x61] = _WORDISH[0x7B:0x80] = False


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of every row (those marked in ``only``), and their n + 1 offsets."""
    s, e, wo = K.words(data, offsets, _WORDISH)
    row = K.row_of(wo)
    parts, rows = [K.span_hashes(data, s, e, K.LOWER)], [row]
    for n in (4, 5):
        long = np.flatnonzero(e - s > n)
        parts.append(K.mix(K.span_hashes(data, s[long], s[long] + n, K.LOWER) + np.uint64(n)))
        rows.append(row[long])
    f = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    row = np.concatenate(rows).astype(np.int64)
    if only is not None:
        hit = np.flatnonzero(only[f])
        row, f = row[hit], f[hit]
    key = np.unique((row << bits) | f)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(offsets)))


@dataclass
class OrdinalModel:
    """Shared weights, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def raw(self, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return K.row_sums(self.weights[feature].astype(np.float64), offsets)

    def severity(self, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Expected grade of each row."""
        return _sigmoid(self.raw(feature, offsets)[:, None] - self.thresholds[None, :]).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def lifts(feature: np.ndarray, row: np.ndarray, grade: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Standard deviations by which each feature is more frequent in graded texts than by chance."""
    graded = float((grade > 0).mean())
    seen = np.bincount(feature, minlength=1 << bits)
    hits = np.bincount(feature[grade[row] > 0], minlength=1 << bits)
    z = (hits - seen * graded) / np.sqrt(np.maximum(seen * graded * (1 - graded), 1e-9))
    return np.where(seen >= LEAST_DOCS, z, 0)


def strictest(lift: np.ndarray, feature: np.ndarray, row: np.ndarray, grade: np.ndarray) -> float:
    """The first of ``Z`` that leaves COVER of the graded texts a feature in their favour, else the last."""
    best = np.zeros(len(grade))
    np.maximum.at(best, row, lift[feature])
    best = best[grade > 0]
    return next((z for z in Z if (best >= z).mean() >= COVER), Z[-1])


def refine(grade: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades 0 < 1 < 2 from 0/1 labels: toxic texts with more than the usual number of
    indicative features are the severe ones."""
    usual = np.median(hits[grade == 1])
    severe = (grade == 1) & (hits > usual)
    return grade + severe if severe.any() and not severe[grade == 1].all() else grade


def fit(feature: np.ndarray, offsets: np.ndarray, grade: np.ndarray, bits: int = BITS, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by Adam on the whole (bounded) sample; the same in every run.

    Thresholds are theta[0] and positive steps above it, so they stay ordered.
    """
    classes = int(grade.max()) + 1 if len(grade) else 1
    if classes < 2:
        return OrdinalModel(np.zeros(1 << bits), np.full(max(classes - 1, 1), 35.0))
    row = K.row_of(offsets)
    lift = lifts(feature, row, grade, bits)
    taken = (np.abs(lift) >= strictest(lift, feature, row, grade))[feature]
    feature, row = feature[taken], row[taken]
    if classes == 2:
        grade = refine(grade, np.bincount(row, lift[feature] > 0, len(grade)))
        classes = int(grade.max()) + 1
    above = grade[:, None] > np.arange(classes - 1)[None, :]
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    w = np.zeros(1 << bits)
    t = np.concatenate([start[:1], np.log(np.expm1(np.maximum(np.diff(start), 1e-2)))])
    used = np.unique(feature)
    place = np.searchsorted(used, feature)
    x = np.concatenate([np.zeros(len(used)), t])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        wu, t = x[: len(used)], x[len(used) :]
        theta = np.cumsum(np.concatenate([t[:1], np.logaddexp(0, t[1:])]))
        z = np.bincount(row, wu[place], len(grade))
        # P(grade = g) = F(g-1) - F(g) with F(k) = P(grade > k)
        f = np.column_stack([np.ones(len(z)), _sigmoid(z[:, None] - theta[None, :]), np.zeros(len(z))])
        at = np.arange(len(z))
        hi, lo = f[at, grade], f[at, grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        gz = -(d_hi - d_lo) / p / len(z)
        gt = np.zeros(classes - 1)
        for k in range(classes - 1):
            gt[k] = (np.where(grade == k + 1, d_hi / p, 0) - np.where(grade == k, d_lo / p, 0)).sum() / len(z)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(place, gz[row], len(used)) + ridge * wu, [tail[0]], tail[1:] * _sigmoid(t[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w[used] = x[: len(used)]
    t = x[len(used) :]
    return OrdinalModel(w, np.cumsum(np.concatenate([t[:1], np.logaddexp(0, t[1:])])))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> OrdinalModel:
    """Fit on at most ``train_rows`` rows of ``labels`` (doc_id, grade) that have a document.

    The chosen ids are bounded, so they are broadcast to the scan of the documents; only
    one list of feature numbers for each of those ids comes to the driver.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.max("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            for a, b, d, o in K.slices(data, offsets):
                f, fo = features(d, o, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(fo, pa.int32()), pa.array(f, pa.int32()))], ["doc_id", "grade", "f"])

    joined = docs.select(F.col("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    kind = joined.schema["doc_id"].dataType.simpleString()
    rows = joined.mapInArrow(run, f"doc_id {kind}, grade int, f array<int>").groupBy("doc_id", "grade").agg(F.min("f").alias("f")).toArrow()
    ids = np.array(rows.column("doc_id").to_pylist(), dtype=object) if not pa.types.is_integer(rows.schema.field("doc_id").type) else rows.column("doc_id").to_numpy()
    lists = rows.column("f").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    flat = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)
    order = np.lexsort((size, ids)) if len(ids) else np.zeros(0, np.int64)  # the same order in every run
    size, grade = size[order], rows.column("grade").to_numpy()[order]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(first[order] - offsets[:-1], size) + np.arange(offsets[-1])
    return fit(flat[at].astype(np.int64), offsets, grade.astype(np.int64), bits)


def grades(labels: DataFrame) -> DataFrame:
    """Grades 0 and 1 from the 0/1 labels; ``fit`` tells the severe ones apart."""
    return labels.select("doc_id", F.when(F.col("toxic").cast("int") == 1, 1).when(F.col("toxic").cast("int") == 0, 0).alias("grade"))


def score(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT, bits: int = BITS, keep: bool = False) -> DataFrame:
    """Per row: doc_id, ``severity`` (expected grade) and ``rejected``.

    ``keep=True`` returns the unrejected rows of ``docs`` with their own columns instead.
    One pass, no shuffle; the model is as large as 2**bits, whatever the corpus.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    text_at = docs.columns.index("text") if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = OrdinalModel(*shared.value)
        only = use.weights != 0
        for batch in batches:
            data, offsets = K.buffers(batch.column(text_at).cast(pa.string()))
            severity, bad = np.zeros(len(batch)), np.zeros(len(batch), bool)
            for a, b, d, o in K.slices(data, offsets):
                found = features(d, o, bits, only)
                severity[a:b] = use.severity(*found)
                bad[a:b] = (severity[a:b] >= reject_at) & (use.raw(*found) > 0)
            if keep:
                yield batch.filter(pa.array(~bad))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(severity, 6)), pa.array(bad)], ["doc_id", "severity", "rejected"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, severity double, rejected boolean")


def toxicity(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, keep: bool = False, train_rows: int = TRAIN_ROWS, reject_at: float = REJECT_AT) -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) over ``train_on`` and score ``docs``."""
    model = train(docs if train_on is None else train_on, grades(labels), train_rows)
    return score(docs, model, reject_at, keep=keep)
