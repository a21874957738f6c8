"""Suffix-array dedup with longest-previous-factor arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier (in a
document with a smaller id, or earlier in the same one); so the first copy of everything
stays. Per position that asks for the longest previous factor (LPF): the longest match with
an earlier start. In suffix order the best earlier match is either the previous or the next
entry with a smaller position, so LPF follows from those two neighbours and the common
prefixes in between.

A suffix array over the whole corpus fits no machine, so positions are first sent to where
their earlier matches must be:

1. Anchors. Of the 32-byte strings in each window of ``LENGTH`` bytes, the one with the
   smallest hash is its anchor. Equal windows have equal anchors at equal places. Positions
   with a common anchor in a row form a piece (about 35 starts).
2. A task collapses equal pieces of its own documents: all but the first are repeats for
   certain. The rest travel as (anchor, fingerprint, id, place), packed per bucket of
   anchors, without their bytes. In a bucket, equal pieces collapse again, and an anchor
   with a single piece left is done: its windows occur nowhere else.
3. Pieces that share an anchor and differ (the borders of copies) fetch their bytes and meet
   by anchor. Their suffixes, to the pieces' ends, are put in order with their common prefixes,
   and LPF tells which starts repeat.

An anchor with many different pieces (a phrase in a third of all documents) doesn't meet in
one task: its pieces go by their fingerprints and its windows by the hash of their whole
``LENGTH`` bytes instead, and equal ones collapse before they travel.

Equal pieces are known by their 64-bit anchor hash, their 64-bit fingerprint and their size; no
byte of them is compared. Of n pieces, two different ones look equal with a chance of about
n * n / 2**129, below 1 in 10**12 for 10**13 pieces. Everything else is compared byte by byte.

Defined results: null and empty texts and texts shorter than ``LENGTH`` bytes lose nothing;
rows with a null id are returned as they are and are no source of repeats; rows with equal
ids and texts count as one document and get its result each; bytes are UTF-8; ids must be
integers, others raise a TypeError.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexmill.llm import kernels as K
from lexmill.session import ship

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of an anchor.
ANCHOR = 32
#: Different pieces of one anchor, in one task's documents, from which it is crowded.
CROWDED_HERE = 48
#: Different pieces of one anchor in a bucket from which it is crowded.
CROWDED = 2000
#: Bytes that are hashed at once; fewer than 2**20, the places that fit beside a hash.
CHUNK = 1 << 19
#: Bytes of text whose pieces share a bucket, and the most buckets (plans may overstate their size).
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 20
#: Pieces that a task gathers before it sends them.
GATHER = 3_000_000

_SPAN = LENGTH - ANCHOR  # a window's anchor starts at most this far behind the window


# ---------------------------------------------------------------- suffix arrays and LPF


def suffix_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``text[starts[i]:ends[i]]`` in order (equal ones as given), and the common
    prefix of each with the one before it in that order.

    Suffixes are those of short pieces, so they are compared to their ends at once.
    """
    m = len(starts)
    size = ends - starts
    width = int(size.max()) if m else 0
    if not width:
        return np.arange(m), np.zeros(m, np.int64)
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    # bytes of UTF-8 are below 255, so one more leaves zero for the ends
    rows = np.where(np.arange(width) < size[:, None], rows + np.uint8(1), np.uint8(0))
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, size = rows[order], size[order]
    lcp = np.zeros(m, np.int64)
    differ = rows[1:] != rows[:-1]
    at = differ.argmax(1)
    lcp[1:] = np.where(differ[np.arange(m - 1), at], at, size[1:])
    return order, lcp


def longest_previous_factor(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF by place in suffix order, from positions in suffix order and common prefixes.

    A stack holds the entries whose next smaller position hasn't come yet; each entry is
    pushed and popped once.
    """
    n = len(position)
    best = [0] * n
    pos, common = position.tolist(), [*lcp.tolist(), 0]
    pos.append(-1)
    stack: list[list[int]] = []  # [place in order, common prefix with the entry below]
    for i in range(n + 1):
        run = common[i] if i < n else 0
        while stack and pos[i] < pos[stack[-1][0]]:
            top, below = stack.pop()
            # next smaller position is i, at common prefix run; previous smaller is the entry below
            if run > best[top]:
                best[top] = run
            run = min(run, below)
        if i < n:
            if stack and pos[i] == pos[stack[-1][0]]:  # the same place twice is no earlier one
                below = min(run, stack[-1][1])
            else:
                below = run if stack else 0
            best[i] = max(best[i], below)
            stack.append([i, below])
    return np.asarray(best, np.int64)


def previous_factors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, position: np.ndarray) -> np.ndarray:
    """LPF of every suffix, where it is ``LENGTH`` or more; 0 elsewhere.

    Neighbours with shorter common prefixes part the order into runs, and no longer match
    crosses from one run to another, so LPF is taken in the runs alone.
    """
    out = np.zeros(len(starts), np.int64)
    order, lcp = suffix_order(text, starts, ends)
    long = lcp >= LENGTH
    at = np.flatnonzero(long | np.append(long[1:], False))
    if len(at):
        best = longest_previous_factor(position[order[at]], np.where(long, lcp, 0)[at])
        out[order[at]] = best
    return out


# ---------------------------------------------------------------- anchors and pieces


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, for the places of a chunk."""
    made = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        p = np.full(CHUNK + LENGTH, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    return made[0], made[1]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the rows: row, first start (in the row), starts, anchor hash, fingerprint.

    Every start of a window belongs to exactly one piece.
    """
    out = []
    n, at, size = len(data), 0, len(offsets)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    pow_up, pow_down = _powers()
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = data
    while at + LENGTH <= n:
        end = min(n, at + CHUNK + LENGTH - 1)  # starts at .. end - LENGTH
        part = wide[at : end + 8]
        x = np.lib.stride_tricks.as_strided(part, (end - at, 8), (1, 1)).copy().view(np.uint64).ravel()
        m = end - at - ANCHOR + 1
        h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
        for j, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
            h += x[j : j + m] * np.uint64(odd)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        best = (h & ~np.uint64((1 << 20) - 1)) | np.arange(m, dtype=np.uint64)
        width, reach = _SPAN + 1, 1
        while reach * 2 <= width:
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        rest = width - reach
        if rest:
            best = np.minimum(best[: len(best) - rest], best[rest:])
        place = (best & np.uint64((1 << 20) - 1)).astype(np.int64)  # anchor of every start
        starts = len(place)
        cut = np.ones(starts, bool)
        cut[1:] = place[1:] != place[:-1]
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + starts)] - at
        cut[inner] = True
        lo = np.flatnonzero(cut)
        row = np.searchsorted(offsets, lo + at, "right") - 1
        hi = np.append(lo[1:], starts)
        hi = np.minimum(hi, offsets[np.minimum(row + 1, size - 1)] - LENGTH + 1 - at)  # windows end in their row
        ok = hi > lo
        lo, hi, row = lo[ok], hi[ok], row[ok]
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(h * pow_up[:m], out=sums[1:])
        print_ = (sums[hi + _SPAN] - sums[lo]) * pow_down[lo]
        print_ = K.mix(print_ ^ (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        out.append((row, lo + at - offsets[row], hi - lo, h[place[lo]], print_))
        at += starts
    return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


#: One piece as it travels.
PIECE = np.dtype([("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("n", "<i4")])


def collapse(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces sorted by anchor, print and place; marks of each print's first piece and of
    later copies. Rows of the very same place are no copies of each other."""
    p = p[np.lexsort((p["lo"], p["doc"], p["f"], p["h"]))]
    first = np.ones(len(p), bool)
    if len(p):
        first[1:] = (p["h"][1:] != p["h"][:-1]) | (p["f"][1:] != p["f"][:-1])
    group = np.cumsum(first) - 1
    head = p[first][group] if len(p) else p
    later = (p["doc"] != head["doc"]) | (p["lo"] != head["lo"])
    return p, first, later


def distinct_prints(h: np.ndarray) -> np.ndarray:
    """For sorted anchors of distinct pieces: how many pieces share each one's anchor."""
    if not len(h):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], h[1:] != h[:-1]])
    return np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]


_FOUND = "doc_id bigint, lo bigint, n int, h bigint, state int"
#: States of a found piece: repeated, to be compared by anchor, to be compared window by window.
REPEATED, OPEN, CROWD = 0, 1, 2


def _found(parts: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    cols = [np.concatenate([p[c] for p, _ in parts]) if parts else np.zeros(0, PIECE[c]) for c in ("doc", "lo", "n")]
    h = np.concatenate([p["h"] for p, _ in parts]) if parts else np.zeros(0, np.uint64)
    state = np.concatenate([np.full(len(p), s, np.int32) for p, s in parts]) if parts else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(h.view(np.int64)), pa.array(state)], ["doc_id", "lo", "n", "h", "state"])


def _extract(docs: DataFrame, buckets: int, crowded_here: int) -> DataFrame:
    """(bucket, kind, blob): pieces packed by anchor bucket, and repeats found at once.

    kind 0: pieces, by anchor; 1: repeated, by document; 2: pieces of crowded anchors, by
    fingerprint; 3: crowded anchors.
    """

    def send(p: np.ndarray) -> pa.RecordBatch:
        p, first, later = collapse(p)
        bucket, kind, blob = [], [], []

        def pack(rows: np.ndarray, what: int, by: np.ndarray) -> None:
            b = ((by >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            rows, b = rows[order], b[order]
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                bucket.append(int(b[s]))
                kind.append(what)
                blob.append(b"".join(np.ascontiguousarray(rows[c][s:e]).tobytes() for c in PIECE.names))

        heads = p[first]
        crowded = distinct_prints(heads["h"]) > crowded_here
        again, crowd = p[~first & later], heads[crowded]
        one_each = crowd[np.unique(crowd["h"], return_index=True)[1]]
        pack(heads[~crowded], 0, heads["h"][~crowded])
        # what a third of all documents may share goes by what tells its rows apart
        pack(again, 1, K.mix(again["doc"].view(np.uint64)))
        pack(crowd, 2, crowd["f"])
        pack(one_each, 3, one_each["h"])
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = K.buffers(batch.column(1))
            for a, b, d, o in K.slices(data, offsets, 8 << 20):
                row, lo, n, h, f = anchors(d, o)
                p = np.empty(len(row), PIECE)
                p["h"], p["f"], p["doc"], p["lo"], p["n"] = h, f, ids[a:b][row], lo, n
                held.append(p)
                size += len(p)
            if size >= GATHER:
                yield send(np.concatenate(held))
                held, size = [], 0
        if held:
            yield send(np.concatenate(held))

    return docs.mapInArrow(run, "bucket bigint, kind int, blob binary")


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // PIECE.itemsize
    p, at = np.empty(n, PIECE), 0
    for c in PIECE.names:
        p[c] = np.frombuffer(blob, PIECE[c], n, at)
        at += n * PIECE[c].itemsize
    return p


def _resolve(packed: DataFrame, crowded: int) -> DataFrame:
    """Repeats and open pieces of whole buckets; rows come sorted by bucket."""

    def close(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        get = lambda k: np.concatenate(held.get(k, []) or [np.zeros(0, PIECE)])
        p, first, later = collapse(get(0))
        heads = p[first]
        shared = distinct_prints(heads["h"])
        marked = np.isin(heads["h"], get(3)["h"])
        crowd = marked | (shared > crowded)
        q, q_first, q_later = collapse(get(2))
        again = [p[~first & later], q[~q_first & q_later], get(1)]
        return _found([*((x, REPEATED) for x in again), (heads[crowd], CROWD), (q[q_first], CROWD), (heads[~crowd & (shared > 1)], OPEN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        current = None
        for batch in batches:
            for bucket, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != current and held:
                    yield close(held)
                    held = {}
                current = bucket
                held.setdefault(kind, []).append(unpack(blob.as_py()))
        if held:
            yield close(held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


# ---------------------------------------------------------------- open pieces


_PARTS = "key bigint, doc_id bigint, lo bigint, n int, state int, bytes binary"


def _fetch(open_docs: DataFrame) -> DataFrame:
    """Bytes of the open pieces; windows of crowded anchors that this task saw before are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, text, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = text.encode()
                for x in pieces:
                    lo, n = x["lo"], x["n"]
                    if lo + n + LENGTH - 1 > len(b):
                        continue  # another row with this id
                    if x["state"] == OPEN:
                        out.append((x["h"], doc, lo, n, OPEN, b[lo : lo + n + LENGTH - 1]))
                        continue
                    for s in range(lo, lo + n):
                        w = b[s : s + LENGTH]
                        key = hashlib.blake2b(w, digest_size=16).digest()
                        old = seen.get(key)
                        if old is None:
                            seen[key] = (doc, s)
                            out.append((int.from_bytes(key[:8], "little", signed=True), doc, s, 1, CROWD, w))
                        elif old < (doc, s):
                            out.append((hash((doc, s)), doc, s, 1, REPEATED, None))
                        elif old > (doc, s):  # rows don't come in order of their ids
                            out.append((hash(old), *old, 1, REPEATED, None))
                            seen[key] = (doc, s)
                            out.append((int.from_bytes(key[:8], "little", signed=True), doc, s, 1, CROWD, w))
                if len(seen) > 500_000:
                    seen.clear()
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "doc_id", "lo", "n", "state", "bytes"])

    return open_docs.mapInArrow(run, _PARTS)


#: Suffixes that are sorted at once; each takes up to 2 * LENGTH bytes.
SORT_ROWS = 300_000


def _compare(parts: DataFrame) -> DataFrame:
    """Repeated runs of starts among pieces that share a key; rows come sorted by key."""

    def close(rows: list[tuple]) -> list[tuple[int, int, int]]:
        """rows: (key, doc, lo, n, bytes), whole keys."""
        if not rows:
            return []
        rows.sort(key=lambda r: (r[1], r[2]))
        n = np.array([r[3] for r in rows])
        size = n + LENGTH - 1
        text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(rows)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc, lo = np.array([r[1] for r in rows])[piece], np.array([r[2] for r in rows])[piece] + step
        place = np.zeros(len(piece), np.int64)  # equal places have equal numbers
        order = np.lexsort((lo, doc))
        new = np.concatenate([[False], (doc[order][1:] != doc[order][:-1]) | (lo[order][1:] != lo[order][:-1])])
        place[order] = np.cumsum(new)
        hit = np.flatnonzero(previous_factors(text, begin[piece] + step, (begin + size)[piece], place) >= LENGTH)
        if not len(hit):
            return []
        edge = np.concatenate([[True], (piece[hit][1:] != piece[hit][:-1]) | (hit[1:] != hit[:-1] + 1)])
        first = np.flatnonzero(edge)
        return list(zip(doc[hit[first]].tolist(), lo[hit[first]].tolist(), np.diff(np.append(first, len(hit))).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, key = 0, None

        def emit(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "lo", "n"])

        for batch in batches:
            ready: list[tuple] = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if r[4] == REPEATED:
                    ready.append(r[1:4])
                    continue
                if r[0] != key and size > SORT_ROWS:
                    ready += close(rows)
                    rows, size = [], 0
                key = r[0]
                rows.append((r[0], r[1], r[2], r[3], r[5]))
                size += r[3]
            yield emit(ready)
        yield emit(close(rows))

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id bigint, lo bigint, n int")


# ---------------------------------------------------------------- the operator


def removed_spans(lo: np.ndarray, n: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start at lo .. lo + n - 1."""
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(lo[order].tolist(), (lo + n + LENGTH - 1)[order].tolist(), strict=True):
        e = min(e, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif e > s:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _finish(joined: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, digest, spans = [], [], [], [], []
            for text, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = (text or "").encode()
                cut = removed_spans(np.array([x["lo"] for x in pieces]), np.array([x["n"] for x in pieces]), len(b)) if pieces else []
                kept, at = [], 0
                for s, e in cut:
                    kept.append(b[at:s])
                    at = e
                kept.append(b[at:])
                size.append(len(b))
                gone.append(sum(e - s for s, e in cut))
                runs.append(len(cut))
                digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
                spans.append([{"start": s, "end": e} for s, e in cut])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def remove_repeats(docs: DataFrame, buckets: int | None = None, crowded_here: int = CROWDED_HERE, crowded: int = CROWDED) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans``.

    ``buckets`` of anchors: by default eight for every shuffle partition, and more if their
    share of the input would exceed ``BUCKET_BYTES``. One plan without driver-side steps; its
    two joins with the texts share one exchange of them.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column")
    spark = docs.sparkSession
    ship(spark)
    if buckets is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, MOST_BUCKETS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # renamed columns: an alias of the same name is dropped in one branch only, and the exchange not shared
    every = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("body"))
    texts = every.where("id is not null")
    found = _resolve(_extract(texts, buckets, crowded_here), crowded)
    pieces = F.collect_list(F.struct("lo", "n", "h", "state"))
    opened = found.where(F.col("state") != REPEATED).groupBy("doc_id").agg(pieces.alias("pieces"))
    fetched = _fetch(texts.join(opened, F.col("id") == F.col("doc_id")).select("id", "body", "pieces"))
    repeats = found.where(F.col("state") == REPEATED).select("doc_id", "lo", "n").unionByName(_compare(fetched))
    cut = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("pieces"))
    joined = texts.join(cut, F.col("id") == F.col("doc_id"), "left").select("id", "body", "pieces")
    alone = every.where("id is null").select("id", "body", F.lit(None).cast(joined.schema["pieces"].dataType).alias("pieces"))
    return _finish(joined.unionByName(alone)).withColumn("doc_id", F.col("doc_id").cast(kind))
