"""Vectorised text kernels: words, hashes and sums over whole Arrow batches of texts.

A batch of texts is one byte buffer with offsets, so words are found and hashed for all
texts of a batch at once, at a cost that depends on bytes and not on the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are handled at once.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes as they are, and with A-Z lower-cased.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32
#: Every byte but blank and \t \n \v \f \r belongs to a word.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word offsets of the rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:n]
    last = m.copy()
    last[:-1] &= ~m[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Lanes of eight bytes that are hashed for all spans at once; what is behind them in long
#: spans goes through a cryptographic hash.
LANES = 4
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SIZE = np.uint64(0xA0761D6478BD642F)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of the spans, each byte replaced by its value in ``table``.

    Lanes of eight bytes are chained through the finalizer, so that neither the order of bytes
    nor that of lanes cancels out; equal hashes of different spans are a matter of chance alone.
    """
    wide = np.zeros(len(data) + 8, np.uint8)
    np.take(table, data, out=wide[: len(data)])
    lanes = np.ndarray((len(data) + 1,), "<u8", wide, 0, (1,))
    left = ends - starts
    h = mix((left.astype(np.uint64) + np.uint64(1)) * _SIZE)
    live, at = np.flatnonzero(left), starts[left > 0]
    left = left[live]
    for _ in range(LANES):
        if not len(live):
            return h
        h[live] = mix(h[live] ^ (lanes[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    view = memoryview(wide)
    rest = b"".join(hashlib.blake2b(view[s : s + n], digest_size=8).digest() for s, n in zip(at.tolist(), left.tolist(), strict=True))
    h[live] = mix(h[live] ^ np.frombuffer(rest, "<u8"))
    return h


_ODD = mix(np.arange(101, 133, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (also across rows; callers drop those)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word[:n] * _ODD[0]
    for j in range(1, k):
        h += word[j : n + j] * _ODD[j]
    return mix(h)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every item, from n + 1 item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for rows without any."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of every row, sorted, and their n + 1 offsets.

    Words are lower-cased in A-Z. A row of fewer words has one shingle, all its words; a
    row without words has none.
    """
    s, e, wo = words(data, offsets)
    w = span_hashes(data, s, e, LOWER)
    size = np.diff(wo)
    rows = len(size)
    g = gram_hashes(w, k)
    count = np.maximum(size - k + 1, 0)
    row = np.repeat(np.arange(rows), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + wo[:-1][row]
    h = g[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.array([mix(np.array([(w[wo[r] : wo[r + 1]] * _ODD[8 : 8 + size[r]]).sum() ^ _ODD[20 + size[r]]], np.uint64))[0] for r in short], np.uint64)
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(rows + 1))
