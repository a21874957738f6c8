"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is encoded by itself; those that come back as exactly
their own id are proven to be whole tokens. Texts are cut into pre-tokens, proven ones
count as one without any merge, and only the rest is merged (by the library, once for each
distinct pre-token in a bounded cache).

The pre-token pattern is applied to characters below U+0250, whose classes are the same in
all Unicode versions; a fragment with any other character, or with a special string, goes
to the library as it is.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows with equal ids or
texts are counted one by one; all other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bpe import CACHE_BYTES, CACHE_ENTRIES, STABLE, FragmentCodec, pretoken_source
from lexmill.session import ship


class WholeTokenCounter:
    """Counts the tokens of texts for one byte-level vocabulary file."""

    def __init__(self, path: str, proven: frozenset[str] | None = None):
        self.codec = FragmentCodec(path)
        self.find = re.compile(pretoken_source()).findall
        self.odd = self.codec.unsure
        self.single = prove(self.codec) if proven is None else proven
        self.rest: dict[str, int] = {}

    def _library(self, parts: set[str]) -> None:
        names = list(parts)
        merger = self.codec.merger
        if merger is not None:  # pre-tokens of sure class; the others go to the library
            sure = {p for p in names if self.codec.plain(p)}
            self.rest.update((p, len(merger.encode_single_piece(p.encode()))) for p in sure)
            names = [p for p in names if p not in sure]
        if names:
            self.rest.update((p, len(e.ids)) for p, e in zip(names, self.codec.tok.encode_batch_fast(names, add_special_tokens=False), strict=True))

    def _sum(self, parts: list[str]) -> int:
        rest = self.rest
        try:
            return sum(map(rest.__getitem__, parts))
        except KeyError:
            new = set(parts).difference(rest)
            self._library(new)
            room = CACHE_ENTRIES - (len(rest) - len(new))
            total = sum(map(rest.__getitem__, parts))
            for p in new:
                room -= 1
                if room < 0 or len(p) > CACHE_BYTES:
                    del rest[p]
            return total

    def _plain(self, text: str) -> int:
        single = self.single
        tokens = self.find(text)
        merged = [t for t in tokens if t not in single]
        return len(tokens) - len(merged) + self._sum(merged)

    def count(self, text: str) -> int:
        special = self.codec.special
        if not self.odd(text) and not any(s in text for s in special):
            return self._plain(text)
        plain, other = [], []
        for f in self.codec.fragments(text):
            (other if self.odd(f) or any(s in f for s in special) else plain).append(f)
        return sum(map(self._plain, plain)) + self._sum(other)


def prove(codec: FragmentCodec) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, their own."""
    found = {}
    for i, b in enumerate(codec.table):
        try:
            text = b.decode()
        except UnicodeDecodeError:
            continue
        if text and text not in codec.special and all(ord(c) < STABLE for c in text):
            found[text] = i
    names = list(found)
    return frozenset(t for t, e in zip(names, codec.tok.encode_batch_fast(names, add_special_tokens=False), strict=True) if e.ids == [found[t]])


_counters: dict[str, WholeTokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    The proof runs once on the driver; its strings (a part of the vocabulary, so bounded
    by the file) travel with the function.
    """
    ship(docs.sparkSession)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    proven = docs.sparkSession.sparkContext.broadcast(sorted(prove(FragmentCodec(path))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = WholeTokenCounter(path, frozenset(proven.value))
        use = _counters[path]
        use.rest.clear()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = [len(t.encode()) if t else 0 for t in texts]
            count = [use.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array([n > limit for n in count], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )
        use.rest.clear()  # the worker lives on, beside whatever runs next

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
