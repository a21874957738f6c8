"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that never stands inside any vocabulary token is a certain cut: no merge can
ever cross it. Texts are cut there, in front of blanks and newlines and at all other such pairs; every
part is encoded by itself, and the ids are concatenated. Parts repeat (words, mostly), so most
come from a bounded cache, and only new ones are merged.

Merging itself is done by a rank merger (tiktoken) when the file's merges are in rank order,
else by the tokenizers library; special strings and characters whose Unicode class differs
between versions always go to the library.

A cut must also leave the pre-tokenizer's splits alone. For the byte-level pattern

* a cut in front of a blank or newline is safe after any character that is no white space
  (every alternative of the pattern ends there, and none looks back), and
* a cut between two characters that are no white space is safe unless it separates an
  apostrophe from what it may contract with.

Defined results: null text counts as empty; the empty text has no ids; special strings
inside texts become their special id, as the library does by default; rows with equal ids
or texts are encoded one by one; all other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import ship

#: Entries of a task's cache of parts; when it is full, new parts are encoded each time.
CACHE_ENTRIES = 200_000
#: Longer parts are encoded but not kept.
CACHE_BYTES = 48
#: Texts are taken in groups of about so many characters.
GROUP_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character; character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The byte-level pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this have the same class in every Unicode version.
STABLE = 0x250
#: White space below it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
#: Characters that some definition calls white space.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\x1c\x1d\x1e\x1f\x85᠎​⁠﻿"


_BLANK = np.array([chr(b) in _SPACES and b < 0x80 for b in range(256)])
_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])


def _set(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(STABLE) if unicodedata.category(chr(c))[0] == kind)


def pretoken_source() -> str:
    """The byte-level pre-token pattern with explicit classes for stable characters."""
    letters, digits, white = _set("L"), _set("N"), re.escape(_WHITE)
    return f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{white}{letters}{digits}]+|[{white}]+(?![^{white}])|[{white}]+"


class FragmentCodec:
    """Encodes and decodes with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        alphabet = byte_alphabet()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in added.values()]
        self.table: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.table[i] = piece.encode() if i in added else bytes(alphabet[c] for c in piece)
        self.never = np.ones((256, 256), bool)
        cut_free = {" ": True, "\n": True}  # no token holds it behind a character that is no white space
        for i, b in enumerate(self.table):
            if i not in added and len(b) > 1:
                a = np.frombuffer(b, np.uint8)
                self.never[a[:-1], a[1:]] = False
                for c in cut_free:
                    at = b.find(c.encode(), 1)
                    while at > 0:
                        cut_free[c] &= b[:at].decode(errors="replace")[-1] in _SPACES
                        at = b.find(c.encode(), at + 1)
        self._never = self.never.tolist()
        safe = not any(t.lstrip or t.rstrip or set(t.content) & set(" \n") for t in added.values())
        self.cuts = "".join(c for c, free in cut_free.items() if safe and free)
        self._split = re.compile(rf"[{self.cuts}]*[^{self.cuts}]+|[{self.cuts}]+").findall if self.cuts else lambda t: [t] if t else []
        other = re.escape("".join(c for c in _SPACES if c not in self.cuts))
        self._odd = re.compile(rf"[{other}](?:[{self.cuts or other}]|\Z)").search
        self._ends_odd = re.compile(rf"[{other}]\Z").search
        self._special = re.compile("|".join(map(re.escape, self.special))).search if self.special else None
        self._wide_space = re.compile("[" + re.escape("".join(c for c in _SPACES if ord(c) >= 0x80)) + "]").search
        self.unsure = re.compile(f"[^\\x00-{chr(STABLE - 1)}]").search
        self._cut_byte = np.array([chr(b) in self.cuts for b in range(256)])
        self.merger = self._merger(path, added)
        self.cache: dict[bytes, bytes] = {}

    def fragments(self, text: str) -> list[str]:
        """The parts of ``text`` between certain cuts in front of blanks and newlines."""
        found = self._split(text)
        if self._odd(text):  # white space of another kind before a cut: no cut there
            whole: list[str] = []
            for f in found:
                if whole and self._ends_odd(whole[-1]):
                    whole[-1] += f
                else:
                    whole.append(f)
            return whole
        return found

    def parts(self, fragment: str) -> list[str]:
        """``fragment`` cut at every other pair that no token holds."""
        if len(fragment) < 2 or any(s in fragment for s in self.special):
            return [fragment]
        out, at, last, never = [], 0, fragment[0], self._never
        for i in range(1, len(fragment)):
            c = fragment[i]
            if never[last.encode()[-1]][c.encode()[0]] and last not in _SPACES and c not in _SPACES and last != "'" and (c != "'" or last.isascii() and last.isalnum()):
                out.append(fragment[at:i])
                at = i
            last = c
        return [*out, fragment[at:]]

    def _merger(self, path: str, added: dict):
        """A rank merger for the file, or None if its merges aren't in rank order."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.table) if i not in added}
        if len(ranks) != 256 + len(merges) or set(ranks.values()) != set(range(len(ranks))):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def plain(self, part: str) -> bool:
        """Without special strings and characters of unsure class."""
        return not (self.unsure(part) or self._special and self._special(part))

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The parts of every text between all certain cuts, in UTF-8.

        The byte pairs of all texts are looked up at once; texts with special strings or white
        space beyond ASCII, whose cuts need more than a pair, are cut one by one.
        """
        joined = "\0".join(texts)
        odd: set[int] = set()
        if self._special and self._special(joined) or self._wide_space(joined):
            odd = {i for i, t in enumerate(texts) if self._special and self._special(t) or self._wide_space(t)}
        coded = [b"" if i in odd else t.encode() for i, t in enumerate(texts)]
        data = b"".join(coded)
        end = np.cumsum([len(c) for c in coded], dtype=np.int64)
        text = np.frombuffer(data, np.uint8)
        a, b = text[:-1], text[1:]
        cut = self.never[a, b] & ((b & 0xC0) != 0x80) & ~_BLANK[b] & (a != 0x27) & ((b != 0x27) | _ALNUM[a])
        cut |= self._cut_byte[b]
        cut &= ~_BLANK[a]
        edge = end[:-1] - 1
        cut[edge[(edge >= 0) & (edge < len(cut))]] = True  # between two texts
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1]) if data else np.zeros(0, np.int64)
        ends = [*starts[1:].tolist(), len(data)]
        found = [data[s:e] for s, e in zip(starts.tolist(), ends, strict=True)] if data else []
        at = np.searchsorted(starts, np.concatenate([[0], end])).tolist()
        out = [found[at[i] : at[i + 1]] for i in range(len(texts))]
        for i in odd:
            out[i] = [p.encode() for f in self.fragments(texts[i]) for p in self.parts(f)]
        return out

    def _resolve(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        names = {p: p.decode() for p in pieces}
        merge = self.merger.encode_ordinary if self.merger is not None else None
        other: list[bytes] = []
        if merge is None or not self.plain("\0".join(names.values())):
            other = [p for p, t in names.items() if merge is None or not self.plain(t)]
        ids = dict(zip(other, (array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast([names.pop(p) for p in other], add_special_tokens=False)), strict=True)) if other else {}
        ids.update((p, array("I", merge(t)).tobytes()) for p, t in names.items())
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (at == first or size < GROUP_CHARS):
                size += len(texts[at])
                at += 1
            group = self.pieces(texts[first:at])
            cache = self.cache
            missing = set(chain.from_iterable(group)).difference(cache)
            if missing:
                cache.update(self._resolve(missing))
            for ps in group:
                yield b"".join(map(cache.__getitem__, ps))
            room = CACHE_ENTRIES - (len(cache) - len(missing))
            for p in missing:  # the first ones, mostly the frequent ones, stay
                room -= 1
                if room < 0 or len(p) > CACHE_BYTES:
                    del cache[p]

    def decode(self, ids: bytes) -> bytes:
        """The text of ``ids`` in UTF-8, as the library's byte-level decoder gives it."""
        out = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()
        return out


_codecs: dict[str, FragmentCodec] = {}


def codec(path: str) -> FragmentCodec:
    """One codec per worker process and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = FragmentCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Per row: id, ``ids`` (array<int>), ``decoded`` (string), and their digests.

    ``with_ids=False`` and ``with_text=False`` leave out a wide column each. One pass, no shuffle: every row is
    encoded where it was read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        use.cache.clear()
        yield from encoded(use, batches)
        use.cache.clear()  # the worker lives on, beside whatever runs next

    def encoded(use: FragmentCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            count, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for packed in use.encode(texts):
                back = use.decode(packed)
                count.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                if with_text:
                    decoded.append(back.decode())
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")
    return source.mapInArrow(run, schema)
