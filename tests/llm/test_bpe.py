import hashlib
import random

import numpy as np
import pytest

from lexmill.llm import bpe, token_counts
from lexmill.llm.queries import vocabulary_path

TEXTS = [
    None, "", " ", "\n", "a", "Hello world! It's a test.", "don't  stop\n\n  now ", "<|endoftext|>", "x <|endoftext|>\n<|endof", "日本語 テスト", "é\xa0É  à la",
    "tab\there \x1c odd\x85 space end ", "ſ ʼ ʰ ２３ ٣ ²", "a" * 5000, "ab " * 3000, "''ll 're?'s 's", "\x00\x01 ﻿", "🙂🙂 🙂",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, "again", "x", 1), (1, "again", "x", 1), (None, "no id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_encode_equals_library_and_round_trips(docs, library):
    got = bpe.encode_documents(docs, vocabulary_path()).collect()
    assert len(got) == len(TEXTS) + 3
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id == 1:
            continue
        want = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(want, "<u4").tobytes()).hexdigest()
        assert r.decoded == (text[r.doc_id] or "") == library.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_random_texts_equal_library(library):
    rng = np.random.default_rng(1)
    alphabet = [*"ab'sdtmrevl L1.,?! \n\t\r", "  ", " '", "'re", "<|endoftext|>", "é", "à", "\xa0", " ", "\x1c", "日", "🙂", "٣", "́", "²"]
    codec, counter = bpe.FragmentCodec(vocabulary_path()), token_counts.WholeTokenCounter(vocabulary_path())
    for _ in range(4000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(next(codec.encode([t])), "<u4").tolist() == want
        assert counter.count(t) == len(want)


def test_cuts_are_never_inside_a_token():
    codec = bpe.FragmentCodec(vocabulary_path())
    for i, b in enumerate(codec.table):
        if codec.table[i].decode(errors="replace") not in codec.special:
            assert not any(codec.never[x, y] for x, y in zip(b, b[1:], strict=False))


def test_full_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    codec, counter = bpe.FragmentCodec(vocabulary_path()), token_counts.WholeTokenCounter(vocabulary_path())
    for t in TEXTS * 2:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(next(codec.encode([t or ""])), "<u4").tolist() == want
        assert counter.count(t or "") == len(want)


def test_counts(docs, library):
    got = token_counts.count_tokens(docs, vocabulary_path(), limit=100).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(TEXTS) + 3
    for r in got:
        if r.doc_id != 1:
            n = len(library.encode(text[r.doc_id] or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text[r.doc_id] or "").encode()), n > 100)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none, vocabulary_path()).count() == 0
    assert token_counts.count_tokens(none, vocabulary_path()).count() == 0


def test_pieces_of_many_texts_equal_those_of_each():
    c = bpe.FragmentCodec(vocabulary_path())
    rng = random.Random(8)
    alphabet = "abcXYZ019 '\n\t.,-_éßñΩд日本\u00a0\u2003😀<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "a", "'", "", "x<|endoftext|>y z"]
    got = c.pieces(texts)
    assert got == [[p.encode() for f in c.fragments(t) for p in c.parts(f)] for t in texts]
    assert sum(len(ps) > len(c.fragments(t)) for t, ps in zip(texts, got, strict=True)) > 1000
    assert c.pieces([""]) == [[]] and c.pieces([]) == []
    assert [list(memoryview(x).cast("I")) for x in c.encode(texts)] == [c.tok.encode(t, add_special_tokens=False).ids for t in texts]
