"""Tokenizers get a bounded part of a batch at once, and every row comes back."""

import numpy as np
import pandas as pd
import pyarrow as pa
from public_tokenizers import path

from lexmill.operators import vocabulary


class Watched:
    """A tokenizer that notes how much it got at once."""

    def __init__(self):
        self.own, self.texts, self.ids = vocabulary.tokenizer(path("byte_bpe_50k.json")), [], []

    def encode(self, texts):
        self.texts.append(sum(len(t.encode()) for t in texts))
        return self.own.encode(texts)

    def decode(self, ids):
        self.ids.append(sum(map(len, ids)))
        return self.own.decode(ids)


def test_batches_reach_the_tokenizer_in_slices():
    texts = [f"Zeile {i} über é 日本 <|endoftext|>\n" * (i % 7) for i in range(400)] + [None, "", "long " * 2_000, "end"]
    model = Watched()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(vocabulary.encoded(model, batch, most=4_000))
    assert got["doc_id"].to_pylist() == list(range(len(texts)))
    assert got["tokens"].to_pylist() == model.own.encode([t or "" for t in texts])
    assert sorted(model.texts)[-2] <= 4_000 < max(model.texts) == 10_000
    ids = pd.Series([np.array(x, np.int32) for x in got["tokens"].to_pylist()] + [None])
    assert vocabulary.decoded(model, ids, most=1_000) == [t or "" for t in texts] + [""]
    assert sorted(model.ids)[-2] <= 1_000
    cut = pa.Table.from_batches(vocabulary.encoded(model, batch, 3, most=4_000))["tokens"].to_pylist()
    assert cut == [x[:3] for x in got["tokens"].to_pylist()]


def test_nothing_is_a_slice_too():
    model = Watched()
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["doc_id", "text"])
    assert [b.num_rows for b in vocabulary.encoded(model, none)] in ([], [0])
    assert vocabulary.decoded(model, pd.Series([], dtype=object)) == []
    sizes = [3, 3, 9, 1, 1]
    assert [sizes[s] for s in vocabulary.slices(sizes, 5)] == [[3], [3], [9], [1, 1]]


def test_default_slices_of_a_full_batch():
    """What one Arrow batch of 10,000 rows holds is never given to the tokenizer as a whole."""
    model = Watched()
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["word " * 120] * 10_000)], ["doc_id", "text"])
    assert sum(b.num_rows for b in vocabulary.encoded(model, batch)) == 10_000
    assert max(model.texts) <= vocabulary.SLICE and sum(model.texts) == 6_000_000
