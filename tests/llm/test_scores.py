"""Scores of the quality rules against a plain computation; very long texts in all text operators."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lexmill.llm import bpe, kernels, minhash, pii, quality, suffix_dedup, token_counts, toxicity
from lexmill.llm.queries import vocabulary_path

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return [*w, *zip(w[:-1], w[1:], strict=True)]


def test_scores_equal_a_plain_computation(spark):
    # so few n-grams that none share a bucket: their counts are those of the n-grams themselves
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "é"], 60)) for _ in range(30)]
    bad = [" ".join(rng.choice(["alpha", "click", "BUY", "now", "\n"], 60)) for _ in range(30)]
    texts = [*good, *bad, None, "", "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 30 and i % 2 == 0:
            target.update(grams(t))
    buckets = 1 << quality.BITS
    n, m = sum(raw.values()), sum(target.values())
    prior = quality.PRIOR * n

    def weight(g):
        p = (raw[g] + 1) / (n + buckets)
        return math.log((target[g] + prior * p) / (m + prior)) - math.log(p)

    for limit in (quality.BROADCAST_IDS, 0):  # by broadcast and by shuffle
        quality.BROADCAST_IDS, kept = limit, quality.BROADCAST_IDS
        try:
            got = {r.doc_id: r for r in quality.quality(docs, trusted).collect()}
        finally:
            quality.BROADCAST_IDS = kept
        for i, t in enumerate(texts):
            g = grams(t)
            want = sum(map(weight, g)) / len(g) if g else 0.0
            assert abs(got[i].score - want) < 1e-6
            assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.THRESHOLD)
    assert min(got[i].score for i in range(30)) > max(got[i].score for i in range(30, 60))


def test_very_long_texts(spark):
    # one text of 3 MB in a single line, one word of 2 MB, one of many short lines
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 450_000)), "q" * 2_000_000, "ab cd\n" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r.doc_id: r.n_shingles for r in minhash.near_duplicates(docs).collect()}
    assert near[1] == 1 and near[2] == 2 and near[0] > 400_000
    data, offsets = kernels.buffers(pa.array(texts))
    rules = quality.rules(data, offsets)
    assert rules["n_words"].tolist() == [450_000, 1, 600_000] and rules["n_dup_lines"].tolist() == [0, 0, 299_999]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 3
    assert [r.spans for r in pii.pii(docs).collect()] == ["", "", ""]
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, vocabulary_path()).collect()}
    ids = {r.doc_id: r.n_tokens for r in bpe.encode_documents(docs, vocabulary_path(), with_ids=False, with_text=False).collect()}
    assert counts == ids
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[0] == 0 and removed[1] == 2_000_000 - 1 and removed[2] == 6 * 300_000 - 6
