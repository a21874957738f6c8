"""The trusted target of the quality rules is counted whole."""

import numpy as np
import pyarrow as pa

from lexmill.llm import kernels, quality


def test_every_trusted_document_counts(spark):
    docs = spark.range(13_000).selectExpr("id as doc_id", "concat('own', id, ' same') as text")
    weights = quality.train(docs, docs.select("doc_id").where("doc_id < 12500"))
    data, offsets = kernels.buffers(pa.array([f"own{i}" for i in range(13_000)]))
    bucket, _, _ = quality.ngrams(data, offsets, quality.BITS)
    # a word of a trusted document is more likely in the target than in the corpus
    assert (weights[bucket[:12_500]] > 0).all()
    assert np.mean(weights[bucket[12_500:]] < 0) > 0.95
