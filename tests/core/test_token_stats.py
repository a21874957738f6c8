"""Token statistics count every token of a long document."""

from lexmill.plans import io_queries


def test_long_documents_count_whole(spark, tmp_path):
    spark.createDataFrame([(1, " a" * 120_000), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = io_queries.f11_f12_k7_k10_token_stats(spark, str(tmp_path)).first()
    assert got.tokens == 120_001 and got.chars == 240_001 and got.chars_per_token == 2.0


def test_tokenizer_kinds():
    import pytest
    from public_tokenizers import path

    from lexmill.operators import vocabulary

    texts = ["Hello world", "", "é 日本"]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"):
        t = vocabulary.tokenizer(path(name))
        ids = t.encode(texts)
        assert t.decode(ids) == texts and max(map(max, filter(None, ids))) < t.size
    with pytest.raises(ValueError, match="known are"):
        vocabulary.tokenizer("x.bin")
