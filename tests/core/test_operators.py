"""Dedup, ordered operators, metrics and registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import cleaning, dedup, metrics, sequences
from lexmill.session import ship


def test_corpus_dedup_keeps_first_and_blanks(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "Hello World\n\nb"), (2, "  hello   world  \nB\nc\n"), (3, "c"), (4, ""), (5, None)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in dedup.dedup_corpus_lines(docs).collect()}
    assert got == {1: ("Hello World\n\nb", 3, 3), 2: ("c\n", 4, 2), 3: ("", 1, 0), 4: ("", 1, 1), 5: ("", 0, 0)}
    again = dedup.dedup_corpus_lines(spark.createDataFrame([(k, v[0]) for k, v in got.items()], "doc_id int, text string"))
    assert {r.doc_id: r.text for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_records_and_unseen(spark):
    ship(spark)
    r = spark.createDataFrame([(1, "Hello world"), (2, "Hello world"), (3, "HELLO  World "), (4, "Different text")], "id int, t string")
    assert sorted(x.id for x in dedup.dedup_records(r, "id", "t").collect()) == [1, 4]
    seen = spark.createDataFrame([("a",), ("a",)], "h string")
    assert [x.h for x in dedup.unseen(spark.createDataFrame([("a",), ("b",)], "h string"), seen).collect()] == ["b"]


@pytest.mark.parametrize("block", [7, 1000])
def test_similar_pairs_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 6))
    v[10] = 2 * v[3]
    v[20] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype(np.float32).astype(float)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    s = np.divide(u, n, out=np.zeros_like(u), where=n > 0)
    s = s @ s.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.7}
    pairs = dedup.similar_pairs(rows, 0.7, block=block)
    assert {(r.i, r.j) for r in pairs.collect()} == want
    assert {r.vec_id for r in dedup.drop_similar(rows, pairs).collect()} == set(range(60)) - {j for _, j in want}


@pytest.mark.parametrize("n,block,stride", [(0, 16, 8), (15, 16, 8), (16, 16, 8), (96, 16, 8), (100, 16, 8), (100, 16, None), (17, 16, 0)])
def test_sample_windows(spark, n, block, stride):
    rows = spark.createDataFrame([(1, list(range(n)))], "doc_id int, tokens array<bigint>")
    got = sorted((r.sample, r.input_ids, r.labels) for r in sequences.sample_windows(rows, block, stride).collect())
    step, t = stride or block, list(range(n))
    want = []
    for k in range(max(0, (n - block) // step + 1) if n >= block else 0):
        s = k * step
        e = min(s + block, n - 1)
        want.append((k, t[s:e], t[s + 1 : e + 1]))
    assert got == want


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (0.9, 0.1, 0.0), (0.34, 0.33, 0.33)])
def test_splits_add_up(spark, ratios):
    for n in (0, 1, 2, 3, 7, 10, 101):
        sizes = spark.range(1).select(sequences.split_sizes(F.lit(n), ratios)).first()[0]
        assert sum(sizes) == n and min(sizes) >= 0
        rows = sequences.split_rows(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", ratios)
        by = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
        assert sum(by.values()) == n
        if ratios[2]:
            assert [by.get(k, 0) for k in ("train", "val", "test")] == sizes
    with pytest.raises(ValueError):
        sequences.split_sizes(F.lit(3), (0.5, 0.1, 0.1))


def test_batches_and_early_stopping(spark):
    rows = sequences.batches(spark.range(10), ["id"], 4, drop_last=True)
    assert sorted((r.id, r.batch_id) for r in rows.collect()) == [(i, i // 4) for i in range(8)]
    v = spark.createDataFrame([([3.0, 2.0, 2.0, 1.95, 1.9, 1.0],)], "v array<double>")
    assert v.select(sequences.early_stopping(F.col("v"), 3).stop).first()[0] is None
    assert v.select(sequences.early_stopping(F.col("v"), 3, 0.15).stop).first()[0] == 5


def test_registry(spark):
    r = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None), ("c", 3, 0.2), ("d", 4, 0.2), ("e", 5, 0.9)], "name string, created_at int, loss double")
    assert [x.name for x in metrics.list_runs(r, "loss").collect()] == ["c", "d", "a", "e", "b"]
    assert metrics.best_run(r).first().name == "d" and metrics.latest_run(r).first().name == "e"
    assert sorted(x.name for x in metrics.runs_to_delete(r, 1).collect()) == ["a", "b", "c"]


def test_filters_on_logits(spark):
    logits = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, 1.0), (1, 3, -5.0), (2, 0, 9.0), (2, 1, 0.0)], "row int, token int, logit double")
    assert sorted((r.row, r.token) for r in metrics.top_k(logits, 1).collect()) == [(1, 0), (1, 1), (2, 0)]
    assert sorted((r.row, r.token) for r in metrics.top_p(logits, 0.5).collect()) == [(1, 0), (1, 1), (2, 0)]
    assert sorted((r.row, r.token) for r in metrics.greedy(logits).collect()) == [(1, 0), (2, 0)]
    pushed = {(r.row, r.token): r.logit for r in metrics.repetition_penalty(logits, logits.where("token = 3 or row = 2"), 2.0).collect()}
    assert pushed[1, 3] == -10.0 and pushed[2, 0] == 4.5 and pushed[1, 0] == 2.0
    assert metrics.weighted_loss(spark.createDataFrame([], "loss double, n int")).first().loss == float("inf")


def test_cleaner_on_empty_and_null(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A line that is long enough\na LINE that is long enough\n42\n")], "doc_id int, text string")
    got = {r.doc_id: r for r in cleaning.clean_documents(docs).collect()}
    assert got[1].cleaned == got[2].cleaned == "" and got[1].stats.compression_ratio == 0.0
    assert got[3].cleaned == "A line that is long enough\n" and got[3].stats.duplicates_removed == 1
    assert cleaning.cleaning_summary(cleaning.clean_documents(docs.limit(0))).first().total_documents == 0


def test_dedup_chunks(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y\nz")], "doc_id int, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [2.0, 0.1]), (2, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0])], "doc_id int, chunk int, embedding array<double>")
    got = {r.doc_id: (r.text, r.n_chunks, r.n_similar) for r in dedup.dedup_chunks(docs, vectors, 0.9, chunk_words=2).collect()}
    assert got == {1: ("a b c d", 3, 1), 2: ("x y", 2, 1)}


def test_line_stats(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a\n\nb", "en"), (2, "A\nc\nc", "de"), (3, "c", None)], "doc_id int, text string, lang string")
    got = {r.lang: (r.n_lines, r.n_kept, r.n_removed, r.n_distinct) for r in dedup.line_dedup_stats(docs, "lang").collect()}
    assert got == {"en": (3, 3, 0, 2), "de": (3, 1, 2, 1), None: (1, 0, 1, 0)}
