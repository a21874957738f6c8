"""Colliding words, repeated ids, other kinds of ids, few labels."""

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import decontamination, kernels, line_dedup, minhash, quality, suffix_dedup, toxicity


def thue_morse(n):
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_words_that_cancel_out_differ(spark):
    x, y = thue_morse(10)
    data, offsets = kernels.buffers(pa.array([x, y, x[:64], y[:64], x + y, y + x]))
    s, e, _ = kernels.words(data, offsets)
    assert len(set(kernels.span_hashes(data, s, e).tolist())) == 6
    assert quality.rules(*kernels.buffers(pa.array([x + "\n" + y])))["n_dup_lines"].tolist() == [0]
    got = minhash.near_duplicates(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")).collect()
    assert all(r.kept for r in got)


def test_span_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    spans = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (*range(70), 200, 1000) for _ in range(4)]
    for pad in (0, 3, 8):
        data = np.frombuffer(b"".join(b"x" * pad + s for s in spans), np.uint8)
        size = np.array([len(s) for s in spans])
        ends = np.cumsum(size + pad)
        h = kernels.span_hashes(data, ends - size, ends)
        assert len(set(h.tolist())) == len(set(spans))
        first = h if pad == 0 else first
        assert (h == first).all()
    data = np.frombuffer(b"ABC abc", np.uint8)
    a, b = kernels.span_hashes(data, np.array([0, 4]), np.array([3, 7]), kernels.LOWER)
    assert a == b


def test_lines_of_rows_with_one_id(spark):
    rows = [(i, "BOILER", f"site {i}") for i in range(12)]
    rows += [(50, "BOILER\nkeep me", "a"), (50, "unique first line\nBOILER tail", "b"), (51, "x", None), (51, "x", None), (None, "BOILER", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([(-1, "BOILER"), (0, "BOILER"), *((i, "") for i in range(1, 12)), (50, "keep me"), (50, "unique first line\nBOILER tail"), (51, "x"), (51, "x")])


def test_near_copies_of_rows_with_one_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text), (7, other), (8, text), (9, other), (10, None), (10, "a b")], "doc_id long, text string")
    runs = [sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()) for d in (docs, docs.repartition(3), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]
    by = {(i, n): (c, k) for i, n, c, k in runs[0]}
    # one of the two texts of 7 counts; only its copy is linked
    assert by[7, 36] == by[7, 26] == (7, True)
    assert sorted([by[8, 36], by[9, 26]]) in ([(7, False), (8, True)], [(7, False), (9, True)])
    assert by[10, 0] == by[10, 1] == (10, True)


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "b c")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integer"):
        minhash.near_duplicates(docs)
    with pytest.raises(TypeError, match="integer"):
        suffix_dedup.remove_repeats(docs)


def test_few_labels_reject_no_clean_text(spark):
    rows = [(i, f"you awful idiot number{i} go away", 1) for i in range(10)] + [(100 + i, f"a pleasant walk number{i} in parks", 0) for i in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "something else entirely")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.toxicity(docs, labels).collect()}
    assert not any(got[i] for i in got if i >= 100)
    one_sided = {r.doc_id: r.rejected for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()}
    assert not any(one_sided[i] for i in (900, 901))


def test_fit_finds_the_known_optimum():
    # one feature in 30 of 40 graded and 10 of 60 other texts: the fitted odds are the counted ones
    grade = np.array([1] * 40 + [0] * 60)
    has = np.array([1] * 30 + [0] * 10 + [1] * 10 + [0] * 50)
    offsets = np.concatenate([[0], np.cumsum(has)])
    model = toxicity.fit(np.ones(has.sum(), np.int64), offsets, np.where(grade == 1, 1, 0), bits=4, rounds=3000, rate=0.05, ridge=0)
    # a single indicative feature leaves no severe grade apart
    p = model.severity(np.ones(1, np.int64), np.array([0, 1, 1]))
    assert len(model.thresholds) == 1
    assert abs(p[0] - 30 / 40) < 0.01 and abs(p[1] - 10 / 60) < 0.01


def test_contamination_of_rows_with_one_id_and_items_without(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, "clean words only"), (1, f"{passage} and more"), (None, passage), (None, "nothing"), (2, "Solo"), (2, "Solo"), (3, None)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, row int, items string")
    items = spark.createDataFrame([(7, passage), (None, "solo"), (None, None)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.decontamination(docs, items).collect()))
    assert got == [(0, 1, 0, 0, False), (0, 15, 15, 1, True), (1, 3, 0, 0, False), (1, 17, 15, 1, True), (2, 1, 1, 0, True), (2, 1, 1, 0, True), (3, 0, 0, 0, False)]
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == ["None", "clean words only", "nothing"]
