"""Toxicity, quality rules and personal data."""

import random
import re

import numpy as np
import pyarrow as pa

from lexmill.llm import kernels, pii, quality, toxicity
from lexmill.session import read_table

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    held = labels.where("doc_id % 2 = 0")
    model = toxicity.train(docs, toxicity.grades(labels.where("doc_id % 2 = 1")))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).join(held, "doc_id").select("toxic", "rejected").toPandas()
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert clean.rejected.mean() < 0.01 and toxic.rejected.mean() > 0.8


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 900)
    feature, offsets = [], [0]
    for g in grade:
        feature += [1, *([2] if g >= 1 else []), *([3] if g >= 2 else [])]
        offsets.append(len(feature))
    f, o = np.array(feature), np.array(offsets)
    model = toxicity.fit(f, o, grade, bits=4)
    s = model.severity(f, o)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert s[grade == 0].max() < s[grade == 1].min() < s[grade == 1].max() < s[grade == 2].min()


def _docs(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "idiot scum " * 30, "b"), (3, "idiot scum " * 30, "b"), (None, "x y z", None), (5, "ok " * 20000, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, grade string")


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (9, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(_docs(spark), labels)
    assert got.count() == 6
    assert toxicity.toxicity(_docs(spark), labels, keep=True).columns == ["doc_id", "text", "grade"]
    none = toxicity.toxicity(_docs(spark), labels.limit(0))
    assert none.where("rejected").count() == 0 and none.count() == 6
    assert toxicity.toxicity(_docs(spark).limit(0), labels).count() == 0


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            cover.update(j for i in v for j in (i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_rules_equal_brute_force():
    random.seed(2)
    texts = ["".join(random.choice(["a", "b", "é ", " ", "\n", "#", "a b a b\n", "日", "\t", "x|"]) for _ in range(random.randint(0, 40))) for _ in range(800)] + ["", None, "a " * 5000]
    data, offsets = kernels.buffers(pa.array(texts))
    for limit in (64, 5000, 1 << 20):
        got = []
        for _, _, d, o in kernels.slices(data, offsets, limit):
            r = quality.rules(d, o)
            got += zip(*(r[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
        assert got == [brute_rules(t or "") for t in texts]


def test_quality_separates_labels(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = quality.quality(docs, labels.where("quality = 1 and doc_id % 2 = 1").select("doc_id")).join(labels.where("doc_id % 2 = 0"), "doc_id").select("quality", "base_failed", "score", "kept").toPandas()
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.2


def test_quality_odd_rows(spark):
    got = {(r.doc_id, r.n_words): r for r in quality.quality(_docs(spark), spark.createDataFrame([(5,), (None,)], "doc_id long")).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept and got[None, 3].word_chars == 3
    assert quality.quality(_docs(spark).limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_brute_force():
    random.seed(3)
    for alphabet in ("ab.@-+ 19", "0123456789 -", "1.25@a.", "+1 ()-.95"):
        for _ in range(5000):
            t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 30)))
            assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("a" * 100_000 + "1@") == []


def test_method_adds_spans_and_keeps_base(spark):
    rows = [(i, f"call tel (212) 555-01{i:02d} or password=ab12cd34ef56gh{i:02d} mail x{i}@y.org version 3.0") for i in range(30)]
    rows += [(100, None), (101, ""), (None, "a@b.co"), (102, "plain words 3.0 and 12"), (102, "plain words 3.0 and 12")]
    got = {r.doc_id: r for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_email == 1 and "phone:" in got[0].spans and "secret:" in got[0].spans and "email:" in got[0].spans
    assert got[100].spans == got[101].spans == got[102].spans == "" and got[None].spans == "email:0:6"
    assert pii.pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_finds_the_unreliable_labeler():
    counts = {}
    random.seed(1)
    for _ in range(3000):
        truth = random.random() < 0.5
        good = lambda p: (1 if truth else -1) * (1 if random.random() < p else -1)  # noqa: B023, E731
        key = (4, good(0.95), good(0.9), good(0.9), good(0.52), 0, 0, 0, 0, 0)
        counts[key] = counts.get(key, 0) + 1
    _, found = pii.estimate(counts)
    assert found[0][0] - found[0][1] > 0.7 > 0.3 > found[3][0] - found[3][1]
