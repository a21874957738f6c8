"""The whole pipeline on planted rows, odd rows and empty tables."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import line_dedup
from lexmill.llm.queries import vocabulary_path
from tests.llm.test_dedup import brute_components, brute_hits, brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id int, `start` string, row int, k1 string"


def write(spark, folder, docs, labels, benchmark):
    rows = [(i, t, "en", s, None if t is None else len(t), 1, "x", 2, None) for i, t, s in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def planted():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    bad = ["zqscum", "zqidiot", "zqvermin", "zqfilth", "zqloathe"]
    text = lambda n: rng.choices(vocabulary, k=n)
    benchmark = [(i, " ".join(text(rng.choice([4, 20, 40])))) for i in range(12)]
    docs, toxic = [], set()
    for i in range(420):
        words = text(rng.randint(30, 120))
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append([i, " ".join(words), f"site {i % 30}"])
    for i in range(1, 420, 7):
        docs[i][1] += "\nAll rights reserved by the owners of this site."
    for i in range(500, 540):  # near copies of clean documents
        base = docs[rng.choice([x for x in range(420) if x not in toxic])][1].split(" ")
        base[rng.randrange(len(base))] = "changed"
        docs.append([i, " ".join(base), "site 1"])
    for i in range(600, 620):  # a benchmark passage in the middle
        docs.append([i, " ".join([*text(40), benchmark[i % 12][1].upper(), *text(40)]), "site 2"])
    docs += [[700, None, "site 3"], [701, "", None], [702, " \n\t", "site 3"], [703, "same id twice", "s"], [703, "same id twice", "s"], [704, "word " * 20_000, "s"]]
    labels = [(i, 1, int(i in toxic)) for i in range(0, 420) if i % 4 != 3] + [(9999, 0, 1), (None, 1, 1), (5, 1, None)]
    return docs, toxic, labels, benchmark


def test_pipeline_on_planted_rows(spark, tmp_path):
    docs, toxic, labels, benchmark = planted()
    sf = write(spark, tmp_path, docs, labels, benchmark)
    clean = [tuple(d) for d in docs if d[0] not in toxic]
    text = brute_lines(clean, line_dedup.SITES)
    kept = {d for d, v in brute_components(list(text.items())).items() if v[2]}
    hits = brute_hits([(d, text[d]) for d in kept if d != 704], benchmark)
    want = {d: text[d] for d in kept if d == 704 or not hits[d][3]}
    assert {i for i in range(600, 620) if benchmark[i % 12][1].count(" ") > 12}.isdisjoint(want) and len(want) <= len(clean) - 40
    library = Tokenizer.from_file(vocabulary_path())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r["ids"] for r in rows} == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in want.items()}
    assert sorted(r.doc_id for r in rows) == sorted([*want, 703])


def test_stages_keep_the_columns(spark, tmp_path):
    docs, _, labels, benchmark = planted()
    sf = write(spark, tmp_path, docs[:60] + docs[-6:], labels, benchmark)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf)
        assert table.columns == re.findall(r"`?(\w+)`? \w+(?:, |$)", DOCS), name
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).columns[0] == "doc_id"


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, "a b c", "s"), (None, "a b c", "s")]])
def test_pipeline_on_empty_tables(spark, tmp_path, docs):
    sf = write(spark, tmp_path, docs, [], [])
    assert corpus_pipeline.run(spark, sf).count() == len(docs)
