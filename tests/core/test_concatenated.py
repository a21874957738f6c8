"""Digests of concatenated groups of any size."""

import hashlib

from pyspark.sql import functions as F

from lexmill.operators import sequences
from lexmill.plans import table_queries

KINDS = {"texts": (str.encode, b"\n\n"), "tokens": (sequences.characters, b" ")}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_of_odd_groups(spark, tmp_path):
    rows = [(3, "a", "drei"), (1, "a", "é 日🎉"), (2, "a", None), (4, "a", ""), (5, "b", None), (6, "c", ""), (7, None, "x"), (8, None, "yz"), (None, "a", "last")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: (r.texts, r.tokens) for r in table_queries.i1_i3_ordered_concat(spark, str(tmp_path)).collect()}
    assert got == {
        "a": (digest("é 日🎉\n\ndrei\n\n\n\nlast"), digest("é   日 🎉 d r e i l a s t")),
        "b": (None, None),
        "c": (digest(""), None),
        None: (digest("x\n\nyz"), digest("x y z")),
    }


def test_digests_are_those_of_the_concatenated(spark):
    rows = spark.range(3_000).selectExpr("id", "id % 5 AS g", "id % 2 AS h", "concat('Wort ', id * 7919 % 3000, repeat(' ü', int(id % 9))) AS t").repartition(6)
    whole = sequences.concatenated(rows, ["g", "h"], "id", "t", "\n\n").withColumn("texts", F.sha2("t", 256)).select("g", "h", "texts")
    lists = sequences.concatenated(rows.withColumn("l", F.split("t", "")), ["g", "h"], "id", "l").withColumn("tokens", F.sha2(F.array_join("l", " "), 256)).select("g", "h", "tokens")
    got = sequences.concatenated_sha256(rows, ["g", "h"], "id", "t", KINDS)
    assert sorted(map(tuple, got.select("g", "h", "texts").collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, got.select("g", "h", "tokens").collect())) == sorted(map(tuple, lists.collect()))
    assert sequences.concatenated_sha256(rows.limit(0), ["g"], "id", "t", KINDS).count() == 0


def test_a_group_larger_than_a_row(spark, tmp_path):
    """Its list of characters alone would take more than an array may."""
    rows = spark.range(150, numPartitions=4).selectExpr("id AS doc_id", "'en' AS lang", "repeat(char(97 + int(id % 26)), 1000000) AS text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = table_queries.i1_i3_ordered_concat(spark, str(tmp_path)).collect()
    texts, tokens = hashlib.sha256(), hashlib.sha256()
    for i in range(150):
        c = chr(97 + i % 26)
        texts.update(("\n\n" * (i > 0) + c * 1_000_000).encode())
        tokens.update((" " * (i > 0) + " ".join(c * 1_000_000)).encode())
    assert (got.lang, got.texts, got.tokens) == ("en", texts.hexdigest(), tokens.hexdigest())
