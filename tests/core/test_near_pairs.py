"""Pairs of vectors and their copies, where other vectors are near each other as well."""

from pathlib import Path

import numpy as np
import pytest

from lexmill.operators import dedup
from lexmill.plans import table_queries
from lexmill.session import shared_dir


def table(spark, place, ids, vectors):
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{place}/embeddings.parquet")


def test_only_a_vector_and_its_own_copy(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = base + rng.normal(size=base.shape) * 0.05
    ids = [*range(30), *range(1_000_000, 1_000_010), *range(100, 140), *range(-5, 0)]
    table(spark, tmp_path, ids, np.concatenate([base, near, np.repeat(base[:1], 5, 0)]))
    got = sorted(map(tuple, table_queries.d8_near_pairs(spark, str(tmp_path)).collect()))
    assert got == sorted((i, i + 1_000_000, 1.0) for i in ids)


@pytest.mark.parametrize("bits,kind", [(3, "float"), (3, "double"), (17, "double")])
def test_buckets_of_one_block_and_of_several(spark, bits, kind):
    """Few bits make buckets larger than a block, many need wider keys; each pair comes once."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12))
    v = np.concatenate([base, base * 3, base[:20] + rng.normal(size=(20, 12)) * 0.02]).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"vec_id long, embedding array<{kind}>").repartition(4)
    exact = sorted((r.i, r.j) for r in dedup.similar_pairs(rows, 0.99).collect())
    found = sorted((r.i, r.j) for r in dedup.near_pairs(rows, 0.99, bits=bits, block=20).collect())
    assert len(exact) >= 100 and len(found) == len(set(found)) and set(found) <= set(exact)
    assert found == exact if bits == 3 else {(i, i + 60) for i in range(60)} <= set(found)


def test_vectors_are_written_once_for_each_bucket(spark):
    """What the buckets write to the shared folder stays near the vectors themselves."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(2_000, 64)))], "vec_id long, embedding array<float>")
    place = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in place.rglob("*.parquet"))
    before = size()
    assert dedup.near_pairs(rows, 0.85).count() == 0
    assert size() - before < 4 * 2_000 * 64 * 4


def test_null_and_no_vectors(spark):
    rows = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in dedup.near_pairs(rows, 0.85).collect()] == [(2, 3, 1.0)]
    assert dedup.near_pairs(rows.limit(0), 0.85).count() == 0
