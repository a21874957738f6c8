"""Every query with a DuckDB equivalent gives its rows; the others run."""

import os

import duckdb
import pytest

from lexmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def rows(table):
    return sorted(str(sorted(r.items())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toArrow()
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
