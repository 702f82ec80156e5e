"""Every query with an oracle is held against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from sessionloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple("" if r[i] is None else str(r[i]) for i in at) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, df.collect()) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
