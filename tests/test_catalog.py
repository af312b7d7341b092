"""Every catalog query against its SQL statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_file
from asterism.plans.catalog import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    yield con
    con.close()


def canonical(rows):
    return sorted(rows, key=lambda r: tuple((v is None, "" if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, tables, name):
    df = entry_file.queries()[name](spark, tables)
    names = sorted(df.columns)
    got = canonical(tuple(r[c] for c in names) for r in df.collect())
    assert got
    rel = duck.sql(entry_file.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == canonical(tuple(r[i] for i in at) for r in rel.fetchall())


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["id", "cluster", "text_md5", "x", "y"] and df.count() > 0
