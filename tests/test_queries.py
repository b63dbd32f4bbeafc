"""Every registered query against its DuckDB text, and the others for rows, at the smallest scale."""

import decimal
import math

import duckdb
import pytest
from pyspark.sql import Row

import __spark_entry__  # noqa: F401
from tarmac.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    """A value as both engines give it: numbers rounded, rows and structs as tuples, absent numbers as None."""
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    if isinstance(v, Row):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items())) if not all(isinstance(k, str) for k in v) else tuple(plain(x) for x in v.values())
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else bytes(v) if isinstance(v, bytearray) else v


def sorted_rows(names, rows):
    """Rows with their columns by name, sorted; numbers of all kinds sort and compare as numbers."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: (0, 0, "") if v is None else (1, v, "") if isinstance(v, (int, float)) else (2, 0, repr(v))
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(name, spark, data, duck):
    mine, theirs = QUERIES[name](spark, data), duck.sql(ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert sorted_rows(mine.columns, mine.collect()) == sorted_rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, data):
    assert len(QUERIES[name](spark, data).collect()) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
