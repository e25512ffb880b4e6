"""Every registered query with SQL equals DuckDB on the same tables."""

import decimal
import math
import os

import duckdb
import pytest

from pointloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, db, name):
    df = registry.queries()[name](spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got
    sql = registry.oracle_sql().get(name)
    if sql:
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        assert got == sorted((tuple(plain(dict(zip(columns, r, strict=True))[n]) for n in names) for r in found.fetchall()), key=repr)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
