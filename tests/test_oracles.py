"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sample):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sample}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, sample, name):
    df = registry.QUERIES[name](spark, sample)
    columns = sorted(df.columns)
    rel = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted_rows([[r[k] for k in order] for r in rel.fetchall()])
    assert sorted_rows(df.select(*[f"`{c}`" for c in columns]).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, sample, name):
    assert registry.QUERIES[name](spark, sample).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
