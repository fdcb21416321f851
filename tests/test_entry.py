import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(entry._engine.QUERIES))
def test_engine_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got or name in ("vectors_to_add",)
    if name in entry.oracle_sql():
        sql = duck.sql(entry.oracle_sql()[name])
        assert got == sorted((tuple(map(plain, r)) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) and "select" in sql.lower() for sql in entry.oracle_sql().values())
