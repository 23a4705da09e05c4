"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def _names():
    import __spark_entry__ as entry

    return sorted(n for n in entry.queries() if n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        metafunc.parametrize("name", _names())


def test_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    assert got and "void" not in dict(df.dtypes).values()
    if name in (sql := entry.oracle_sql()):
        found = duck.execute(sql[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
