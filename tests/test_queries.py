import glob
import os

import pytest

import __spark_entry__ as entry
from kinsieve import queries


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in queries.oracle_sql():
        result = duck.execute(queries.oracle_sql()[name])
        order = [[d[0] for d in result.description].index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_entry_and_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(entry.SMALL):
        assert entry.entry(spark).count() >= 0


def test_core_stands_alone():
    """Nothing outside the subpackage of training-data operators imports it."""
    folder = os.path.dirname(os.path.abspath(queries.__file__))
    for path in glob.glob(f"{folder}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "kinsieve.llm" not in open(path, encoding="utf-8").read(), path
