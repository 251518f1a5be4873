import glob
import os

import pytest

from kinsieve.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    import duckdb

    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        result = con.execute(queries.oracle_sql()[name])
        order = [[d[0] for d in result.description].index(c) for c in columns]
        assert got == sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())
