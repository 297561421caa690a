"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from sparkdoc import suite

HERE = "/root/testdata/sf0.001"
QUERIES, SQL = suite.all_queries()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not os.path.isdir(HERE), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    df = QUERIES[name](spark, HERE)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for t in suite.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{HERE}/{t}.parquet')")
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
