"""Every query with SQL equals DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from tracklake import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


def rows(names, data):
    at = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view events as select * from read_parquet('{DIR}/events.parquet')")
    cur = db.execute(Q.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    df = Q.queries()[name](spark, DIR)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_entry_and_names():
    import __spark_entry__ as E

    assert set(Q.oracle_sql()) <= set(E.queries())
