"""Every core query runs on the smallest tables and agrees with its SQL."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from lexiloom.plans import columns, pages, problems, reference, trips, work

DIR = "/root/testdata/sf0.001"
MODULES = (problems, reference, columns, pages, work, trips)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="needs the test tables")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x if isinstance(x, (bool, int, str)) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
        assert got == expected


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
