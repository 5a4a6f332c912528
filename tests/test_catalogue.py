"""Every query against its SQL on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from docketry.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(row):
    return repr(tuple(None if x is None or x != x else float(x) if hasattr(x, "dtype") and x.dtype.kind == "f" else int(x) if hasattr(x, "dtype") and x.dtype.kind in "iu" else x for x in row))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.toPandas()[columns]
    if name not in catalogue.ORACLE:
        assert len(got)
        return
    want = con.execute(catalogue.ORACLE[name]).df()
    assert sorted(want.columns) == columns
    rows = lambda f: sorted(map(plain, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())
