"""Every query against the SQL registered for it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillpack.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert list(got.columns)
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    texts = lambda df: sorted(tuple("" if v != v or v is None else repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert texts(got) == texts(want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
