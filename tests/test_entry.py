"""Queries against their oracle at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from weftline import catalog

SF = "/root/testdata/sf0.001"


def _rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("" if v is None or v != v else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    assert _rows(catalog.QUERIES[name](spark, SF).toPandas()) == _rows(c.sql(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
