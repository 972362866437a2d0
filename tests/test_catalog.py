"""Every registered query against its DuckDB equivalent at the smallest scale."""

import math

import duckdb
import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return c


def rounded(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    rel = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted((tuple(rounded(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(rounded(r[cols.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert mine == theirs
