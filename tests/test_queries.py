"""Every query against its SQL twin in DuckDB, with rows to compare."""

import glob
import os

import duckdb
import pytest

from evidentia.plans.registry import ORACLES, QUERIES



@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame = frame.assign(**{c: frame[c].round(5) + 0.0})
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple("" if x is None else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got), "an empty result proves nothing"
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
