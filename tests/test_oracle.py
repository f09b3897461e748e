"""Every query of the radar engine against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from squall.plans import registry

DATA = "/root/testdata/sf0.001"
#: Slow to repeat here; run with the others at a larger size.
HEAVY = {"g02_gaussian", "g01_median3x3"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return f"{round(float(v), 6) + 0.0:.6f}"
        return str(v)

    return [columns[k] for k in order], sorted([plain(r[k]) for k in order] for r in values)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - HEAVY))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(registry.ORACLES[name])
    want = rows([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 140
