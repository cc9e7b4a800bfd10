"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from termloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return x

    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(columns)
        want = plain(found.fetchall(), columns)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == b or all(x == y or isinstance(x, float) and abs(x - float(y)) < 2e-5 or not isinstance(x, str) and x is not None and y is not None and float(x) == float(y) for x, y in zip(a, b, strict=True)), (a, b)
    else:
        assert got is not None
