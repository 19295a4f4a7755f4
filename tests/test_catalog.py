"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from contourflow.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[x[i] for i in order] for x in rows], key=lambda r: [(v is None, str(round(v, 4)) if isinstance(v, float) else str(v)) for v in r])


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want, have = plain(cur.fetchall(), columns), plain([tuple(r) for r in got.collect()], got.columns)
    assert len(have) == len(want)
    for x, y in zip(have, want, strict=True):
        assert all(map(same, x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
