"""Every query of the catalog on the smallest data set: it runs, and equals its SQL twin where it has one."""

import glob
import math
import os

import duckdb
import pytest

from lexiflow.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def flat(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = sorted(tuple(flat(v) for v in r) for r in df.select(*cols).collect())
    if name in catalog.SQL:
        cur = con.execute(catalog.SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(flat(r[i]) for i in at) for r in cur.fetchall())
    else:
        assert rows
