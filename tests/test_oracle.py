"""Every query of the sensor engine against its SQL oracle on the driver's tables."""

import math
import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

from tidewatch.plans import catalog, decisions  # noqa: E402, F401


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else str(r[i]) for i in order))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(found.fetchall(), names)
    else:
        assert df.columns
