"""Every query of the core against its SQL, on the smallest test data."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")

from strandline.plans import registry  # noqa: E402


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def rows_of(spark):
    """Rows of every query, some at a time: name to a future of (columns, rows)."""

    def run(name):
        df = registry.queries()[name](spark, DATA)
        names = sorted(df.columns)
        return names, [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in registry.queries()}
        pool.shutdown(cancel_futures=True)


def test_names():
    assert set(registry.oracle()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(registry.oracle()))
def test_query(rows_of, con, name):
    names, rows = rows_of[name].result()
    got = Counter(tuple(plain(v) for v in r) for r in rows)
    r = con.execute(registry.oracle()[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == names
    want = Counter(tuple(plain(row[at.index(n)]) for n in names) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle()])
def test_runs(rows_of, name):
    assert rows_of[name].result()[0]
