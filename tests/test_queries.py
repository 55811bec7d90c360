"""Every query with SQL against DuckDB on the smallest tables; the others against invariants."""

import math
import os
from collections import Counter

import duckdb
import pytest

from folioframe.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    assert sorted(c[0] for c in cur.description) == cols
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    batch = {(str(r.doc_id), r.result) for r in QUERIES["q_extract_batch"](spark, SF).collect()}
    assert {(r.doc_id, r.result) for r in QUERIES["q_stream_merge"](spark, SF).collect()} == batch
