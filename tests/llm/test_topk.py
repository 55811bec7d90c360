"""Exact top-k search against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioframe.llm import topk
from folioframe.llm.queries import ORACLES, op12_exact_topk

SCHEMA = "vec_id long, embedding array<double>"


def usable(x):
    return x is not None and all(y is not None and math.isfinite(y) for y in x)


def brute(rows, step, k=5):
    rows = [(i, [math.floor(256 * y) for y in x]) for i, x in rows if usable(x)]
    found = []
    for a, (q, x) in enumerate(rows):
        if q is None or q % step:
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(u * v for u, v in zip(x, y, strict=True)))), i is None, i) for b, (i, y) in enumerate(rows) if b != a and len(x) == len(y)]
        found += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return found


def search(spark, rows, step):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "dim", "at", "pos", "run", "block", "length", "least", "score")}).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % step == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(rng, n, dim, spread=1.0):
    base = [rng.gauss(0, 1) for _ in range(dim)]
    out = []
    for i in range(n):
        length = math.exp(rng.gauss(0, spread))
        x = [b * rng.random() + 0.4 * rng.gauss(0, 1) for b in base] if rng.random() < 0.5 else [rng.gauss(0, 1) for _ in range(dim)]
        out.append((i, [length * y / math.sqrt(sum(v * v for v in x)) for y in x]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 1 << 13)  # many runs and blocks
    rng = random.Random(seed)
    rows = vectors(rng, 1500, 24, spread=seed - 1.0)
    rows += [(20_000 + i, rows[0][1]) for i in range(700)]  # a hot vector, asked for and found
    rows += [(i, rows[i][1]) for i in range(0, 60, 10)]  # repeated rows
    rows += [(50, rows[3][1]), (None, rows[5][1]), (None, [50.0] * 24), (-50, [-50.0] * 24), (100, None), (150, [None] * 24), (200, [math.nan] + [1.0] * 23), (7, [math.inf] + [1.0] * 23)]
    rows += [(250, []), (251, []), (300, [1.0]), (350, [2.0, 1.0]), (351, [3.0, -1.0]), (400, [0.0] * 24)]
    assert search(spark, rows, 50) == sorted(brute(rows, 50), key=str)


def test_scores_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e6, 3e7, 1e9]) * rng.gauss(0, 1) for _ in range(9)]) for i in range(300)] + [(900, [1e300] * 9), (901, [-1e300] * 9), (902, [1e-300] * 9)]
    assert search(spark, rows, 50) == sorted(brute(rows, 50), key=str)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [0.0, 0.0]), (1, [0.0, 0.0])]])
def test_small_tables(spark, rows):
    assert search(spark, rows, 50) == sorted(brute(rows, 50), key=str)


def test_partial_sums_prune(spark, monkeypatch):
    """With a few strong directions, little is computed exactly."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(6000, 6)) @ rng.normal(size=(6, 48)) + 0.05 * rng.normal(size=(6000, 48))))
    length = np.sqrt((x**2).sum(axis=1))
    order = np.argsort(-length)
    x, length = x[order], length[order]
    c = pd.DataFrame({"id": pd.Series(range(6000), dtype="Int64"), "x": list(x), "dim": 48, "length": length, "at": range(6000), "pos": range(6000)})
    q = c.iloc[::60].assign(least=-np.inf)
    _, _, v = np.linalg.svd(x[:2000])
    seen = []
    monkeypatch.setattr(topk._Best, "add", lambda self, query, *a, add=topk._Best.add: (seen.append(len(query)), add(self, query, *a))[1])
    got = topk._tile(q, c, 5, {48: (np.ascontiguousarray(v.T), 6, 8)})
    s = x[::60] @ x.T
    s[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
    want = [(i * 60, j, int(s[i, j])) for i in range(100) for j in np.lexsort((np.arange(6000), -s[i]))[:5]]
    assert sorted(zip(got["query_at"], got["vec_id"], got["score"], strict=True)) == sorted(want)
    assert sum(seen) < 0.2 * s.size


def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = op12_exact_topk(spark, sf)
    cur = con.execute(ORACLES["op12_exact_topk"])
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    assert sorted(tuple(r[i] for i in at) for r in cur.fetchall()) == sorted(tuple(r) for r in got.collect())
