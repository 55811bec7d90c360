"""Cascading erasure against a plain statement of it, and the files it leaves."""

import datetime
import hashlib
import math
import os
import random
import zlib
from collections import Counter
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioframe.llm import erasure, shared
from folioframe.llm.queries import op13_cascading_erasure

SCHEMAS = {
    "clients": "client_id long, master_id long, source string, name string, balance double",
    "clicks": "click_id long, ts timestamp_ntz, client_id long, kind string, value double",
    "sales": "sale_id long, client_id long, status string, total double",
    "sale_lines": "sale_id long, line_no int, amount double, flag string",
}
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(v):
    return zlib.crc32(b"" if v is None else str(v).encode())


def ordered(v):
    """Nulls first, NaN last, as Spark sorts."""
    return (v is not None, isinstance(v, float) and math.isnan(v), 0 if v is None or (isinstance(v, float) and math.isnan(v)) else v)


def brute(tables):
    """(table, file_no): (n_rows, n_erased, cents, rewritten, ids_sha256, columns, rows), of tables as lists of dicts."""
    masters = {c["master_id"] for c in tables["clients"] if c["master_id"] is not None}
    clicks = Counter(c["client_id"] for c in tables["clicks"] if c["client_id"] is not None)
    own = {m: {c["client_id"] for c in tables["clients"] if c["master_id"] == m} for m in masters}
    victims = {m for m in masters if crc(m) % 100 == 0} | ({min(masters, key=lambda m: (-sum(clicks[c] for c in own[m]), m))} if masters else set())
    ids = {c["client_id"] for c in tables["clients"] if c["master_id"] in victims} - {None}
    sales = {s["sale_id"] for s in tables["sales"] if s["client_id"] in ids} - {None}
    owner = {}
    for s in tables["sales"]:
        if s["client_id"] is not None and s["sale_id"] is not None:
            owner[s["sale_id"]] = min(s["client_id"], owner.get(s["sale_id"], s["client_id"]))
    gone = {"clients": lambda r: r["master_id"] in victims or r["client_id"] in ids, "sale_lines": lambda r: r["sale_id"] in sales}
    out = {}
    for name, rows in tables.items():
        key = (lambda r: owner.get(r["sale_id"])) if name == "sale_lines" else (lambda r: r["client_id"])
        rows = sorted(rows, key=lambda r: (crc(key(r)), [ordered(v) for v in r.values()]))
        span = 1 + len(rows) // 150
        for f in range(math.ceil(len(rows) / span)):
            held = rows[f * span : (f + 1) * span]
            left = [r for r in held if not gone.get(name, lambda r: r["client_id"] in ids)(r)]
            if left:
                cents = sum(math.floor(100 * v + 0.5) for r in left if (v := r[AMOUNTS[name]]) is not None and not math.isnan(v))
                first = ["" if (v := next(iter(r.values()))) is None else str(v) for r in left]
                out[name, f] = (len(left), len(held) - len(left), cents, len(left) < len(held), hashlib.sha256(",".join(first).encode()).hexdigest(), ",".join(left[0]), left)
    return out


def local(url):
    return unquote(urlparse(url).path)


def compare(got, want):
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got} == {k: v[:-1] for k, v in want.items()}
    folders = {os.path.dirname(os.path.dirname(os.path.dirname(local(r.path)))) for r in got}
    for top in folders:  # nothing else is left
        there = {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if not f.startswith((".", "_"))}
        assert there == {local(r.path) for r in got}
    for r in got:
        rows = want[r.table_name, r.file_no][-1]
        f = pq.ParquetFile(local(r.path))
        assert str(f.read().to_pylist()) == str(rows)
        groups = [f.metadata.row_group(i).column(0).statistics for i in range(f.metadata.num_row_groups)]
        ids = [v for x in rows if (v := next(iter(x.values()))) is not None]
        if ids:
            assert (min(g.min for g in groups if g.has_min_max), max(g.max for g in groups if g.has_min_max)) == (min(ids), max(ids))


def shop(rng, n_clients, hot):
    clients = [{"client_id": rng.choice([i, i, None]) if i % 37 == 0 else i, "master_id": hot if i % 3 == 0 else rng.choice([i, None, i // 2]), "source": rng.choice(["crm", None]), "name": rng.choice(["É", "", None]), "balance": rng.choice([1.005, -2.5, None, math.nan])} for i in range(n_clients)]
    clients += clients[:5] + ([{**clients[1], "master_id": 999_999}] if n_clients else [])
    some = [0, None, *range(n_clients + 5)]
    day = datetime.datetime(2024, 1, 1)
    clicks = [{"click_id": i, "ts": day + datetime.timedelta(microseconds=i // 3), "client_id": 7 if i % 3 == 0 else rng.choice(some), "kind": rng.choice(["a", None]), "value": rng.choice([0.125, None, 3.3])} for i in range(8 * n_clients)]
    clicks += clicks[:20] * 2
    sales = [{"sale_id": None if i % 50 == 0 else i // 1 if i % 9 else i - 1, "client_id": 7 if i % 3 == 0 else rng.choice(some), "status": rng.choice(["done", None]), "total": 10.0 * i} for i in range(3 * n_clients)]
    lines = [{"sale_id": rng.choice([3, None, *range(3 * n_clients + 9)]), "line_no": rng.randrange(3), "amount": rng.choice([None, 1.115]), "flag": "x" * rng.choice([1, 9])} for _ in range(6 * n_clients)]
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}


@pytest.mark.parametrize(("n", "hot"), [(400, 42), (0, 1)])
def test_erasure_is_brute_force(spark, tmp_path, n, hot):
    tables = shop(random.Random(n), n, hot)
    for name, rows in tables.items():
        df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMAS[name])
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = op13_cascading_erasure(spark, str(tmp_path)).collect()
    want = brute(tables)
    compare(got, want)
    if n == 400:
        assert {k[0] for k, v in want.items() if v[3]} == set(tables) and not all(v[3] for v in want.values())


def test_untouched_files_stay_and_clashing_columns_are_kept(spark, tmp_path):
    df = spark.range(1000).select("id", F.lit("x").alias("file_no"), F.lit(1).alias("row"), (F.col("id") % 40).alias("hash"), F.lit(2).alias("a b"), F.lit(None).cast("double").alias("amount"))
    t = erasure.publish(df, F.col("hash"), "t", f"{tmp_path}/t", files=20)
    before = {r.file_no: r.path for r in t.read().select("file_no", "path").distinct().collect()}
    assert len(before) == 20 and not os.path.exists(f"{tmp_path}/t.sorting")
    values = spark.createDataFrame([(5,), (12,)], "v long")
    erased = erasure.erase(t, values.select(erasure.key_hash(F.col("v")).alias("hash")), [("hash", values)])
    assert sum(n for n, _ in erased.values()) == 50
    after = {r.file_no: r.path for r in t.read().select("file_no", "path").distinct().collect()}
    assert {f for f in before if before[f] != after.get(f)} == set(erased)
    assert t.read().select("row.*").columns == df.columns
    assert erasure.erase(t, values.select(erasure.key_hash(F.col("v")).alias("hash")), [("hash", values)]) == {}


def test_rows_of_other_masters_stay(spark, tmp_path):
    """Client 1 stands under the victim master 8, under 7 and under none: only the first of these rows goes, its clicks and sales all go."""
    rows = {
        "clients": [(1, 7, "a", "n", 1.0), (1, 8, "b", "n", 2.0), (1, None, "c", "n", 4.0), (2, 8, "d", "n", 8.0), (None, 7, "e", "n", 16.0), (None, 8, "f", "n", 32.0)],
        "clicks": [(i, None, 1 if i < 9 else None if i < 12 else 2, "k", 1.0) for i in range(13)],
        "sales": [(10, 1, "s", 1.0), (11, 2, "s", 1.0)],
        "sale_lines": [(10, 1, 1.0, "x"), (11, 1, 2.0, "x"), (12, 1, 4.0, "x")],
    }
    for name, table in rows.items():
        spark.createDataFrame(table, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert all(crc(m) % 100 for m in (7, 8))
    # both masters have client 1; 8 has client 2's click besides, so it is the busiest
    got = {(r.table_name, r.cents) for r in op13_cascading_erasure(spark, str(tmp_path)).collect()}
    assert got == {("clients", 100), ("clients", 400), ("clients", 1600), ("clicks", 100), ("sale_lines", 400)}


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    tables = {n: pq.read_table(f"{sf}/{n}.parquet").to_pylist() for n in SCHEMAS}
    compare(op13_cascading_erasure(spark, sf).collect(), brute(tables))


def test_places_are_dealt_over_tasks(spark):
    df = spark.range(3000).repartition(6).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 3 == 0, "g").alias("g"))
    got = shared.numbered(df, ["k"], ["g"]).collect()
    for g in (None, "g"):
        own = sorted((r.pos, r.k, r.total) for r in got if r.g == g)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {len(own)}
    assert len({r.at for r in got}) == 3000
