"""The Merkle manifest against a recursive statement of it."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioframe.llm import merkle
from folioframe.llm.queries import ORACLES, op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of nodes, and each one's proof as (before, after)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            a = at[i] - at[i] % 8
            p.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + 8])))
            at[i] //= 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in order:
        groups[g].sort()
        subs.append(climb([x[1] for x in groups[g]]))
    if not subs:
        return []
    root, tops = climb([s[0] for s in subs])
    return [(x[2], x[1], sub, root, p + top) for g, (sub, proofs), top in zip(order, subs, tops, strict=True) for x, p in zip(groups[g], proofs, strict=True)]


def corpus(n, langs, rng):
    rows = [(i, rng.choice(["a", "", None]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "É\U0001f600A" * rng.randrange(4), "Straße ABC z"])) for i in range(n)]
    return rows + rows[:9] + [(None, "x", langs[0], 1, "t"), (None, "x", langs[0], 1, None), (3, "other", langs[0], 0, "T"), (-5, "n", langs[-1], 5, "x" * 300_000)]


@pytest.mark.parametrize(("n", "langs"), [(1500, ["vi", "en", None, "é", "z"]), (4700, ["vi"]), (40, [f"l{i}" for i in range(600)]), (0, ["vi"])])
def test_manifest_is_the_recursion(spark, n, langs):
    rows = corpus(n, langs, random.Random(n))
    if n == 40:
        rows = [(i, None, lang, i, "t") for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("g", "pos", "at", "total", "node", "more", "proof")}).repartition(5)
    got = merkle.manifest(df, keep={"size": F.length("text")})
    assert got.columns == ["doc_id", "lang", "leaf", "place", "subroot", "root", "proof", "size"]
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got.collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty_table_gives_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_found(spark, tmp_path):
    rows = corpus(900, ["vi", "en", None], random.Random(2))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want, changed = [], {}
    for r in rows:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            changed[leaf(r)] = leaf((*r[:4], r[4].translate(low)))
    for i, x, sub, root, proof in brute(rows):
        node = changed.get(x, x)
        for before, after in proof:
            node = h(before, node, after)
        want.append((i, x, sub, root, h(*(a + b for a, b in proof)), node, node == root))
    got = op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op11_merkle_manifest(spark, sf)
    cur = con.execute(ORACLES["op11_merkle_manifest"])
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    assert sorted(tuple(r[i] for i in at) for r in cur.fetchall()) == sorted(tuple(r) for r in got.collect())
