"""Operator 9: embedding near-dedup with randomised-rotation binary codes.

Each distinct vector is rotated at random and coded once: its signs, packed; its correction factor, the
inner product of the code with the rotated unit vector; and the rotated vector in one byte a component, as a
query. code . query / factor estimates an inner product without bias, and its error is bounded with confidence by
SIGMAS * sqrt((1 - f^2) / f^2 / (d - 1)) and what the query's rounding can add. Codes and factors are what the tables hold and ship.

Signs also index the vectors: each of several tables buckets all vectors by some
of their signs, as many tables as find a pair at the threshold with probability
1 - MISS. The number of signs grows with the logarithm of the table, so buckets stay
small; larger ones are cut into blocks and every pair of blocks is compared, so no
bucket has a cap. In a bucket the codes' differing bits, counted, and then the estimates of both
directions rule pairs out. Only the vectors of pairs that are left are fetched, by a join, and
recomputed in double precision, tile by tile, so that no pairs are emitted. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk
from folioframe.llm.shared import components, cut, few

MISS = 0.001
SIGMAS = 4.0
BUCKET = 256
BLOCK = 1024


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; None where it is null, empty, zero, or holds null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    holes = np.asarray(flat.is_null()) if flat.null_count else None
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    valid = np.asarray(column.is_valid())
    sizes = np.where(valid, np.asarray(column.value_lengths().fill_null(0)), 0)
    ends = np.cumsum(sizes)
    out: list[np.ndarray | None] = []
    for a, b, ok in zip(ends - sizes, ends, valid, strict=True):
        v = values[a:b]
        good = ok and b > a and (holes is None or not holes[a:b].any()) and np.isfinite(v).all() and v.any()
        out.append(v if good else None)
    return out


def _digest(batches):
    """(id, cid, v): cid names equal vectors and is null for those that link with nothing; v: doubles."""
    for b in batches:
        cid, v = [], []
        for x in vectors(b.column("v")):
            if x is None:
                cid.append(None)
                v.append(None)
                continue
            x = x + 0.0  # one zero
            bits = tk.mix(x.view(np.uint64) + tk.mix(np.arange(len(x), dtype=np.uint64)))
            cid.append(int(tk.mix(bits.sum(keepdims=True)).view(np.int64)[0]))
            v.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cid, pa.int64()), pa.array(v, pa.binary())], ["id", "cid", "v"])


@functools.lru_cache(maxsize=64)
def rotation(d: int, seed: int) -> np.ndarray:
    """The same in every process, and made once in each."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(signs per key, tables) for n distinct vectors."""
    bits = min(24, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))
    if not bits:
        return 0, 1
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, (1 if same >= 1 else math.ceil(math.log(MISS) / math.log(1 - same)))


def table_keys(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Keys (rows, tables) from the signs of randomly rotated vectors, `bits` signs each."""
    d = x.shape[1]
    need = max(1, bits * tables)
    signs = np.concatenate([x @ rotation(d, seed + 1 + r).T > 0 for r in range(math.ceil(need / d))], axis=1)[:, :need]
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in blobs])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Codes:
    """Signs (packed and as -1 and 1), correction factors and byte queries of vectors of d components."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, query: np.ndarray, scale: np.ndarray):
        self.packed = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1)
        self.signs, self.factor, self.query, self.scale = signs, factor, query, scale

    @staticmethod
    def of(x: np.ndarray, seed: int) -> Codes:
        """Of unit vectors."""
        r = x @ rotation(x.shape[1], seed).T
        scale = np.abs(r).max(axis=1) / 127
        return Codes(r > 0, np.abs(r).sum(axis=1) / math.sqrt(x.shape[1]), np.rint(r / scale[:, None]).astype(np.int8), scale)

    @staticmethod
    def read(blobs: list[bytes], d: int) -> Codes:
        """From their stored form."""
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        n = -(-d // 64) * 8
        signs = np.unpackbits(raw[:, :n], axis=1, count=d).astype(bool)
        figures = raw[:, n : n + 16].copy().view(np.float64)
        return Codes(signs, figures[:, 0], raw[:, n + 16 :].view(np.int8), figures[:, 1])

    def blobs(self) -> list[bytes]:
        figures = np.stack([self.factor, self.scale], axis=1).view(np.uint8)
        return [x.tobytes() for x in np.hstack([self.packed, figures, self.query.view(np.uint8)])]

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of i, as codes, with j, as queries."""
        d = self.signs.shape[1]
        dot = np.where(self.signs[i], self.query[j], -self.query[j]).sum(axis=1, dtype=np.int64)
        f = self.factor[i]
        error = SIGMAS * np.sqrt(np.maximum(0.0, 1 - f**2) / max(1, d - 1)) + math.sqrt(d) * self.scale[j] / 2
        return (dot * self.scale[j] / math.sqrt(d) + error) / f + 1e-9

    def undecided(self, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of p with q that neither the count of differing bits nor an estimate rules out."""
        d, words = self.signs.shape[1], self.packed.view(np.uint64)
        apart = math.acos(min(1.0, threshold)) / math.pi
        most = d * apart + SIGMAS * math.sqrt(d * apart * (1 - apart))
        differ = np.zeros((len(p), len(q)), np.uint16)
        for w in range(words.shape[1]):
            differ += np.bitwise_count(words[p, w][:, None] ^ words[q, w][None, :])
        i, j = np.nonzero(differ <= most)
        i, j = p[i], q[j]
        i, j = i[i != j], j[i != j]
        keep = [np.zeros(0, bool)]
        for a in range(0, len(i), 1 << 14):
            b, c = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            keep.append((self.upper(b, c) >= threshold) & (self.upper(c, b) >= threshold))
        ok = np.concatenate(keep)
        return i[ok], j[ok]


def _index(bits: int, tables: int, seed: int):
    """(bucket, slot, cid, copies, d, code): a row for each vector and table."""

    def run(batches):
        for b in batches:
            for c in range(0, b.num_rows, 2000):
                part = b.slice(c, 2000)
                blobs = part.column("v").to_pylist()
                dims = np.array([len(v) for v in blobs]) // 8
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    x = _unit([blobs[i] for i in rows])
                    keys = table_keys(x, bits, tables, seed)
                    names = tk.mix(keys.astype(np.uint64) + tk.mix(np.arange(tables, dtype=np.uint64) + np.uint64(int(d) << 20))[None, :])
                    again = pa.array(np.repeat(np.arange(len(rows)), tables))
                    own = part.take(pa.array(rows)).take(again)
                    codes = pa.array(Codes.of(x, seed).blobs(), pa.binary()).take(again)
                    yield pa.RecordBatch.from_arrays(
                        [tk.long(names.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), own.column("cid"), own.column("copies"), pa.array(np.full(len(again), d, np.int32)), codes],
                        ["bucket", "slot", "cid", "copies", "d", "code"],
                    )

    return run


def _sides(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a tile compares: all with all, if all are on the left, else the left ones with the others."""
    every = np.arange(len(left))
    return (every, every) if left.all() else (np.flatnonzero(left), np.flatnonzero(~left))


def _rule_out(threshold: float):
    """Rows sorted by tile: those that are in a pair that the codes can't rule out."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        p, q = _sides(t.column("left").to_numpy())
        if t.num_rows < 2 or not len(p) or not len(q):
            return None
        codes = Codes.read(t.column("code").to_pylist(), int(t.column("d")[0].as_py()))
        live = np.unique(np.concatenate(codes.undecided(p, q, threshold)))
        return t.select(["tile", "slot", "cid", "copies", "left"]).take(live).combine_chunks().to_batches()[0] if len(live) else None

    return _by_tile(solve)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with cosine >= threshold, in double precision."""
    i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
    keep = [np.zeros(0, bool)]
    for a in range(0, len(i), 1 << 16):
        keep.append(np.einsum("ij,ij->i", x[i[a : a + (1 << 16)]], y[j[a : a + (1 << 16)]]) >= threshold)
    ok = np.concatenate(keep)
    return i[ok], j[ok]


def _compare(threshold: float, bits: int, tables: int, seed: int):
    """Rows sorted by tile: (a, b, n): n linked vectors for class a, or an edge a, b of a spanning forest."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        cid, left, copies = (t.column(c).to_numpy() for c in ("cid", "left", "copies"))
        slot = int(t.column("slot")[0].as_py())
        x = _unit(t.column("v").to_pylist())
        keys = table_keys(x, bits, tables, seed)
        one = bool(left.all())
        p, q = _sides(left)
        if len(cid) < 2 or not len(p) or not len(q):
            return None
        i, j = linked_pairs(x[p], x[q], threshold)
        i, j = p[i], q[j]
        ok = (i < j) if one else np.ones(len(i), bool)
        if slot:
            ok &= ~(keys[i, :slot] == keys[j, :slot]).any(axis=1)
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        add = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
        label = np.arange(len(cid))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        has, tied = np.flatnonzero(add > 0), np.flatnonzero(label != np.arange(len(cid)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([cid[has], cid[tied]])),
                pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(cid[label[tied]])]),
                pa.array(np.concatenate([add[has], np.zeros(len(tied))]).astype(np.int64)),
            ],
            ["a", "b", "n"],
        )

    return _by_tile(solve)


def _by_tile(solve):
    """Rows sorted by tile, all of a tile's to solve."""

    def run(batches):
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and tile[i] != name:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                name = tile[i]
                held.append(batch.slice(i, j - i))
        if held and (out := solve(held)) is not None:
            yield out

    return run


def near_vectors(table: DataFrame, threshold: float = 0.95, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of the table: id_col, n_links (other rows linked directly), component_id
    (the least id reachable by links, its own included), kept (whether that is its own).

    Rows link if their cosine is at least the threshold. Null, empty and zero
    vectors and those with null or non-finite components link with nothing, and
    vectors of different lengths never link. Rows that repeat a vector link with
    each other. A null id is carried and names no component of rows that have
    ids; its kept is null where no id does. Ids must be integers or cast to them. Extra columns are not read; empty
    tables give no rows.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_digest, "id long, cid long, v binary")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = cut(classes)
    bits, tables = plan_tables(classes.count(), threshold)
    entries = classes.select("cid", "copies", "v").mapInArrow(_index(bits, tables, seed), "bucket long, slot int, cid long, copies long, d int, code binary")
    # large buckets, of over BLOCK vectors each, are cut into blocks
    large = cut(entries.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    entries = entries.join(few(large, large.count()), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    entries = entries.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    entries = entries.select(F.xxhash64("bucket", low, high).alias("tile"), "slot", "cid", "copies", (F.col("mine") == low).alias("left"), "d", "code")
    left = entries.repartition("tile").sortWithinPartitions("tile").mapInArrow(_rule_out(threshold), "tile long, slot int, cid long, copies long, left boolean")
    left = left.join(classes.select("cid", "v"), "cid")
    found = left.repartition("tile").sortWithinPartitions("tile").mapInArrow(_compare(threshold, bits, tables, seed), "a long, b long, n long")
    found = cut(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cid")
    roots = components(found.where("b is not null").select("a", "b"))
    c = classes.select("cid", "first_id", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    c = c.select("cid", "first_id", F.coalesce("root", "cid").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = c.groupBy("root").agg(F.min("first_id").alias("component"))
    c = c.join(least, "root").select("cid", "n_links", "component")
    out = rows.select("id", "cid").join(c, "cid", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
