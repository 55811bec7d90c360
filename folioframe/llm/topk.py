"""Exact top-k by inner product, over vectors in descending length.

Components become the integers floor(scale * x), so scores are integers and ties
are real. Vectors of one dimension are sorted by descending length and dealt in
runs; queries are dealt in blocks. The run of the longest vectors gives each
query a first threshold (its k-th best score so far). By Cauchy-Schwarz no vector
of a run can score above |query| * the run's longest, so a query visits the runs
that may still beat its threshold, and no others. Within a run, chunks are taken
in descending length under the same rule; of the pairs left, the rotation of a
singular value decomposition puts most of a product into few coordinates, whose
partial sum plus the product of the residual lengths bounds the score from above.
What may still reach the threshold is computed exactly.

The rotation is fitted on a bounded sample and only decides how much is pruned:
results don't depend on it, and there is no cap on candidates.

Null vectors and those that hold null or non-finite components take no part.
Vectors of different dimensions have no product and aren't compared; empty ones
score 0 with each other. A row is a row: repeated rows and repeated ids are
candidates each, a query's own row isn't. Ties go to the smaller id, then null
ids. Scores are exact at any size and are cut at the ends of 64 bits. An empty
table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import cut, few, numbered, written

#: Components that a block of queries or a run of candidates holds at most (and 65,536 rows).
BLOCK = 1 << 22
#: Rows of the sample that the rotations are fitted on, and the least that a dimension needs for one of its own.
SAMPLE, LEAST = 4096, 64
#: Share of the squared length that the first and the second partial sums hold in the sample.
HEADS = (0.5, 0.85)
#: Queries and candidates that are multiplied at once.
QUERIES, CHUNK = 2048, 512
#: Below this, sums of integer products are exact in double precision.
EXACT = 2.0**53
#: Relative slack of bounds computed in double precision.
SLACK = 1e-9
LONG = np.iinfo(np.int64)

Rotations = dict[int, tuple[np.ndarray, int, int]]


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles that hold integers."""
    def one(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def _usable(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def fit_rotations(vectors: DataFrame) -> Rotations:
    """For each dimension with LEAST rows in the sample: the right singular vectors, and how many the two partial sums take."""
    rows = vectors.select("x").orderBy(F.xxhash64("x")).limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.x), []).append(r.x)
    found = {}
    for dim, sample in by_dim.items():
        a = np.array(sample)
        if dim < 8 or len(a) < LEAST or not np.isfinite(a).all() or np.abs(a).max() > 1e100:
            continue
        _, s, v = np.linalg.svd(a, full_matrices=True)
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        first, second = (int(np.searchsorted(share, h)) + 1 for h in HEADS)
        found[dim] = (np.ascontiguousarray(v.T), min(first, dim - 1), min(max(second, first + 1), dim))
    return found


def _multiplied(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The exact product of each row of a with its row of b, where doubles wouldn't hold it."""
    return [min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), LONG.min), LONG.max) for p, q in zip(a, b, strict=True)]


class _Best:
    """The k best of each query so far: scores descending, ids ascending in ties (null ids last)."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query = np.zeros(0, np.int64)
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.n = n

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, ~score, query))  # ~s is -s - 1, which no integer overflows
        query = query[order]
        starts = np.searchsorted(query, query)
        rank = np.arange(len(query)) - starts
        keep = order[rank < self.k]
        self.query, self.score, self.id, self.null = query[rank < self.k], score[keep], ids[keep], null[keep]
        full = rank == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[order[full]].astype(float))


def _tile(q: pd.DataFrame, c: pd.DataFrame, k: int, rotations: Rotations) -> pd.DataFrame:
    """The k best candidates of c, in descending length, for each query of q, but for those surely below its `least`."""
    c = c.sort_values("pos", kind="stable")
    dim = int(q["dim"].iloc[0])
    stack = lambda s: np.array(list(s), float).reshape(len(s), dim)
    cx, c_len, c_at = stack(c["x"]), c["length"].to_numpy(float), c["at"].to_numpy()
    c_null = c["id"].isna().to_numpy()
    c_id = c["id"].fillna(0).to_numpy().astype(np.int64)
    turn, first, second = rotations.get(dim, (None, dim, dim))
    safe_c = np.where(np.isfinite(c_len) & (c_len < 1e100), 1.0, 0.0)[:, None]  # others aren't bounded by partial sums
    cr = (cx * safe_c) @ turn if turn is not None else cx
    rest = lambda m, head: np.sqrt(np.maximum((m[:, head:] ** 2).sum(axis=1), 0))
    c_rest = (rest(cr, first), rest(cr, second)) if turn is not None else None
    found = []
    for a in range(0, len(q), QUERIES):
        part = q.iloc[a : a + QUERIES]
        qx, q_len, q_at = stack(part["x"]), part["length"].to_numpy(float), part["at"].to_numpy()
        best = _Best(len(part), k, part["least"].to_numpy(float))
        qr = qx @ turn if turn is not None and np.isfinite(q_len).all() and q_len.max(initial=0) < 1e100 else None
        q_rest = (rest(qr, first), rest(qr, second)) if qr is not None else None
        for b in range(0, len(c), CHUNK):
            cols = np.arange(b, min(b + CHUNK, len(c)))
            with np.errstate(all="ignore"):
                top = q_len * c_len[b] * (1 + SLACK)
            alive = np.flatnonzero(~(top < best.least))
            if not len(alive):
                break  # all that follow are shorter
            if qr is not None and c_len[b] < 1e100 and np.isfinite(best.least[alive]).any():
                least = best.least[alive, None]
                slack = SLACK * q_len[alive, None] * c_len[None, cols]
                partial = qr[alive, :first] @ cr[cols, :first].T
                open_ = ~(partial + q_rest[0][alive, None] * c_rest[0][None, cols] + slack < least)
                i, j = np.nonzero(open_)
                if 4 * len(i) < open_.size:
                    more = partial[i, j] + np.einsum("ij,ij->i", qr[alive[i], first:second], cr[cols[j], first:second])
                    open_ = ~(more + q_rest[1][alive[i]] * c_rest[1][cols[j]] + slack[i, j] < best.least[alive[i]])
                    i, j = i[open_], j[open_]
            else:
                i, j = (x.ravel() for x in np.indices((len(alive), len(cols))))
            i, j = alive[i], cols[j]
            own = q_at[i] == c_at[j]
            i, j = i[~own], j[~own]
            if not len(i):
                continue
            with np.errstate(all="ignore"):
                exact = q_len[i] * c_len[j] < EXACT
            score = np.zeros(len(i), np.int64)
            if 4 * len(i) < len(alive) * len(cols):
                score[exact] = np.einsum("ij,ij->i", qx[i[exact]], cx[j[exact]]).astype(np.int64)
            else:
                with np.errstate(all="ignore"):
                    product = qx[alive] @ cx[cols].T
                score[exact] = product[np.searchsorted(alive, i[exact]), j[exact] - b].astype(np.int64)
            if not exact.all():
                score[~exact] = _multiplied(qx[i[~exact]], cx[j[~exact]])
            good = ~(score < best.least[i])
            best.add(i[good], score[good], c_id[j[good]], c_null[j[good]])
        found.append(pd.DataFrame({"query_at": q_at[best.query], "query_id": part["id"].to_numpy()[best.query], "vec_id": pd.Series(best.id, dtype="Int64").mask(best.null), "score": best.score}))
    return pd.concat(found)


def _scored(queries: DataFrame, candidates: DataFrame, k: int, rotations: Rotations) -> DataFrame:
    """(query_at, query_id, vec_id, score): the best of each tile (dim, block of queries, run of candidates)."""
    tile = ["dim", "block", "run"]
    fields = "query_at long, query_id long, vec_id long, score long"

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _tile(q, c, k, rotations) if len(q) and len(c) else pd.DataFrame({"query_at": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    queries, candidates = (df.toDF(*df.columns) for df in (queries, candidates))  # names of their own: both come from one table
    return queries.groupBy(*tile).cogroup(candidates.groupBy(*tile)).applyInPandas(best, fields)


def _leading(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest product for each row that is_query chooses; fewer where there are fewer."""
    spark = vectors.sparkSession
    rows = vectors.where(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), integers(F.col(vector_col), scale).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda acc, y: acc + y * y))
    rows = rows.select("*", F.size("x").alias("dim"), length.alias("length")).withColumn("down", -F.col("length"))
    rows = numbered(rows, ["down", "id"], ["dim"]).drop("down")
    most = F.greatest(F.lit(1), F.least(F.lit(65_536), F.floor(F.lit(BLOCK) / F.greatest("dim", F.lit(1)))))
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = F.least(most, F.greatest(F.lit(1024), F.ceil(F.col("total") / tasks)))
    blocks = rows.where("asks").groupBy(F.col("dim").alias("_dim")).agg(F.ceil(F.count("*") / F.max(most)).alias("blocks"))
    rows = rows.join(few(blocks := cut(blocks), blocks.count()), F.col("dim") == F.col("_dim")).drop("_dim")
    rows = written(rows.select("id", "asks", "x", "dim", "length", "at", "pos", "blocks", F.floor(F.col("pos") / size).alias("run"), F.pmod(F.xxhash64("at"), "blocks").alias("block")))
    rotations = fit_rotations(rows)

    queries = rows.where("asks").select("id", "x", "dim", "length", "at", "block")
    copies = lambda of: of.select("id", "x", "dim", "length", "at", "pos", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    start = queries.select("*", F.lit(float("-inf")).alias("least"), F.lit(0).cast("long").alias("run"))
    first = cut(_leading(_scored(start, copies(rows.where("run = 0")), k, rotations), k))

    least = first.where(F.col("rank") == k).select(F.col("query_at").alias("at"), F.col("score").cast("double").alias("least"))
    runs = cut(rows.where("run > 0").groupBy(F.col("dim").alias("_dim"), "run").agg(F.max("length").alias("longest")))
    known = queries.join(least, "at", "left").fillna(float("-inf"), ["least"])
    visits = known.join(few(runs, runs.count()), (F.col("dim") == F.col("_dim")) & ~(F.col("length") * F.col("longest") * (1 + SLACK) < F.col("least"))).drop("_dim", "longest")
    rest = _scored(visits, copies(rows.where("run > 0")), k, rotations)
    return _leading(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
