"""Operator 4: Jaccard join on word n-grams.

Size-banded tiles, hashed bitmap signatures whose bit counts bound the overlap
from above, then exact sorted-array intersection.

Texts with the same shingle set form a class, named by a hash of the set. A tile
is (size band, slice of the hash range, hash of the set's members in that slice).
A band's larger sets have at most U members, so linked sets differ in at most
D = 2U(1-t)/(1+t) members; the band cuts the hash range into D+2 or more slices
(D+1 for small sets), so linked sets agree in at least two (one) whole slices and
meet in their tiles. A set with so many empty slices that the agreeing ones might
be empty also enters the tiles of its empty slices. Nothing is missed, and texts
that share a passage seldom meet twice.

Tiles are never expanded into pairs of rows. Equal tiles count once. Members of a
tile are compared by their signatures within one task (two blocks of it, if it
is large), and only a spanning forest of the pairs whose bound reaches the threshold
leaves it; its components are the clusters. Only within a cluster are texts
compared exactly, again in blocks, each pair skipped once its ends are known to be connected.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk
from folioframe.llm.shared import components, cut, few

#: Classes of a cluster that meet in one block, and about how many members their sets may have together; two blocks meet in one task.
BLOCK, BLOCK_MEMBERS = 256, 1 << 21
#: The same for the signatures of a tile's members.
TILE_BLOCK = 1024
#: Bits of a signature: a power of two, at least twice the set's size, within these.
LEAST_BITS, MOST_BITS = 64, 4096
#: Slices into which one is cut to tell sets apart that lack another.
FINE = 16
_U = np.uint64


def size_bands(top: int, ratio: float = 1.5) -> list[tuple[int, int]]:
    """Bands [low, high] of set sizes up to top."""
    bands, low = [], 1
    while low <= top:
        high = max(low, int(low * ratio))
        bands.append((low, high))
        low = high + 1
    return bands


def _most_apart(n: int, m: int, num: int, den: int) -> int:
    """Members in which linked sets of n and m members differ at most."""
    return (n + m) * (den - num) // (den + num)


def _slices_of(high: int, num: int, den: int) -> tuple[int, int, int]:
    """(D, agree, K): linked sets of up to `high` members differ in D at most, so of K slices they agree in `agree` or
    more, some to spare for empty ones. Small sets have no slices to spare."""
    most = _most_apart(high, high, num, den)
    return (most, 2, most + 4 + most // 25) if most >= 4 else (most, 1, most + 1)


def set_arrays(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, b = tk.shingles(tk.words(texts), k)
    for i in range(len(b) - 1):
        yield np.unique(h[b[i] : b[i + 1]])


def class_id(s: np.ndarray) -> int:
    """Hash of a set as a signed long."""
    return int(tk.mix(tk.mix(s).sum(dtype=_U, keepdims=True) * _U(3) + _U(len(s))).view(np.int64)[0])


def tile_keys(s: np.ndarray, num: int, den: int, bands: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, agree): the tiles of a set, and in how many tiles a pair of that band must meet."""
    n, out, agree = len(s), [], []
    mixed = np.concatenate([np.zeros(1, _U), np.cumsum(tk.mix(s + _U(0x5851F42D4C957F2D)), dtype=_U)])
    own = bisect_right(bands, (n, n + (1 << 40))) - 1
    for low, high in bands[own:]:
        if n * den < num * low:  # too small for any larger member of this band
            break
        most, meet, k = _slices_of(high, num, den)
        if not most:
            continue  # only equal sets link
        width = _U((2**64 - 1) // k + 1)
        edges = np.concatenate([[0], np.searchsorted(s, np.arange(1, k, dtype=_U) * width), [n]])
        full = np.diff(edges) > 0
        # with this many filled slices, `meet` of them agree with any partner's
        enough = _most_apart(n, min(high, n * den // num), num, den) + meet
        keep = full if full.sum() >= enough else np.ones(k, bool)
        part = (mixed[edges[1:]] - mixed[edges[:-1]])[full]
        where = np.flatnonzero(full).astype(_U) + _U(high) * _U(0x100000001B3)
        out.append(tk.mix(part + tk.mix(where)))
        bare = np.flatnonzero(keep & ~full).astype(_U) + _U(high) * _U(0x100000001B3)
        if len(bare):
            out.append(_bare_keys(s, mixed, bare, most, meet, k))
        agree.append(np.full(sum(map(len, out)) - sum(map(len, agree)), meet, np.int8))
    return (np.concatenate(out), np.concatenate(agree)) if out else (np.zeros(0, _U), np.zeros(0, np.int8))


def _bare_keys(s: np.ndarray, mixed: np.ndarray, bare: np.ndarray, most: int, meet: int, k: int) -> np.ndarray:
    """The tiles of a set's empty slices. All sets that lack a slice would share one tile, so each is told apart by what
    the set holds elsewhere: the hash range is cut into FINE times as many slices, and the first most + meet of them that
    are filled each give a tile. Linked sets that lack the slice both differ in `most` fine slices at most, so of those
    first ones they share `meet` or more. Sets with few filled fine slices keep the plain tile, and so do those whose
    partners may have few."""
    width = _U((2**64 - 1) // (FINE * k) + 1)
    edges = np.concatenate([[0], np.searchsorted(s, np.arange(1, FINE * k, dtype=_U) * width), [len(s)]])
    filled = np.flatnonzero(np.diff(edges) > 0)
    keys = [tk.mix(tk.mix(bare))] if len(filled) < 2 * most + meet else []
    if len(filled) >= most + meet:
        first = filled[: most + meet]
        part = mixed[edges[first + 1]] - mixed[edges[first]]
        fine = tk.mix(part + tk.mix(first.astype(_U) + _U(0x632BE59BD9B4E019)))
        keys.append(tk.mix((tk.mix(bare + _U(0x9E3779B97F4A7C15))[:, None] + fine[None, :]).ravel()))
    return np.concatenate(keys)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The set's hashes as bits; the lower half of a longer map or'ed with its upper half is the shorter map."""
    out = np.zeros(bits // 64, _U)
    at = (s & _U(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, _U(1) << (at & 63).astype(_U))
    return out


def width_of(n: int, most: int = MOST_BITS) -> int:
    return min(most, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))


def _digest(k: int):
    def run(batches):
        for b in tk.slices(batches, "text"):
            ids, n, maps = [], [], []
            for s in set_arrays(b.column("text"), k):
                n.append(len(s))
                ids.append(class_id(s) if len(s) else None)
                maps.append(bitmap(s, width_of(len(s))).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], ["id", "key", "cid", "n", "bits"])

    return run


def _tiles(k: int, num: int, den: int):
    """(key, cid, agree) for each tile of each class; exact copies within a task count once."""
    bands = size_bands(1 << 26)

    def run(batches):
        seen: set[int] = set()
        for b in tk.slices(batches, "text"):
            keys, cids, agree = [], [], []
            if len(seen) > 1 << 18:
                seen.clear()
            for s in set_arrays(b.column("text"), k):
                if not len(s) or (cid := class_id(s)) in seen:
                    continue
                seen.add(cid)
                t, meet = tile_keys(s, num, den, bands)
                keys.append(t)
                agree.append(meet)
                cids.append(np.full(len(t), cid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([tk.long(np.concatenate(keys)), pa.array(np.concatenate(cids)), pa.array(np.concatenate(agree))], ["key", "cid", "agree"])

    return run


class Signatures:
    """Bitmaps of several widths; a pair is compared at the narrower one's."""

    def __init__(self, maps: list[np.ndarray]):
        width = np.array([len(m) for m in maps])
        self.width, self.at = width, {}
        for w in np.unique(width):
            rows = np.flatnonzero(width >= w)
            folded = np.zeros((len(maps), w), _U)
            for r in rows:
                folded[r] = np.bitwise_or.reduce(maps[r].reshape(-1, w), axis=0)
            self.at[int(w)] = folded

    def most_shared(self, i: int, js: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of i with js, none of which is narrower: a bit that
        only one map has stands for at least one member that the other set lacks."""
        maps = self.at[int(self.width[i])]
        a, b = maps[i], maps[js]
        return np.minimum(sizes[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), sizes[js] - np.bitwise_count(~a & b).sum(1, dtype=np.int64))


def forest(sizes: np.ndarray, left: np.ndarray, maps: list[np.ndarray], num: int, den: int, exact=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (all, if left is all True, else left with others) whose bound
    reaches the threshold and, given exact(i, j) -> overlap, whose overlap does."""
    order = np.argsort(sizes, kind="stable")
    sizes, side, every = sizes[order], left[order], bool(left.all())
    signs = Signatures([maps[i] for i in order])
    root = np.arange(len(order))
    found = []
    for i in range(len(order) - 1):
        js = np.arange(i + 1, int(np.searchsorted(sizes, sizes[i] * den // num, side="right")))
        js = js[(root[js] != root[i]) & (every | (side[js] != side[i]))]
        if not len(js):
            continue
        upper = signs.most_shared(i, js, sizes)
        for j in js[(den + num) * upper >= num * (sizes[i] + sizes[js])]:
            if root[j] != root[i] and (exact is None or (den + num) * exact(order[i], order[j]) >= num * (sizes[i] + sizes[j])):
                found.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return found


def linked_edges(sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    def overlap(i: int, j: int) -> int:
        a, b = sets[i], sets[j]
        return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())

    sizes = np.array([len(s) for s in sets])
    return forest(sizes, left, [bitmap(s, width_of(len(s), 1 << 14)) for s in sets], num, den, overlap)


def _by_tile(solve):
    """Rows sorted by tile, all of a tile's to solve(table) -> (a, b) class pairs."""

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        _, keep = np.unique(t.column("cid").to_numpy(), return_index=True)
        if len(keep) < 2 or not (found := solve(t.take(keep) if len(keep) < len(t) else t)):
            return None
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and tile[i] != name:
                    if (out := close(held)) is not None:
                        yield out
                    held = []
                name = tile[i]
                held.append(batch.slice(i, j - i))
        if held and (out := close(held)) is not None:
            yield out

    return run


def _bound(num: int, den: int):
    def solve(t: pa.Table) -> list[tuple[int, int]]:
        cid = t.column("cid").to_pylist()
        maps = [np.frombuffer(x, _U) for x in t.column("bits").to_pylist()]
        return [(cid[i], cid[j]) for i, j in forest(t.column("n").to_numpy(), t.column("left").to_numpy(), maps, num, den)]

    return _by_tile(solve)


def _sets(k: int):
    """(cid, root, blocks, members): each class's sorted set, from its own text."""

    def run(batches):
        for b in tk.slices(batches, "text"):
            sets = list(set_arrays(b.column("text"), k))
            at = [i for i, (s, cid) in enumerate(zip(sets, b.column("cid").to_pylist(), strict=True)) if len(s) and class_id(s) == cid]  # not so if two texts share a hash
            members = pa.array([sets[i].tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in ("cid", "root", "blocks")), members], ["cid", "root", "blocks", "members"])

    return run


def _verify(num: int, den: int):
    def solve(t: pa.Table) -> list[tuple[int, int]]:
        cid = t.column("cid").to_pylist()
        sets = [np.frombuffer(x, _U) for x in t.column("members").to_pylist()]
        return [(cid[i], cid[j]) for i, j in linked_edges(sets, t.column("left").to_numpy(), num, den)]

    return _by_tile(solve)


def _blocked(df: DataFrame, group: str) -> DataFrame:
    """Rows (group, cid, blocks of the group, ...) dealt to tiles of two blocks of the group: adds tile and left.

    A block meets itself in a tile where all rows are on the left."""
    df = df.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return df.withColumn("tile", F.xxhash64(group, low, high)).withColumn("left", F.col("mine") == low).drop("blocks", "mine", "other", group)


def _rooted(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): id, key (a hash of the text), n and cid of each row; cid, first_id and root (one of its component's cids) of each class."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    digest = cut(base.mapInArrow(_digest(k), "id long, key long, cid long, n long, bits binary"))
    named = digest.where("cid is not null")
    classes = named.groupBy("cid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("own"), F.min("n").alias("n"))
    classes = classes.select("cid", F.col("own.id").alias("first_id"), F.col("own.key").alias("key"), "n")

    tiles = base.select("text").mapInArrow(_tiles(k, num, den), "key long, cid long, agree byte").repartition("key")
    in_key = Window.partitionBy("key").orderBy("cid")
    whole = in_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tiles = tiles.withColumns({"low": F.first("cid").over(whole), "high": F.last("cid").over(whole), "place": F.row_number().over(in_key)})
    mark = F.bit_xor(F.xxhash64("cid")).over(whole)  # with the ends, a name of the tile's members
    more = F.max((F.col("cid") > F.col("low")) & (F.col("cid") < F.col("high"))).over(whole)
    tiles = cut(tiles.withColumns({"mark": mark, "more": more}).where("low < high").select("cid", "agree", "low", "high", "place", "mark", "more"))
    # two classes that meet alone must do so in `agree` tiles, unless they also meet in a tile of more
    pairs = tiles.where("not more and place = 1").groupBy("low", "high").agg(F.count("*").alias("met"), F.min("agree").alias("agree")).where("met >= agree")
    pairs = pairs.select(F.xxhash64("low", "high").alias("group"), F.explode(F.array("low", "high")).alias("cid"))
    crowds = tiles.where("more").select(F.xxhash64("low", "high", "mark").alias("group"), "cid").distinct()
    members = cut(pairs.unionByName(crowds))
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / TILE_BLOCK).alias("blocks"))
    signs = named.groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    signed = _blocked(members.join(signs, "cid").join(sizes, "group"), "group")
    near = signed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_bound(num, den), "a long, b long")

    clusters = components(near).select(F.col("node").alias("cid"), "root").join(classes, "cid")
    sizes = clusters.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_MEMBERS)).alias("blocks"))
    # one row for each class: its own text's id and hash
    chosen = cut(clusters.join(sizes, "root").select(F.col("first_id").alias("of"), "key", "cid", "root", "blocks"))
    chosen = few(chosen, chosen.count())
    texts = base.join(chosen, (base["key"] == chosen["key"]) & base["id"].eqNullSafe(chosen["of"])).select("text", "cid", "root", "blocks")
    sets = texts.mapInArrow(_sets(k), "cid long, root long, blocks long, members binary").dropDuplicates(["cid"])
    texts = _blocked(sets, "root")
    checked = texts.repartition("tile").sortWithinPartitions("tile").mapInArrow(_verify(num, den), "a long, b long")
    roots = components(checked)
    joined = classes.join(roots, classes.cid == roots.node, "left").select("cid", "first_id", F.coalesce("root", "cid").alias("root"))
    return digest, joined


def ngram_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles (set size), class_id and component_id.

    Texts link when den * |A & B| >= num * |A | B| over their distinct k-word
    shingles (a text with fewer than k words: its whole sequence as one).
    component_id is the smallest id reachable by links, the row's own included.
    A null or empty text, or one without words, has no shingles, a null class_id
    and links with nothing. Repeated rows each give a row. A null id is carried
    and never names a component of rows that have ids, but its text links like any other. Ids must be integers or cast to them. Very long texts
    are read whole, and meet in blocks bounded by their sets' sizes. Extra columns are not read. An empty table gives an empty result. class_id is a 64-bit hash of the
    shingle set; equal hashes count as equal sets.
    """
    rows, classes = _rooted(docs, k, num, den, id_col, text_col)
    named_roots = classes.groupBy("root").agg(F.min("first_id").alias("component"))
    by_class = classes.select("cid", "root").join(named_roots, "root").select("cid", "component")
    out = rows.join(by_class, "cid", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.col("cid").alias("class_id")
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents without all but one row of each component: the row of the smallest doc_id.

    A doc_id may stand for several texts: each text is judged by itself, so different
    texts stay under one id. Among rows of one doc_id in a component that of the smallest
    text hash stays, and of rows that repeat id and text that of the smallest hash of all
    columns, whichever way Spark deals them. Null, empty and wordless texts are no copies
    of others, but rows that repeat id and text count once. Rows with a null doc_id all
    stay. Very long texts are read whole; other columns stay, whatever their names. An empty table gives no rows.
    """
    rows, classes = _rooted(docs, k, num, den, "doc_id", "text")
    known = rows.where("id is not null").select("id", "key", "cid")
    first = known.where("cid is not null").join(classes.select("cid", "root"), "cid").groupBy("root").agg(F.min(F.struct("id", "key")).alias("own")).select("own.*")
    kept = first.unionByName(known.where("cid is null").select("id", "key").distinct())
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = docs.where("doc_id is not null").select(whole.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    one = own.join(kept, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("row", "all").alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
