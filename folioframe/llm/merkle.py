"""Merkle manifest of a dataset: a digest for each row, group and the whole, and the proof that ties each row to the whole.

A row's leaf is the SHA-256 of its columns, each with its length. Within a group
the leaves stand in the order of their ids; runs of FANOUT nodes become the
digest of their concatenation, level by level, until one is left. The groups'
roots, in the order of the groups, are put together in the same way.

Rows get their places from a range shuffle, and blocks of FANOUT ** LEVELS leaves
are gathered into ordered arrays, which higher-order functions collapse without
leaving the JVM. The blocks' roots are the next, 512 times shorter, table. No
array is longer than a block, however many rows a group has.

Nulls are a value of their own (`-`), the empty text is `0:`. A null group is a
group, the first one. Rows of one id are ordered by their leaves, null ids come
first, repeated rows are leaves of their own. An empty table gives no rows. Very
long texts are hashed whole, by their own task. Columns beyond those named don't
matter; clashing names neither, as results hold only what is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import cut, numbered

#: Nodes that are hashed into one.
FANOUT = 8
#: Levels that a block's array collapses: 8 ** 3 = 512 leaves a block.
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each column as its byte count, a colon and its value, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, node, lambda acc, p: digest(F.concat(p["before"], acc, p["after"])))


def _collapsed(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), "")))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, total, entries, levels) of nodes (g, pos, total, node, more): an ordered array of each block's nodes, and what becomes of it level by level."""
    span = FANOUT**LEVELS
    block = F.floor(F.col("pos") / span)
    held = nodes.groupBy("g", block.alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "node", "more"))).alias("entries"))
    n = F.col("total")
    rounds = F.when(n > span, LEVELS).otherwise(sum((n > FANOUT**i).cast("int") for i in range(LEVELS)))
    steps = F.slice(F.array(*(F.lit(i) for i in range(LEVELS))), F.lit(1), rounds)
    levels = F.aggregate(steps, F.array(F.col("entries.node")), lambda acc, _: F.concat(acc, F.array(_collapsed(F.element_at(acc, -1)))))
    kept = F.transform("entries", lambda e: F.struct(e["pos"].alias("pos"), e["more"].alias("more")))
    return cut(held.select("g", "block", "total", kept.alias("entries"), levels.alias("levels")))


def _above(blocks: DataFrame) -> DataFrame:
    """(g, block, top, proof): the root of each block's group, and the proof from the block's own root to it."""
    n = F.ceil(F.col("total") / FANOUT**LEVELS)
    roots = blocks.select("g", F.col("block").alias("pos"), n.alias("total"), F.element_at("levels", -1)[0].alias("node"), F.struct(F.lit(0).alias("none")).alias("more"))
    if roots.where("total > 1").isEmpty():
        none = F.array().cast("array<struct<before:string,after:string>>")
        return roots.select("g", F.col("pos").alias("block"), F.col("node").alias("top"), none.alias("proof"))
    higher = _blocks(roots)
    return _entries(higher, _above(higher)).select("g", F.col("pos").alias("block"), "top", "proof")


def _entries(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """A row for each node of the blocks, with what stands above it: the columns of `above` but for its block, the proof prolonged downwards."""
    up = above.select(F.col("g").alias("_g"), F.col("block").alias("_block"), *(F.col(c) for c in above.columns if c not in ("g", "block")))
    both = blocks.join(up, blocks["g"].eqNullSafe(up["_g"]) & (blocks["block"] == up["_block"]))

    def proof(i: Column) -> Column:
        def step(level: Column, k: Column) -> Column:
            at = F.floor(i / F.pow(F.lit(FANOUT), k)).cast("int")
            ahead = at % FANOUT
            before = F.slice(level, at - ahead + 1, ahead)
            after = F.slice(level, at + 2, FANOUT - 1 - ahead)
            return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

        lower = F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), step)
        return F.concat(lower, F.col("proof"))

    others = [c for c in above.columns if c not in ("g", "block", "proof")]
    nodes = F.transform(
        "entries",
        lambda e, i: F.struct(F.col("g").alias("g"), e["pos"].alias("pos"), e["more"].alias("more"), F.col("levels")[0][i].alias("node"), *(F.col(c).alias(c) for c in others), proof(i).alias("proof")),
    )
    return both.select(F.inline(nodes))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each of docs: id, group, leaf, place (in its group, from 0), subroot, root, proof, and the columns that `keep` names and defines.

    The proof lists, from the leaf's run upwards, the digests that stand before and after the node in its run, each concatenated.
    """
    more = F.struct(F.col(id_col).alias("id"), *(c.alias(name) for name, c in (keep or {}).items()))
    leaves = docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("_id"), leaf([F.col(c) for c in columns]).alias("node"), more.alias("more"))
    blocks = _blocks(numbered(leaves, ["_id", "node"], ["g"]).select("g", "pos", "total", "node", "more"))
    above = cut(_above(blocks))
    groups = above.where("block = 0").select(F.col("g").alias("of"), F.col("top").alias("node"))
    tops = numbered(groups, ["of"]).select(F.lit(0).alias("g"), "pos", "total", "node", F.struct("of").alias("more"))
    highest = _blocks(tops)
    whole = _entries(highest, _above(highest)).select(F.col("more.of").alias("of"), F.col("top").alias("root"), F.col("proof").alias("rest"))
    above = above.join(whole, above["g"].eqNullSafe(whole["of"])).select("g", "block", F.col("top").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"))
    return _entries(blocks, above).select(
        F.col("more.id").alias(id_col), F.col("g").alias(group_col), F.col("node").alias("leaf"), F.col("pos").alias("place"), "subroot", "root", "proof", *(F.col("more")[name].alias(name) for name in (keep or {}))
    )
