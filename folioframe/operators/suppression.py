"""Non-maximum suppression where a page or class holds very many boxes.

layout.suppress folds a group's boxes as one array, in one task. Here boxes lie in
the cells of a grid, and a round keeps every box that is the highest in all cells
it touches: no higher box can overlap it, so the greedy order would keep it too.
What a kept box suppresses lies in its cells and goes; the rest enters the next
round, until none is left. A cell gives one box a round, so nothing is compared
with more than the kept boxes of its own cells, however many boxes a cell holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.streaming import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _over(a: str, b: str, threshold: float, plus: int, strict: bool) -> Column:
    """Whether the intersection over union of two boxes (structs) exceeds the threshold, or with strict equals it; empty unions don't."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")) + plus)
    area = lambda x: (F.col(f"{x}.x1") - F.col(f"{x}.x0")) * (F.col(f"{x}.y1") - F.col(f"{x}.y0"))
    both = side("x0", "x1") * side("y0", "y1")
    whole = area(a) + area(b) - both
    ratio = F.when(whole != 0, both / F.when(whole != 0, whole))
    return F.coalesce(ratio >= threshold if strict else ratio > threshold, F.lit(False))


def suppress_many(boxes: DataFrame, threshold: float, plus: int = 0, strict: bool = False, keys: tuple[str, ...] = ("page", "cls"), cell: float | None = None) -> DataFrame:
    """The rows of layout.suppress(), for groups of any size: (keys, score, idx, x0, y0, x1, y1).

    threshold must be above 0 (0 will do if not strict). cell: side of the grid's cells; by default the median of the boxes'
    longer sides. Results don't depend on it. Boxes that tie in score and idx come in no given order, one before the other."""
    if threshold < 0 or (strict and threshold == 0):
        raise ValueError("such a threshold suppresses boxes that don't overlap")
    fields = ["score", "idx", "x0", "y0", "x1", "y1"]
    left = _cut(boxes.select(*keys, F.struct(*fields, F.monotonically_increasing_id().alias("uid")).alias("box")))
    if cell is None:
        longer = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"))
        cell = max(1.0, left.agg(F.percentile_approx(longer, 0.5)).first()[0] or 1.0)
    at = lambda c, more=0: F.floor((F.col(f"box.{c}") + more) / cell)
    columns, rows = ((at(a), F.greatest(at(a), at(b, plus))) for a, b in (("x0", "x1"), ("y0", "y1")))
    n_cells = (columns[1] - columns[0] + 1) * (rows[1] - rows[0] + 1)

    def in_cells(df: DataFrame) -> DataFrame:
        wide = df.select("*", F.explode(F.sequence(*columns)).alias("cx"))
        return wide.select("*", F.explode(F.sequence(*rows)).alias("cy"))

    rank = F.struct("box.score", "box.idx", "box.uid")
    found, n = [], left.count()
    while n:
        highest = in_cells(left).groupBy(*keys, "cx", "cy").agg(F.max_by("box", rank).alias("box"))
        wins = highest.groupBy(*keys, F.col("box.uid").alias("uid")).agg(F.first("box").alias("box"), F.count("*").alias("wins"))
        kept = _cut(wins.where(F.col("wins") == n_cells).select(*keys, "box"))
        found.append(kept)
        near = in_cells(left).join(in_cells(kept).withColumnRenamed("box", "by"), [*keys, "cx", "cy"])
        gone = near.where((F.col("box.uid") == F.col("by.uid")) | _over("box", "by", threshold, plus, strict)).select(F.col("box.uid").alias("uid")).distinct()
        left = _cut(left.join(gone, F.col("box.uid") == F.col("uid"), "left_anti"))
        n = left.count()
    out = found[0] if found else left
    for kept in found[1:]:
        out = out.unionByName(kept)
    return out.select(*keys, *(f"box.{f}" for f in fields))
