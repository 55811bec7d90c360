"""Lineage cuts, size-checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of narrow tables (a few longs) that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where it names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="folioframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node it reaches.

    Alternating large-star and small-star steps. Each aggregates the neighbours'
    minimum (combined before the shuffle) and joins it back, so that a node with
    very many neighbours can be split by the skew join; each round's edges are
    written to the checkpoint folder. An empty edge table gives an empty result.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        odd = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
        if odd.isEmpty():  # all stars: each node is a root, or has one edge, to a root
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as Parquet in a new folder (the cluster's shared one, where none is named): what cut does, at a fraction of the disk for wide rows."""
    at = at or f"{folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder of our own, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, at: str | None = None) -> DataFrame:
    """df, written once (to `at`, where named), with at (long, unique), pos (long, from 0: the row's place in its group's order) and total (the group's rows).

    A range shuffle sorts the rows over all tasks; each task numbers its own, and
    the tasks' counts, a row for each task and group, give the places where they
    start. df must not have columns of these names. Nulls come first and are a group like any other. Ties are dealt by the
    task that read them, so that even one repeated row is spread over tasks.
    """
    group = group or []
    keys = [*group, *order, "_salt"]
    rows = df.withColumn("_salt", F.spark_partition_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), at)
    task = F.shiftright("at", 33)
    counts = rows.groupBy(task.alias("_task"), *group).agg(F.count("*").alias("_rows"), F.min("at").alias("_least"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = counts.select(
        F.col("_task").alias("_of"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_least", F.sum("_rows").over(whole).alias("total"),
        (F.sum("_rows").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_start"),
    )
    counts = cut(counts)
    on = F.shiftright(rows["at"], 33) == F.col("_of")
    for i, g in enumerate(group):
        on &= rows[g].eqNullSafe(F.col(f"_g{i}"))
    placed = rows.join(few(counts, counts.count()), on)
    return placed.select(*rows.columns, (F.col("at") - F.col("_least") + F.col("_start")).alias("pos"), "total")
