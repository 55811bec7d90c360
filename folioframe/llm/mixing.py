"""Operator 7: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). Words flow from patterns to source quotas; passing a pattern's words a
second time costs more than the first (a convex repetition cost), so the flow is
filled copy by copy. Up to NODES patterns the flow is found on the driver. Beyond,
targets come from aggregations, a source that shares no document with another is
filled by a formula, and the others' flow is found in tasks, one for each group of
sources that documents connect. Documents are then selected in the order of a seeded hash. The
boundary is found from sums over hash buckets, so no source is gathered in one task. What the document at the boundary
is too long for is filled in the same way with shorter documents that come after it, in rounds.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import components, cut, few, numbered

#: Patterns, each with its sources, whose flow is found on the driver.
NODES = 100_000
BUCKET_BITS = 14
#: A pattern is filled if the words that it lacks are this share of its plan at most, and after so many rounds in any case.
NEAR, ROUNDS = 0.001, 8
# The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null: 0."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(clean) == 0, F.lit(0)).otherwise(F.size(F.split(clean, "[\\x20\\x09-\\x0D]+", -1))).cast("long")


def share_out(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets that share `share` of all sizes by weight; one above cap * its size
    stops there and the excess is shared again among the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, live = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while live:
        total = sum(w[i] for i in live)
        over = [i for i in live if left * w[i] > cap * sizes[i] * total]
        if not over:
            for i in live:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            live.discard(i)
        left -= sum(out[i] for i in over)
    return out


def min_cost_flow(supply: list[int], member: list[list[int]], quota: list[int], copies: int) -> list[int]:
    """Words taken from each pattern: the most that the quotas admit, and among
    those the cheapest, the c-th copy of a word costing more than the one before.

    Only the arcs into patterns cost anything, and an augmenting path uses one of
    them once, so filling the copies one after another with maximum flows is
    optimal (successive cheapest paths)."""
    n, m = len(supply), len(quota)
    s, t = n + m, n + m + 1
    graph: list[dict[int, int]] = [defaultdict(int) for _ in range(n + m + 2)]
    for p, into in enumerate(member):
        for j in into:
            graph[p][n + j] = copies * supply[p]
            graph[n + j][p] += 0
        graph[s][p], graph[p][s] = 0, 0
    for j, q in enumerate(quota):
        graph[n + j][t], graph[t][n + j] = q, 0
    for _ in range(copies):
        for p in range(n):
            graph[s][p] += supply[p]
        while (level := _levels(graph, s, t))[t] >= 0:
            arcs, at = [list(g) for g in graph], [0] * len(graph)
            while _push(graph, s, t, level, arcs, at):
                pass
    return [graph[p][s] for p in range(n)]


def _levels(graph: list[dict[int, int]], s: int, t: int) -> list[int]:
    level, queue = [-1] * len(graph), deque([s])
    level[s] = 0
    while queue:
        u = queue.popleft()
        for v, c in graph[u].items():
            if c > 0 and level[v] < 0:
                level[v] = level[u] + 1
                queue.append(v)
    return level


def _push(graph, s: int, t: int, level: list[int], arcs: list[list[int]], at: list[int]) -> bool:
    """Augment along one path of the level graph; at: the first arc of each node not yet used up."""
    path = [s]
    while path[-1] != t:
        u = path[-1]
        while at[u] < len(arcs[u]):
            v = arcs[u][at[u]]
            if graph[u][v] > 0 and level[v] == level[u] + 1:
                path.append(v)
                break
            at[u] += 1
        else:
            path.pop()
            if not path:
                return False
            at[path[-1]] += 1
    steps = list(zip(path, path[1:], strict=False))
    flow = min(graph[u][v] for u, v in steps)
    for u, v in steps:
        graph[u][v] -= flow
        graph[v][u] += flow
    return True


def _targets(patterns: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, n, total, target) of each source of patterns (a, words): share_out() by aggregations. n: its place in code point order, null last."""
    totals = patterns.select(F.explode("a").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("held"))
    ranked = numbered(totals.withColumn("none", F.col("source").isNull()), ["none", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    s = cut(ranked.select("source", F.col("pos").alias("n"), F.col("held").alias("total"), weight.alias("w")))
    left, over, target = share * (s.agg(F.sum("total")).first()[0] or 0), F.lit(False), F.lit(None).cast("double")
    while True:  # at least one source stops in each round
        live = s.where(~over)
        total_w = live.agg(F.sum("w")).first()[0]
        if not total_w:
            break
        now = F.lit(left) * F.col("w") > cap * F.col("total") * total_w
        n, words = live.where(now).agg(F.count("*"), F.sum("total")).first()
        if not n:
            target = F.lit(left) * F.col("w") / total_w
            break
        over, left = over | now, left - cap * words
    return cut(s.select("source", "n", "total", F.when(over, cap * F.col("total")).otherwise(target).cast("double").alias("target")))


def _spread_flow(patterns: DataFrame, weights: tuple[int, ...], share: float, copies: int) -> DataFrame:
    """(p, words, source_size, target, flow) of patterns (p, a, words), whose number nothing bounds."""
    sources = _targets(patterns, weights, share, float(copies))
    member = patterns.select("p", "words", F.explode("a").alias("of")).join(sources, F.col("of").eqNullSafe(F.col("source")))
    each = F.sort_array(F.collect_list(F.struct("n", F.rint("target").cast("long").alias("quota"))))
    member = member.groupBy("p").agg(F.first("words").alias("words"), F.sum("total").alias("source_size"), F.sum("target").alias("target"), each.alias("into"))
    member = cut(member)
    shared = member.where("size(into) > 1").select(F.col("into")[0]["n"].alias("a"), F.explode("into.n").alias("b"))
    groups = components(shared).select(F.col("node"), F.col("root"))
    member = member.join(groups, F.col("into")[0]["n"] == F.col("node"), "left")
    alone = member.where("root is null").select("p", F.least(copies * F.col("words"), F.col("into")[0]["quota"]).alias("flow"))

    def solve(pdf):
        import pandas as pd

        quota = {int(x["n"]): int(x["quota"]) for into in pdf["into"] for x in into}
        index = {n: i for i, n in enumerate(sorted(quota))}
        pdf = pdf.sort_values("p")
        flow = min_cost_flow([int(w) for w in pdf["words"]], [[index[int(x["n"])] for x in into] for into in pdf["into"]], [quota[n] for n in sorted(quota)], copies)
        return pd.DataFrame({"p": pdf["p"].to_numpy(), "flow": flow})

    tied = member.where("root is not null").select("root", "p", "words", "into").groupBy("root").applyInPandas(solve, "p string, flow long")
    none = patterns.where("size(a) = 0").select("p", "words", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("flow"))
    return member.select("p", "words", "source_size", "target").join(alone.unionByName(tied), "p").unionByName(none)


def _rounds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(p, taken) for each pattern of plan(p, rest): array of (low, high, most); documents with low < at <= high and a size of at
    most `most` are taken, together nearly rest words and never more. sized: p, at, size."""
    bits = 64 - BUCKET_BITS
    state = plan.where("rest > 0").select("p", "rest", F.lit(-(2**63)).alias("low"), F.col("rest").alias("most"), F.col("rest").alias("left"))
    steps = []
    for _ in range(ROUNDS):
        state = cut(state.where(F.col("left") > NEAR * F.col("rest")))
        n = state.count()
        if not n:
            break
        now = few(state.select("p", "low", "most", "left"), n)
        rows = sized.join(now, "p").where("at > low and size <= most and size > 0").withColumn("bucket", F.shiftright("at", bits))
        sums = rows.groupBy("p", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        by = Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = cut(sums.withColumn("sofar", F.sum("words").over(by)))
        full = sums.where("sofar <= left").groupBy("p").agg(F.max("sofar").alias("whole"))
        edge = sums.where("sofar > left").groupBy("p").agg(F.min("bucket").alias("bucket"), F.min_by("sofar", "bucket").alias("s"), F.min_by("words", "bucket").alias("w"))
        edge = edge.select("p", "bucket", (F.col("s") - F.col("w")).alias("before"))
        inner = rows.join(few(edge, n), ["p", "bucket"]).groupBy("p", "at").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        inner = inner.withColumn("sofar", upto).where("sofar <= left").groupBy("p").agg(F.max("at").alias("last"), F.max("sofar").alias("inside"))
        found = state.join(few(full, n), "p", "left").join(few(edge, n), "p", "left").join(few(inner, n), "p", "left")
        ends = F.col("bucket").isNotNull()  # else all that fit are taken
        high = F.when(ends, F.coalesce("last", F.shiftleft("bucket", bits) - 1)).otherwise(F.lit(2**63 - 1))
        used = F.when(ends, F.coalesce("inside", "before")).otherwise(F.coalesce("whole", F.lit(0)))
        found = cut(found.select("p", "rest", "low", "most", "left", ends.alias("ends"), high.alias("high"), used.alias("used")))
        steps.append(found.where("used > 0").select("p", F.struct("low", "high", "most").alias("step")))
        left = F.col("left") - F.col("used")
        state = found.where("ends").select("p", "rest", F.greatest("low", "high").alias("low"), left.alias("most"), left.alias("left"))
    if not steps:
        return plan.select("p", F.array().cast("array<struct<low:long,high:long,most:long>>").alias("taken")).where(F.lit(False))
    taken = steps[0]
    for x in steps[1:]:
        taken = taken.unionByName(x)
    return taken.groupBy("p").agg(F.collect_list("step").alias("taken"))  # at most ROUNDS a pattern


def mix(
    docs: DataFrame,
    sources: Column,
    seed: int = 7,
    copies: int = 2,
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: Column | None = None,
) -> DataFrame:
    """row (a struct of docs' columns, whatever their names), size, source_size, target, copies (0 to `copies`).

    sources: array of the names of the sources that a row belongs to; a null name
    is a source of its own, last in order. Rows of no source aren't taken. source_size and target are sums over
    the row's sources. size: the row's words, where docs have it already; else they are counted in the text, empty and null ones having none.
    Whole documents are taken, never more words than the flow routes, and fewer by about NEAR of them, or where no
    document is short enough. Rows of equal id and size tie: all or none of them are taken. Very long texts are counted whole. Empty tables give no rows.
    """
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("a")))
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(row.alias("row"), (word_count(F.col(text_col)) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"), pattern.alias("p"))
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), F.col("row")[id_col], F.col("size")))
    sized = cut(rows.select("p", "at", "size"))  # narrow: the rounds don't read the texts
    patterns = sized.groupBy("p").agg(F.sum("size").alias("words")).select("p", F.coalesce(F.from_json("p", "a array<string>")["a"], F.array().cast("array<string>")).alias("a"), "words")
    patterns = cut(patterns)
    n = patterns.count()
    flows = _driver_flow(patterns, weights, share, copies) if n <= NODES else _spread_flow(patterns, weights, share, copies)
    part = lambda e: F.when(F.col("words") > 0, F.expr(e)).otherwise(F.lit(0).cast("long"))
    flows = cut(flows.select("p", "source_size", "target", part("flow div words").alias("whole"), part("flow % words").alias("rest")))
    plan = cut(flows.join(few(_rounds(sized, flows.select("p", "rest")), n), "p", "left").drop("rest"))
    out = rows.join(few(plan, n), "p")
    more = F.coalesce(F.exists("taken", lambda x: (F.col("at") > x["low"]) & (F.col("at") <= x["high"]) & (F.col("size") <= x["most"])), F.lit(False))
    return out.select("row", "size", "source_size", "target", F.least(F.col("whole") + more.cast("long"), F.lit(copies).cast("long")).alias("copies"))


def _driver_flow(patterns: DataFrame, weights: tuple[int, ...], share: float, copies: int) -> DataFrame:
    """(p, words, source_size, target, flow) of at most NODES patterns (p, a, words)."""
    rows = sorted(patterns.collect(), key=lambda r: r["p"])
    names = sorted({s for r in rows for s in r["a"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    member = [[index[s] for s in r["a"]] for r in rows]
    total = [0] * len(names)
    for r, m in zip(rows, member, strict=True):
        for i in m:
            total[i] += r["words"]
    target = share_out(total, weights, share, float(copies))
    flow = min_cost_flow([r["words"] for r in rows], member, [round(x) for x in target], copies)
    plan = [(r["p"], r["words"], sum(total[i] for i in m), float(sum(target[i] for i in m)), f) for r, m, f in zip(rows, member, flow, strict=True)]
    return patterns.sparkSession.createDataFrame(plan, "p string, words long, source_size long, target double, flow long")
