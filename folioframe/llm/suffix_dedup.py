"""Operator 8: sparse suffix-array dedup.

Suffixes are retained only at minimiser positions: in every window of
`min_words` words, the k-word gram with the smallest hash. Equal passages select
equal positions, so a passage of min_words words that repeats has, in each copy,
a retained suffix that begins with the same k words. Retained suffixes are brought together by a hash of
their first k words, by a keyed aggregation and not by one global order (the README says why); those without an equal
in another document end there. The rest are extended left and right
over exactly the min_words-word windows that selected them: a window counts if another
document has the same window around an equal suffix, and a document's windows
that count are merged into spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk
from folioframe.llm.shared import cut

GRAM = 8
#: Tasks over which the texts that hold one run are dealt.
SALTS = 4
_U = np.uint64


def _grams(w: tk.Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; those that pass a text's end are not used."""
    h, total = w.hashes, len(w.hashes)
    out = np.full(total, k, dtype=_U)
    for j in range(min(k, total)):
        out[: total - j] += tk.mix(h[j:] + _U(j + 1))
    return tk.mix(out)


def _leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each window g[i:i + width], the position of its smallest value, the leftmost if several."""
    n = len(g) - width + 1
    # a doubling table of (value, position) minima; ties keep the left one
    value, at, span = g, np.arange(len(g)), 1
    while span * 2 <= width:
        left, right = value[:-span], value[span:]
        pick = right < left
        value, at = np.where(pick, right, left), np.where(pick, at[span:], at[:-span])
        span *= 2
    a, b = value[:n], value[width - span : width - span + n]
    return np.where(b < a, at[width - span : width - span + n], at[:n])


def window_minimisers(w: tk.Words, i: int, grams: np.ndarray, min_words: int, k: int) -> np.ndarray:
    """For each window of min_words words of text i, the word position of its retained suffix."""
    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
    if b - a < min_words:
        return np.zeros(0, np.int64)
    return _leftmost_minima(grams[a : b - k + 1], min_words - k + 1)


def _suffixes(min_words: int, k: int):
    """(gram, low, high): a gram at a retained position and the least and greatest id seen with it in the task."""

    def flush(grams: list, ids: list):
        g, d = np.concatenate(grams), np.concatenate(ids)
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        last = np.append(first[1:], len(g)) - 1
        return pa.RecordBatch.from_arrays([tk.long(g[first]), pa.array(d[first]), pa.array(d[last])], ["gram", "low", "high"])

    def run(batches):
        grams, ids, held = [], [], 0
        for b in tk.slices(batches, "text"):
            w = tk.words(b.column("text"))
            all_grams = _grams(w, k)
            for i, doc in enumerate(b.column("id").to_pylist()):
                at = np.unique(window_minimisers(w, i, all_grams, min_words, k))
                if len(at):
                    g = np.unique(all_grams[at + w.bounds[i]])
                    grams.append(g)
                    ids.append(np.full(len(g), doc, np.int64))
                    held += len(g)
            if held > 1 << 20:
                yield flush(grams, ids)
                grams, ids, held = [], [], 0
        if held:
            yield flush(grams, ids)

    return run


def _place(min_words: int, k: int):
    """(gram, key): each retained suffix's gram, and its text's key."""

    def run(batches):
        for b in tk.slices(batches, "text"):
            w = tk.words(b.column("text"))
            all_grams = _grams(w, k)
            keys = b.column("key").to_numpy(zero_copy_only=False)
            out, own = [], []
            for i in range(b.num_rows):
                at = np.unique(window_minimisers(w, i, all_grams, min_words, k))
                if len(at):
                    g = np.unique(all_grams[at + w.bounds[i]])
                    out.append(g)
                    own.append(np.full(len(g), keys[i], np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([tk.long(np.concatenate(out)), pa.array(np.concatenate(own))], ["gram", "key"])

    return run


def _runs(min_words: int, k: int):
    """Rows (id, key, text, grams): (run, id, key, start, n, windows) for each retained suffix whose gram is among grams.

    A suffix's run is the n successive windows that selected it; `run` hashes their words, and
    windows holds the windows' hashes."""

    def run(batches):
        for b in tk.slices(batches, "text"):
            w = tk.words(b.column("text"))
            all_grams, whole = _grams(w, k), _grams(w, min_words)
            ids, keys, grams = b.column("id").to_pylist(), b.column("key").to_pylist(), b.column("grams")
            out: list[tuple] = []
            for i in range(b.num_rows):
                at = window_minimisers(w, i, all_grams, min_words, k)
                if not len(at):
                    continue
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                n = np.diff(np.append(first, len(at)))
                h = whole[w.bounds[i] : w.bounds[i] + len(at)]
                name = np.add.reduceat(tk.mix(h + (np.arange(len(at)) - np.repeat(first, n)).astype(_U) * _U(0x9E3779B97F4A7C15)), first)
                live = np.isin(all_grams[at[first] + w.bounds[i]].view(np.int64), grams[i].values.to_numpy())
                out += [(int(name[j].view(np.int64)), ids[i], keys[i], int(first[j]), int(n[j]), h[first[j] : first[j] + n[j]].tobytes()) for j in np.flatnonzero(live)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _RUN_TYPES, strict=True)], _RUN_NAMES)

    return run


_RUN_NAMES = ["run", "id", "key", "start", "n", "windows"]
_RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _explode(batches):
    """Distinct runs: (window, run, i, low, high) for each window."""
    for b in batches:
        for c in range(0, b.num_rows, 4096):
            part = b.slice(c, 4096)
            h = [np.frombuffer(x, np.int64) for x in part.column("windows").to_pylist()]
            if not h:
                continue
            n = np.array([len(x) for x in h])
            ends = np.cumsum(n)
            rep = lambda name: pa.array(np.repeat(part.column(name).to_numpy(), n))  # noqa: E731, B023
            i = (np.arange(ends[-1]) - np.repeat(ends - n, n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), rep("run"), pa.array(i), rep("low"), rep("high")], ["window", "run", "i", "low", "high"])


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal span of words covered by windows of min_words words that also occur under another id:
    id_col, start_word, end_word (exclusive), n_words, least_id (the least id under which one of the windows occurs).

    Texts with fewer than min_words words, null and empty ones included, have no
    spans; a passage that repeats only under one id (within a text, or in rows that
    repeat the id) is not reported. Rows that repeat an id and a text give their
    spans once. Rows with a null id are left out. Ids must be integers or cast to them. Very long texts
    are read whole. Extra columns are not read; empty tables give no rows.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("key", F.xxhash64("id", "text"))
    suffixes = base.select("id", "text").mapInArrow(_suffixes(min_words, k), "gram long, low long, high long")
    shared = cut(suffixes.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("gram"))
    placed = base.select("text", "key").mapInArrow(_place(min_words, k), "gram long, key long")
    kept = placed.join(shared, "gram").groupBy("key").agg(F.collect_set("gram").alias("grams"))
    kinds = "run long, id long, key long, start int, n int, windows binary"
    runs = base.join(kept, "key").select("id", "key", "text", "grams").mapInArrow(_runs(min_words, k), kinds)

    distinct = runs.groupBy("run").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("windows").alias("windows"))
    windows = distinct.mapInArrow(_explode, "window long, run long, i int, low long, high long")
    seen = windows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("window", "least")
    repeats = windows.select("window", "run", "i").join(seen, "window")
    # islands of successive windows within a run
    by_run = Window.partitionBy("run").orderBy("i")
    islands = repeats.withColumn("island", F.col("i") - F.row_number().over(by_run)).groupBy("run", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min("least").alias("least"))
    # a run that very many texts hold is dealt over SALTS tasks; the islands, which are few, go to each
    salted = islands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = runs.select("run", "id", "key", "start", F.pmod(F.col("key"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["run", "salt"])
    spans = hits.select("id", "key", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + min_words).alias("e"), "least").distinct()
    before = Window.partitionBy("key", "id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key", "id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("reach", F.max("e").over(before))
    spans = spans.withColumn("span", F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") - min_words + 1), 1).otherwise(0)).over(upto))
    out = spans.groupBy("key", "id", "span").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("least").alias("least_id"))
    return out.select(F.col("id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "least_id")
