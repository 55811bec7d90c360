"""Operator 3: benchmark decontamination. DataFrame functions only.

Size-partitioned MinHash containment search, verified by exact shingle containment.

Texts keep only the shingles that occur in any item (a semi-join on the scan's
side), which changes no containment. What remains of a text is put in a
partition by its size, a power of two. In a partition of sets of up to u members
an item of q shingles that is contained at `threshold` has a Jaccard similarity of at
least t q / (u + (1 - t) q); the partition uses as many one-row bands as miss such
a pair with a probability below MISS. Where that takes more than BANDS, as for long texts that
hold many items, every item that shares a shingle is a candidate. All candidates
are verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import cut, few

BANDS = 64
MISS = 1e-9


def word_shingles(text: Column, k: int, shorter: list[int] | None = None) -> Column:
    """Hashes of the k-word shingles, repeats included; fewer words: the whole sequence as one. Letters of all scripts are lower-cased.

    shorter: lengths below k of which a text's shingles are wanted as well."""
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))

    def of(w: Column) -> Column:
        def of_length(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))

        none = F.array().cast("array<bigint>")
        found = F.when(F.size(w) >= k, of_length(k)).otherwise(F.array(F.xxhash64(w)))
        if shorter:
            found = F.concat(found, *(F.when(F.size(w) >= n, of_length(n)).otherwise(none) for n in shorter))
        return F.when(F.element_at(w, 1) == "", none).otherwise(found)

    # a one-element array binds the words, which are then split once for each text
    return F.element_at(F.transform(F.array(F.split(clean, "[\\x20\\x09-\\x0D]+", -1)), of), 1)


def _bands(u: Column, q: Column, num: int, den: int) -> Column:
    j = F.lit(num) * q / (F.lit(den) * u + F.lit(den - num) * q)
    return F.when(j >= 1, F.lit(1.0)).otherwise(F.ceil(F.lit(math.log(MISS)) / F.log1p(-j)))


def _mins(h: Column) -> Column:
    return F.array(*[F.min(F.xxhash64(h, F.lit(s))) for s in range(BANDS)])


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per text and item with den * |item & text| >= num * |item|, over distinct k-word shingles:
    id_col, item_col, n_item (the item's shingles), n_common, text_key (a hash of the row's id and text).

    An item of fewer than k words is one shingle, its whole sequence, and is found
    wherever a text holds that sequence: texts also give shingles of the lengths
    below k that occur among the items. Very long texts are taken whole.
    Null and empty texts and items match nothing. Repeated rows of docs, or of
    items, count once; one id with several texts is told apart by text_key. Null
    ids are carried. Extra columns are not read. Empty tables give no rows.
    """
    i = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(word_shingles(F.col(item_text), k))).alias("h")).distinct()
    i = cut(i.withColumn("ikey", F.xxhash64("item")))
    n_rows = i.count()
    sizes = i.groupBy("ikey").agg(F.first("item").alias("item"), F.count("*").alias("q"))
    n_items = sizes.count()
    least = sizes.agg(F.min("q")).first()[0] or 1
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(item_text), F.lit("")), "[\\x20\\x09-\\x0D]+", -1), ""))
    shorter = sorted(r.n for r in items.select(n_words.alias("n")).where((F.col("n") > 0) & (F.col("n") < k)).distinct().collect())  # at most k - 1 lengths

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), word_shingles(F.col(text_col), k, shorter).alias("s"))
    hits = rows.select("id", "key", F.explode("s").alias("h")).join(few(i.select("h").distinct(), n_rows), "h", "left_semi").distinct()
    hits = cut(hits)  # all that follows reads the few shared shingles, not the texts
    sets = hits.groupBy("key").agg(F.first("id").alias("id"), F.collect_list("h").alias("hs"), F.count("*").alias("n"), _mins(F.col("h")).alias("mins"))
    sets = sets.where(F.col("n") * den >= F.lit(num * least)).withColumn("u", F.pow(F.lit(2.0), F.ceil(F.log2("n"))))

    ibands = i.groupBy("ikey").agg(_mins(F.col("h")).alias("mins"), F.count("*").alias("q"))
    ibands = ibands.select("ikey", "q", F.posexplode("mins").alias("band", "v"))
    fit = F.col("n") * den >= F.col("q") * num
    by_band = sets.select("key", "n", "u", F.posexplode("mins").alias("band", "v")).join(few(ibands, n_items * BANDS), ["band", "v"])
    need = _bands(F.col("u"), F.col("q"), num, den)
    by_band = by_band.where(fit & (need <= BANDS) & (F.col("band") < need)).select("key", "ikey")
    # partitions too large for BANDS bands with some item
    smallest = _bands(F.col("u"), F.lit(least), num, den) > BANDS
    shared = sets.where(smallest).select("key", "n", "u", F.explode("hs").alias("h")).join(few(i.join(few(sizes.select("ikey", "q"), n_items), "ikey").select("ikey", "q", "h"), n_rows), "h")
    shared = shared.where(fit & (need > BANDS)).select("key", "ikey")

    candidates = by_band.unionByName(shared).distinct()
    pairs = candidates.join(sets.select("key", "id", "hs"), "key").select("key", "id", "ikey", F.explode("hs").alias("h"))
    common = pairs.join(few(i.select("ikey", "h"), n_rows), ["ikey", "h"]).groupBy("key", "ikey").agg(F.first("id").alias("id"), F.count("*").alias("n_common"))
    out = common.join(few(sizes, n_items), "ikey").where(F.col("n_common") * den >= F.col("q") * num)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("q").alias("n_item"), "n_common", F.col("key").alias("text_key"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose text contains an item; all columns stay, whatever their names."""
    bad = contained_items(docs, items, k, num, den).select("text_key").distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("text_key"))
    return rows.join(bad, "text_key", "left_anti").select("row.*")
