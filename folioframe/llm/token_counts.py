"""Operator 5: token counts from an exact length histogram.

Every document is encoded whole; documents are aggregated by encoded length, and
suffix sums over the histogram answer totals, quantiles and truncated totals for
every context limit without touching the documents again.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk
from folioframe.llm.shared import cut

#: Lengths per block of the two-level suffix sums.
BLOCK = 1024
# Fixed value: how byte-level BPE vocabularies split a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space from here on are taken out before the pattern, whose engine has no stack for very long ones.
LONG_RUN = 1000
#: White space as the pattern's engine has it, which isn't Python's `\s`.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def n_tokens(enc, text: str) -> int:
    """The tokens of a text of any length.

    Where a long run of white space stands, the pattern takes all of it but its last character as one piece (all of it, at
    the text's end); what stands before it and what follows are split as if they stood alone."""
    n, start = 0, 0
    for m in BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[start : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        start = end
    return n + len(enc.encode_ordinary(text[start:]))


def encoded_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) for each row; null and empty texts have 0 tokens, very long ones are encoded whole.

    vocabulary: path, on the driver, of a file of `base64-token rank` lines; its bytes
    travel to the tasks (about 1 MB). Repeated rows each give a row."""
    with open(vocabulary, "rb") as f:
        lines = f.read()

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in tk.slices(batches, "text"):
            n = [n_tokens(enc, t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs: n_tokens, n_docs, docs_at_least and tokens_at_least
    (suffix sums), docs_at_most and cumulative_share (quantiles: the least length whose
    share reaches q), and truncated_total: all documents' tokens when each is cut at n_tokens.

    The suffix sums are taken inside blocks of BLOCK lengths and over the
    blocks' totals, so only the blocks' totals meet in one task; they are broadcast, at most one row for BLOCK tokens of the longest text.
    The counts are written once, as two branches read them. A null length counts as none; an empty table gives no rows."""
    h = cut(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    h = h.withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("d", F.sum("n_docs").over(own)).withColumn("t", F.sum("tokens").over(own)).join(F.broadcast(totals), "block")
    at_least, tokens_at_least = F.col("d") + F.col("docs_later"), F.col("t") + F.col("tokens_later")
    at_most = F.col("all_docs") - at_least + F.col("n_docs")
    return h.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        at_most.alias("docs_at_most"),
        (at_most / F.col("all_docs")).alias("cumulative_share"),
        (F.col("all_tokens") - tokens_at_least + at_least * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total): tokens kept when every document is cut at the limit, for any limits.

    Each limit is answered from the suffix sums of the least length that reaches it, which one aggregation finds for all limits; a limit
    beyond every length keeps all tokens. Equal limits give a row each; without documents the totals are null."""
    reached = lambda x: F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") >= x, F.col("n_tokens")))
    found = histogram.agg(
        F.max("tokens_at_least").alias("all_tokens"), F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context_limit"), reached(int(x)).alias("cut")) for x in limits]).alias("cuts")
    )
    found = found.select("all_tokens", F.explode("cuts").alias("x")).select("all_tokens", "x.context_limit", "x.cut")
    longer = F.col("cut.docs_at_least") * F.col("context_limit") - F.col("cut.tokens_at_least")
    return found.select("context_limit", (F.col("all_tokens") + F.coalesce(longer, F.lit(0))).alias("total"))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents does not exceed; None without documents."""
    return histogram.where(F.col("cumulative_share") >= q).agg(F.min("n_tokens")).first()[0]
