"""Decoding of recognizer outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ids before the vocabulary's characters, and the default charset.
GO, EOS, SPECIALS = 1, 2, 4
CHARSET = "0123456789abcdefghijklmnopqrstuvwxyz"


def ctc_keep(ids: Column) -> Column:
    """Places of ids that are not blank (0) and differ from the one before."""
    return F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: (ids[i] != 0) & ((i == 0) | (ids[i] != F.get(ids, i - 1))))


def ctc_text(ids: Column, charset: str = CHARSET) -> Column:
    chars = F.array(F.lit(""), *[F.lit(c) for c in charset])
    return F.when(F.size(ids) > 0, F.array_join(F.transform(ctc_keep(ids), lambda i: F.get(chars, ids[i])), "")).otherwise("")


def ctc_confidence(ids: Column, probs: Column) -> Column:
    """Mean probability of the kept places; 0 if none is kept."""
    kept = F.transform(ctc_keep(ids), lambda i: probs[i])
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(ids) > 0) & (F.size(kept) > 0), total / F.size(kept)).otherwise(0.0)


def argmax(a: Column) -> Column:
    """Place of the first largest value, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def encode(text: Column, charset: str) -> Column:
    chars = F.array(*[F.lit(c) for c in charset])
    ids = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.array_position(chars, c) - 1 + SPECIALS).cast("int"))
    return F.concat(F.array(F.lit(GO)), ids, F.array(F.lit(EOS)))


def decode(ids: Column, charset: str) -> Column:
    """From after a leading go id, if there is one anywhere, to the first end id."""
    chars = F.array(*[F.lit(c) for c in charset])
    first = F.when(F.array_contains(ids, GO), 2).otherwise(1)
    end = F.array_position(ids, EOS)
    last = F.when(end > 0, end - 1).otherwise(F.size(ids)).cast("int")
    kept = F.when(last >= first, F.slice(ids, first, last - first + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(kept, lambda i: F.get(chars, i - SPECIALS)), "")
