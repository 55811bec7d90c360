"""Reading orders.

Bucketed and plain orders are expressions. The tolerance sorts compare boxes
pairwise ("same line if the tops differ by less than t"), which is not transitive,
so their result depends on the sorting algorithm; they run as Python's stable sort on one page's boxes at a time.
"""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(y0: Column, x0: Column, place: Column, bucket: int = 5) -> list[Column]:
    """Sort keys: y to the nearest multiple of bucket (half to even), then x, then the place before."""
    return [(F.bround(y0 / bucket) * bucket).cast("long"), x0, place]


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "order_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def lines(df: DataFrame, keys: list[str], tolerance: float, name: str = "line_no") -> DataFrame:
    """Line numbers by gaps: a box whose top exceeds the one before by the tolerance or more begins a line. A transitive alternative to the tolerance sort."""
    w = Window.partitionBy(*keys).orderBy("top", "x0")
    new = F.coalesce((F.col("top") - F.lag("top").over(w) >= tolerance).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def tolerance_order(rows: list[dict], first: str, second: str, tolerance: float) -> list[dict]:
    """Stable sort by `first`, but by `second` where two rows' `first` differ by less than the tolerance."""
    return sorted(rows, key=cmp_to_key(lambda a, b: d if abs(d := a[first] - b[first]) >= tolerance else a[second] - b[second]))


def present(v) -> bool:
    """Neither null nor NaN, which stands for null where rows came through pandas."""
    return v is not None and v == v


def repair(rows: list[dict], label: str, second: str) -> list[dict]:
    """Move rows with a label back past neighbours with a greater label (or an equal one and a
    greater `second`); rows without the label stay where they stand and are compared with nothing.

    Each row in turn makes one full backward pass of adjacent swaps."""
    rows = list(rows)
    rank = lambda r: (r[label], r[second])
    wrong = lambda a, b: present(a[label]) and present(b[label]) and rank(b) < rank(a)
    if not any(map(wrong, rows, rows[1:])):
        return rows
    for end in range(1, len(rows)):
        for k in range(end, 0, -1):
            if wrong(rows[k - 1], rows[k]):
                rows[k - 1 : k + 1] = rows[k], rows[k - 1]
    return rows


def page_order(rows: list[dict], tolerance: float = 10) -> list[dict]:
    """By y, then x; then each row moves back while the one before is less than the tolerance above and further right."""
    rows = sorted(rows, key=lambda r: (r["top"], r["x0"]))
    for end in range(1, len(rows)):
        k = end
        while k and abs(rows[k]["top"] - rows[k - 1]["top"]) < tolerance and rows[k]["x0"] < rows[k - 1]["x0"]:
            rows[k - 1], rows[k] = rows[k], rows[k - 1]
            k -= 1
    return rows


ORDERS = {
    "y": lambda rows, t: tolerance_order(rows, "top", "x0", t),
    "x": lambda rows, t: tolerance_order(rows, "x0", "top", t),
    "R": lambda rows, t: repair(tolerance_order(rows, "top", "x0", t), "R", "x0"),
    "C": lambda rows, t: repair(tolerance_order(rows, "x0", "top", t), "C", "top"),
    "page": page_order,
}


def exact_order(df: DataFrame, keys: list[str], kind: str, tolerance: float, place: str) -> DataFrame:
    """Adds order_no from one of ORDERS within each group of keys; `place` is the order before, for ties. A group is one page or table."""
    names, how = [f.name for f in df.schema.fields], ORDERS[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = how(pdf.sort_values(place).to_dict("records"), tolerance)
        out = pd.DataFrame(rows, columns=names)
        out["order_no"] = range(1, len(rows) + 1)
        return out

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", order_no long")
