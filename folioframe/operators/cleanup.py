"""Removing overlapping regions of the same type, neighbours in order first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _apart(a: dict, b: dict) -> bool:
    return a["x1"] < b["x0"] or b["x1"] < a["x0"] or a["y1"] < b["y0"] or b["y1"] < a["y0"]


def _shared(a: dict, b: dict) -> float:
    if _apart(a, b):
        return 0.0
    return (min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * (min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))


def _cover(a: dict, b: dict) -> float:
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return _shared(a, b) / area if area else 0.0


def keep_apart(regions: list[dict], far: int, threshold: float, boxes: list[dict] = ()) -> list[dict]:
    """Each region in order meets the first of its type that overlaps it among the far - 1 that
    follow. If either covers the threshold of the other, one goes: the lower score or, where a score is 0 or
    missing, the one that covers less of the boxes; equal ones: the earlier."""
    left = list(regions)
    i = 0
    while i + 1 < len(left):
        one = left[i]
        near = range(i + 1, min(i + far, len(left)))
        j = next((k for k in near if left[k].get("type") == one.get("type") and not _apart(one, left[k])), None)
        if j is None or max(_cover(one, left[j]), _cover(left[j], one)) < threshold:
            i += 1
            continue
        weigh = (lambda r: r["score"]) if one.get("score") and left[j].get("score") else (lambda r: sum(_shared(b, r) for b in boxes))
        del left[j if weigh(one) > weigh(left[j]) else i]
    return left


def drop_overlapping(regions: DataFrame, far: int = 2, threshold: float = 0.7) -> DataFrame:
    """keep_apart on each page of (page, idx, type, score, x0, y0, x1, y1), by idx."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = keep_apart(pdf.sort_values("idx").to_dict("records"), far, threshold)
        return pd.DataFrame(kept, columns=pdf.columns)

    return regions.groupBy("page").applyInPandas(run, regions.schema)
