"""Boxes as four columns (x0, y0, x1, y1) or structs with those fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def field(cls, s: Column) -> Box:
        return cls(s["x0"], s["y0"], s["x1"], s["y1"])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2

    @property
    def area(self) -> Column:
        return self.width * self.height


def disjoint(a: Box, b: Box) -> Column:
    """Boxes that touch are not disjoint."""
    return (a.x1 < b.x0) | (b.x1 < a.x0) | (a.y1 < b.y0) | (b.y1 < a.y0)


def shared_area(a: Box, b: Box) -> Column:
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when(disjoint(a, b), 0).otherwise(F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Shared area over a's; 0 for an empty a."""
    return F.when(a.area > 0, shared_area(a, b) / a.area).otherwise(0.0)


def iou(a: Box, b: Box, plus: int = 0) -> Column:
    """Intersection over union; `plus` widens only the intersection, as some detectors do."""
    w = F.greatest(F.lit(0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0) + plus)
    h = F.greatest(F.lit(0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0) + plus)
    both = w * h
    return both / (a.area + b.area - both)


def keep_by_nms(boxes: Column, kind: str, threshold: float, plus: int = 0, strict: bool = False) -> Column:
    """Greedy non-maximum suppression of array<struct<score,idx,x0,y0,x1,y1>> (element type `kind`).

    By score, then idx, both descending. A box goes if its IoU with a kept one
    exceeds the threshold, or with strict also if it equals it."""
    order = lambda a, b: F.when(
        (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["idx"] > b["idx"])), -1
    ).otherwise(F.when((a["score"] == b["score"]) & (a["idx"] == b["idx"]), 0).otherwise(1))

    def step(acc: Column, b: Column) -> Column:
        hit = lambda k: (iou(Box.field(k), Box.field(b), plus) >= threshold) if strict else (iou(Box.field(k), Box.field(b), plus) > threshold)
        return F.when(F.exists(acc, hit), acc).otherwise(F.array_append(acc, b))

    return F.aggregate(F.array_sort(boxes, order), F.array().cast(f"array<{kind}>"), step)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [(cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1")]


def corners(q: Column) -> Column:
    """Corners of array<struct<x,y>> clockwise from the top left, by sums and differences of coordinates."""
    indexed = F.transform(q, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), (p["y"] - p["x"]).alias("d"), i.alias("i"), p.alias("p")))

    def of(a: Column) -> Column:
        tl = F.array_sort(a, lambda u, v: _compare(u, v, "s", 1))[0]
        br = F.array_sort(a, lambda u, v: _compare(u, v, "s", -1))[0]
        rest = F.array_sort(F.filter(a, lambda u: (u["i"] != tl["i"]) & (u["i"] != br["i"])), lambda u, v: _compare(u, v, "d", 1))
        return F.array(tl["p"], rest[0]["p"], br["p"], F.element_at(rest, -1)["p"])

    return F.element_at(F.transform(F.array(indexed), of), 1)


def _compare(u: Column, v: Column, f: str, sign: int) -> Column:
    """By f, in the order of sign, then by place."""
    less = u[f] < v[f] if sign > 0 else u[f] > v[f]
    return F.when(less, -1).when(u[f] == v[f], F.when(u["i"] < v["i"], -1).when(u["i"] == v["i"], 0).otherwise(1)).otherwise(1)


def clip_point(x: Column, y: Column, h: Column, w: Column) -> list[Column]:
    return [F.least(F.greatest(x, F.lit(0)), w - 1).cast("int"), F.least(F.greatest(y, F.lit(0)), h - 1).cast("int")]


def quad_box(q: Column, scale: Column) -> list[Column]:
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return [F.array_min(xs) / scale, F.array_min(ys) / scale, F.array_max(xs) / scale, F.array_max(ys) / scale]


def large_enough(b: Box, least: int = 5) -> Column:
    return (b.width >= least) & (b.height >= least)


# The page that results are drawn on, its margin and line spacing.
A4_WIDTH, A4_HEIGHT, MARGIN, SPACING = 595, 842, 20, 1.1


def scale_x(v: Column, source: Column) -> Column:
    return v / source * (A4_WIDTH - 2 * MARGIN) + MARGIN


def scale_y(v: Column, source: Column) -> Column:
    middle = (A4_HEIGHT - 2 * MARGIN) / 2 + MARGIN
    return F.lit(middle) + (v / source * (A4_HEIGHT - 2 * MARGIN) + MARGIN - middle) * SPACING


def rescale(v: Column, width: Column, target: Column) -> Column:
    """Rounded half to even and clipped to [0, target]."""
    return F.least(F.greatest(F.bround(v / width * target), F.lit(0)), target)


def recognizer_width(w: Column, h: Column, height: int = 32, least: int = 32, most: int = 512) -> Column:
    """Width at the recognizer's height, up to the next ten, clamped."""
    return F.least(F.greatest(F.ceil(F.floor(height * w / h) / 10) * 10, F.lit(least)), F.lit(most)).cast("int")


def detector_size(side: Column, other: Column, limit: int = 960) -> Column:
    """A side limited by the longer one, rounded half to even to a multiple of 32, at least 32."""
    longest = F.greatest(side, other)
    ratio = F.when(longest > limit, F.lit(float(limit)) / longest).otherwise(1.0)
    return F.greatest((F.bround((side * ratio).cast("int") / 32) * 32).cast("int"), F.lit(32))


def crop_window(b: Box, width: Column, height: Column, pad: int = 4) -> list[Column]:
    to = lambda c: c.cast("int")
    zero = F.lit(0)
    return [F.greatest(to(b.x0) - pad, zero), F.greatest(to(b.y0) - pad, zero), F.least(to(b.x1) + pad, width), F.least(to(b.y1) + pad, height)]


def fit_scale(w: Column, h: Column, most: int = 2000) -> Column:
    return F.when(F.greatest(w, h) > most, F.lit(float(most)) / F.greatest(w, h)).otherwise(1.0)


def letterbox(w: Column, h: Column, width: int, height: int) -> list[Column]:
    """(ratio, pad_x, pad_y) of an image fitted into width x height."""
    r = F.least(F.lit(height) / h, F.lit(width) / w)
    return [r.alias("ratio"), ((width - F.round(w * r)) / 2).alias("pad_x"), ((height - F.round(h * r)) / 2).alias("pad_y")]


def grid_cell(w: Column, h: Column, row: Column, label: int = 40, pad: int = 4, cell: int = 60, most: int = 1400) -> list[Column]:
    """(width, y) of a block's crop in the stacked image sent to a model."""
    return [F.least((w * cell / h).cast("int"), F.lit(most - label - 2 * pad)).alias("cell_w"), (pad + row * (cell + pad)).alias("cell_y")]
