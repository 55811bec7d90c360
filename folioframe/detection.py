"""Text lines of page images: probability maps to quadrilaterals, crops, and a page reader for `inference.infer`.

Networks are given as functions: a detector from a batch (n, channels, h, w) to probability maps (n, 1, h, w), a
reader from a list of crops to (text, score) pairs. All steps are NumPy. Rotated rectangles are offset in closed form,
so corners may differ by a pixel from libraries that round polygons to integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from folioframe import images
from folioframe.inference import Model
from folioframe.operators.reading_order import page_order

Detector = Callable[[np.ndarray], np.ndarray]
Reader = Callable[[list[np.ndarray]], list[tuple[str, float]]]
LINES = "width int, height int, lines array<struct<quad:array<struct<x:double,y:double>>,text:string,score:double>>"


def runs(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end (exclusive) and component of the horizontal runs of true pixels; components are numbered from 0 in order of their first run."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    step, side = mask.shape[1] + 2, ("left", "right") if diagonal else ("right", "left")
    lo = np.searchsorted(row * step + end, (row + 1) * step + start, side[0])
    hi = np.searchsorted(row * step + start, (row + 1) * step + end, side[1])
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    label = np.arange(len(row))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
    return row, start, end, np.unique(label, return_inverse=True)[1]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in turn."""

    def chain(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    ps = np.unique(np.asarray(points, float), axis=0).tolist()
    return np.array(ps if len(ps) < 3 else chain(ps)[:-1] + chain(ps[::-1])[:-1])


class Rectangle:
    """The rectangle of least area around points, at any angle."""

    def __init__(self, points: np.ndarray):
        h = hull(points)
        along = np.roll(h, -1, axis=0) - h
        length = np.hypot(*along.T)
        u = along[length > 0] / length[length > 0, None] if (length > 0).any() else np.array([[1.0, 0.0]])
        v = np.stack([-u[:, 1], u[:, 0]], axis=1)
        p, q = h @ u.T, h @ v.T
        best = int(np.argmin(np.ptp(p, axis=0) * np.ptp(q, axis=0)))
        self.axes = np.stack([u[best], v[best]])
        ends = np.array([[s[:, best].min(), s[:, best].max()] for s in (p, q)])
        self.sides, self.center = ends[:, 1] - ends[:, 0], ends.mean(axis=1) @ self.axes

    def corners(self) -> np.ndarray:
        """Top left, top right, bottom right, bottom left: the two leftmost and the two rightmost, each by height."""
        signs = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])
        c = self.center + (signs * self.sides / 2) @ self.axes
        c = c[np.argsort(c[:, 0], kind="stable")]
        left, right = (half[np.argsort(half[:, 1], kind="stable")] for half in (c[:2], c[2:]))
        return np.array([left[0], right[0], right[1], left[1]])

    def expand(self, ratio: float) -> Rectangle:
        """Every edge moved out by area * ratio / perimeter."""
        if self.sides.sum() > 0:
            self.sides = self.sides + 2 * images.expand_rectangle(*self.sides, ratio)
        return self


def expand_polygon(points: np.ndarray, ratio: float, arcs: int = 32) -> np.ndarray:
    """The convex hull of a polygon, offset by its area * ratio / perimeter with round joins."""
    h = hull(points)
    x, y = h.T
    length = np.hypot(*(np.roll(h, -1, axis=0) - h).T).sum()
    d = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 * ratio / length if length else 0.0
    turn = np.linspace(0, 2 * np.pi, arcs, endpoint=False)
    return hull((h[:, None] + d * np.stack([np.cos(turn), np.sin(turn)], axis=1)).reshape(-1, 2))


def polygon_score(prob: np.ndarray, points: np.ndarray) -> float:
    """Mean probability of the pixels within half a pixel of a convex polygon, its corners cut to integers."""
    h, w = prob.shape
    x0, y0 = np.clip(np.floor(points.min(axis=0)).astype(int), 0, [w - 1, h - 1])
    x1, y1 = np.clip(np.ceil(points.max(axis=0)).astype(int), 0, [w - 1, h - 1])
    c = hull((points - [x0, y0]).astype(int))
    y, x = np.mgrid[: y1 - y0 + 1, : x1 - x0 + 1]
    inside = np.ones(y.shape, bool)
    for a, b in zip(c, np.roll(c, -1, axis=0), strict=True):
        d = b - a
        inside &= (d[0] * (y - a[1]) - d[1] * (x - a[0])) >= -0.5 * np.hypot(*d)
    return float(prob[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def filled_score(prob: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> float:
    """Mean probability of a component's pixels and of the holes that it encloses."""
    top, left = row.min(), start.min()
    free = np.ones((row.max() - top + 3, end.max() - left + 2), bool)
    for r, a, b in zip(row - top + 1, start - left + 1, end - left + 1, strict=True):
        free[r, a:b] = False
    fr, fa, fb, label = runs(free, diagonal=False)
    outside = np.zeros_like(free)
    for r, a, b in zip(*(v[label == 0] for v in (fr, fa, fb)), strict=True):
        outside[r, a:b] = True
    kept = ~outside[1:-1, 1:-1]
    return float(prob[top : top + kept.shape[0], left : left + kept.shape[1]][kept].mean())


def dilate(mask: np.ndarray) -> np.ndarray:
    """Every pixel also marks its right, lower and lower right neighbour."""
    p = np.pad(mask, ((1, 0), (1, 0)))
    return p[1:, 1:] | p[:-1, 1:] | p[1:, :-1] | p[:-1, :-1]


def text_regions(
    prob: np.ndarray, width: int, height: int, threshold: float = 0.3, least_score: float = 0.5, ratio: float = 1.5, least_side: int = 3,
    dilated: bool = False, score: str = "fast", kind: str = "quad", most: int | None = None,
) -> list[tuple[np.ndarray, float]]:
    """Regions of a probability map with their scores, in an image of width x height; an empty map has none.

    Pixels above the threshold form components (8 neighbours; holes are no regions of their own). kind "quad" gives four
    corners from the top left clockwise, "poly" the offset convex hull. score "fast" is taken in the rectangle, "slow" in the
    component. `most` keeps the first components only; by default all count.
    """
    if kind not in ("quad", "poly") or score not in ("fast", "slow"):
        raise ValueError(f"kind {kind}, score {score}")
    mask = prob > threshold
    row, start, end, label = runs(dilate(mask) if dilated else mask)
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []
    scale, out = np.array([width / prob.shape[1], height / prob.shape[0]]), []
    for part in parts[:most]:
        r, a, b = row[part], start[part], end[part]
        points = np.concatenate([np.stack([a, r], axis=1), np.stack([b - 1, r], axis=1)])
        box = Rectangle(points)
        if kind == "quad" and box.sides.min() < least_side or kind == "poly" and len(hull(points)) < 4:
            continue
        around = box.corners() if kind == "quad" else hull(points)
        value = filled_score(prob, r, a, b) if score == "slow" else polygon_score(prob, around)
        if value < least_score:
            continue
        around = box.expand(ratio).corners() if kind == "quad" else expand_polygon(points, ratio)
        if (box if kind == "quad" else Rectangle(around)).sides.min() < least_side + 2:
            continue
        out.append((np.clip(np.round(around * scale), 0, [width, height]), value))
    return out


def clipped(quad: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """Corners clockwise from the top left by sums and differences, as whole pixels of the image; None if 3 pixels or less wide or high."""
    total = quad.sum(axis=1)
    first, last = int(np.argmin(total)), int(np.argmax(total))
    rest = np.delete(quad, [first, last], axis=0) if first != last else quad[:2]
    slant = rest[:, 1] - rest[:, 0]
    q = np.array([quad[first], rest[np.argmin(slant)], quad[last], rest[np.argmax(slant)]])
    q = np.trunc(np.clip(q, 0, [width - 1, height - 1]))
    return None if min(int(np.hypot(*(q[0] - q[1]))), int(np.hypot(*(q[0] - q[3])))) <= 3 else q


def quad_crop(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrilateral (clockwise from the top left) drawn upright: as wide and high as its longer edges, bilinear, the image's
    edge pixels beyond it, turned by a quarter if high (`images.upright`). Without width or height it is one pixel there."""
    q = np.asarray(quad, float)
    if q.shape != (4, 2):
        raise ValueError("four corners are needed")
    w = max(1, int(max(np.hypot(*(q[0] - q[1])), np.hypot(*(q[2] - q[3])))))
    h = max(1, int(max(np.hypot(*(q[0] - q[3])), np.hypot(*(q[1] - q[2])))))
    flat = [(0, 0), (w, 0), (w, h), (0, h)]
    rows = [[x, y, 1, 0, 0, 0, -x * u, -y * u] for (x, y), (u, _) in zip(flat, q, strict=True)]
    rows += [[0, 0, 0, x, y, 1, -x * v, -y * v] for (x, y), (_, v) in zip(flat, q, strict=True)]
    m = np.append(np.linalg.lstsq(np.array(rows, float), q.T.ravel(), rcond=None)[0], 1).reshape(3, 3)
    y, x = np.mgrid[:h, :w]
    u, v, z = np.tensordot(m, np.stack([x, y, np.ones_like(x)]), 1)
    u, v = (np.clip(s / z, 0, n - 1) for s, n in ((u, image.shape[1]), (v, image.shape[0])))
    u0, v0 = u.astype(int), v.astype(int)
    u1, v1 = np.minimum(u0 + 1, image.shape[1] - 1), np.minimum(v0 + 1, image.shape[0] - 1)
    fu, fv = (s.reshape(s.shape + (1,) * (image.ndim - 2)) for s in (u - u0, v - v0))
    out = (image[v0, u0] * (1 - fu) + image[v0, u1] * fu) * (1 - fv) + (image[v1, u0] * (1 - fu) + image[v1, u1] * fu) * fv
    return images.upright(np.round(out).astype(image.dtype) if image.dtype.kind in "iu" else out)


def detect_lines(image: np.ndarray, detector: Detector, prepare: list[dict[str, dict]] | None = None, **options) -> list[np.ndarray]:
    """Quadrilaterals of an RGB image's lines in reading order; options are those of text_regions()."""
    h, w = image.shape[:2]
    steps = [{"resize_limited": {}}, {"normalize": {}}, {"to_chw": {}}] if prepare is None else prepare
    state = images.chain(steps)({"image": image})
    if state is None:
        return []
    prob = detector(state["image"][None].astype(np.float32))[0, 0]
    kept = [q for box, _ in text_regions(prob, w, h, **options) if (q := clipped(box, w, h)) is not None]
    return [r["quad"] for r in page_order([{"top": q[0, 1], "x0": q[0, 0], "quad": q} for q in kept])]


def page_reader(
    detector: Callable[[], Detector], reader: Callable[[], Reader] | None, least: float = 0.5, prepare: list[dict[str, dict]] | None = None, **options
) -> Callable[[], Model]:
    """A factory for infer(..., LINES): rows with `image` (as sources.read_images gives it) to their lines, in reading order.

    Lines read with a score below `least` go. Without a reader, lines have an empty text and score 0. If a row has
    `regions` (structs of x0, y0, x1, y1), only the box around what they leave uncovered is read. A null image has no lines.
    """

    def factory() -> Model:
        find, read = detector(), reader() if reader else None

        def page(row: dict) -> dict:
            if row["image"] is None:
                return {"width": None, "height": None, "lines": []}
            image = images.decode(row["image"])
            h, w = image.shape[:2]
            taken = row.get("regions")
            free = (0, 0, w, h) if taken is None else images.uncovered_box(w, h, [tuple(int(r[k]) for k in ("x0", "y0", "x1", "y1")) for r in taken])
            if free is None:
                return {"width": w, "height": h, "lines": []}
            image = image[free[1] : free[3], free[0] : free[2]]
            quads = detect_lines(image, find, prepare, **options)
            texts = read([quad_crop(image, q) for q in quads]) if read and quads else [("", 0.0)] * len(quads)
            lines = [
                {"quad": [{"x": float(x), "y": float(y)} for x, y in q + free[:2]], "text": text, "score": float(score)}
                for q, (text, score) in zip(quads, texts, strict=True)
                if read is None or score >= least
            ]
            return {"width": w, "height": h, "lines": lines}

        return lambda rows: [page(r) for r in rows]

    return factory


#: Post-processing by name, for configurations; a name of None means none.
POST: dict[str, Callable] = {"text_regions": text_regions}


def post_process(config: dict) -> Callable | None:
    """From {"name": ..., parameters}: a function of the remaining arguments; unknown names raise ValueError."""
    name, params = config["name"], {k: v for k, v in config.items() if k != "name"}
    if name in (None, "None"):
        return None
    if name not in POST:
        raise ValueError(f"{name} is none of {sorted(POST)}")
    return lambda *args: POST[name](*args, **params)
