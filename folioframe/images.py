"""Image and tensor steps in NumPy, for use inside inference functions.

Interpolation is plain bilinear and does not claim to match any imaging library's pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

State = dict
Step = Callable[[State], State | None]


def decode(image: dict, mode: str = "RGB", channel_first: bool = False) -> np.ndarray:
    """Pixels of a decoded image (height, width, nChannels and data, in the order BGR, as sources.read_images gives them)
    in the order of mode, RGB or BGR. Gray images are given three channels; alpha is left out."""
    a = np.frombuffer(image["data"], np.uint8).reshape([int(image[k]) for k in ("height", "width", "nChannels")])  # pandas makes them floats beside nulls
    a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
    a = a[:, :, ::-1] if mode == "RGB" else a
    return np.ascontiguousarray(a.transpose(2, 0, 1) if channel_first else a)


def decoded(mode: str = "RGB", channel_first: bool = False) -> Step:
    """decode() as a first step; an image without data ends the chain."""
    return lambda s: {**s, "image": decode(s["image"], mode, channel_first)} if s["image"] is not None and s["image"]["data"] else None


def png(image: np.ndarray) -> bytes:
    """Gray (h, w) or RGB (h, w, 3) pixels as a PNG file."""
    h, w = image.shape[:2]
    rows = np.pad(image.astype(np.uint8).reshape(h, -1), ((0, 0), (1, 0)))  # each row begins with filter type 0

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


# LZW codes that begin a new table and that end a strip.
CLEAR, END = 256, 257


def pack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit on, a bit longer one code early, a new table before 4,095 are used."""
    out, held, n_held, width = bytearray(), 0, 0, 9
    table: dict[tuple[int, int], int] = {}

    def put(code: int) -> None:
        nonlocal held, n_held
        held, n_held = held << width | code, n_held + width
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held)
            held &= (1 << n_held) - 1

    put(CLEAR)
    prefix, free = -1, 258
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[prefix, byte] = free
        free += 1
        if free == 4094:
            put(CLEAR)
            table.clear()
            free, width = 258, 9
        elif free + 1 > 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix)
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if n_held:
        out.append(held << (8 - n_held) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """What pack_lzw packs; ends at the end code, the data's end, or after `most` bytes."""
    out = bytearray()
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, n_held, before = list(singles), 9, 0, 0, None
    for byte in data:
        held, n_held = held << 8 | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code = held >> n_held
        held &= (1 << n_held) - 1
        if code == END or (most is not None and len(out) >= most):
            break
        if code == CLEAR:
            table, width, before = list(singles), 9, None
            continue
        if before is None:
            if code > 255:
                raise ValueError("LZW code before its table")
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code beyond its table")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        before = entry
    return bytes(out)


def tiff(pages: list[np.ndarray], dpi: int = 300, packing: str = "deflate") -> bytes:
    """Gray or RGB pages as one TIFF file, losslessly compressed (deflate or lzw). No pages raise ValueError."""
    if not pages:
        raise ValueError("a TIFF file needs a page")
    pack, code = {"deflate": (zlib.compress, 8), "lzw": (pack_lzw, 5)}[packing]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4  # where the offset of the next directory goes
    for image in pages:
        h, w = image.shape[:2]
        n = 3 if image.ndim == 3 else 1
        data = pack(np.ascontiguousarray(image, np.uint8).tobytes())
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        extra = len(out)
        out += struct.pack("<3H2xII", 8, 8, 8, dpi, 1)
        # Tag, type (3 short, 4 long, 5 rational), count and value of a directory's entries, by tag.
        entries = [
            (256, 4, 1, w), (257, 4, 1, h), (258, 3, n, extra if n == 3 else 8), (259, 3, 1, code), (262, 3, 1, 2 if n == 3 else 1), (273, 4, 1, at),
            (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(data)), (282, 5, 1, extra + 8), (283, 5, 1, extra + 8), (296, 3, 1, 2),
        ]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def standardize(mean: list[float], std: list[float], scale: bool = True) -> Step:
    def run(s: State) -> State:
        x = s["image"].astype(np.float32) / (255 if scale else 1)
        return {**s, "image": (x - np.array(mean, np.float32)) / np.array(std, np.float32)}

    return run


def normalize(scale: float = 1 / 255, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225), order: str = "hwc") -> Step:
    shape = (3, 1, 1) if order == "chw" else (1, 1, 3)
    m, d = (np.array(v, np.float32).reshape(shape) for v in (mean, std))
    return lambda s: {**s, "image": (s["image"].astype(np.float32) * np.float32(scale) - m) / d}


def to_chw() -> Step:
    return lambda s: {**s, "image": np.ascontiguousarray(s["image"].transpose(2, 0, 1))}


def keep_keys(names: list[str]) -> Callable[[State], list]:
    return lambda s: [s[n] for n in names]


def pad(size: tuple[int, int] | None = None, multiple: int = 32) -> Step:
    """Zeros to the size, or up to the next multiple."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        th, tw = size or (-(-h // multiple) * multiple, -(-w // multiple) * multiple)
        return {**s, "image": np.pad(s["image"], ((0, max(0, th - h)), (0, max(0, tw - w)), (0, 0)))}

    return run


def pad_stride(stride: int) -> Step:
    """CHW zeros up to the next multiple; strides of 0 or less do nothing."""

    def run(s: State) -> State:
        if stride <= 0:
            return s
        _, h, w = s["image"].shape
        return {**s, "image": np.pad(s["image"], ((0, 0), (0, -h % stride), (0, -w % stride))).astype(np.float32)}

    return run


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    ih, iw = image.shape[:2]
    y = np.clip((np.arange(h) + 0.5) * ih / h - 0.5, 0, ih - 1)
    x = np.clip((np.arange(w) + 0.5) * iw / w - 0.5, 0, iw - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, ih - 1), np.minimum(x0 + 1, iw - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    a = image.astype(np.float64).reshape(ih, iw, -1)
    out = (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy
    return out.reshape(h, w, *image.shape[2:])


def resize_to(size: tuple[int, int]) -> Step:
    """Fixed (h, w); polygons follow."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        out = {**s, "image": resize(s["image"], *size), "scale": (size[0] / h, size[1] / w)}
        if "polys" in s:
            out["polys"] = s["polys"] * np.array([size[1] / w, size[0] / h])
        return out

    return run


def resize_limited(limit: int = 960, kind: str = "max", multiple: int = 32) -> Step:
    """Longer side at most (kind max) or shorter side at least (kind min) the limit, both rounded to the multiple."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        side = max(h, w) if kind == "max" else min(h, w)
        r = limit / side if (side > limit if kind == "max" else side < limit) else 1.0
        nh, nw = (max(round(int(v * r) / multiple) * multiple, multiple) for v in (h, w))
        return {**s, "image": resize(s["image"], nh, nw), "shape": np.array([h, w, nh / h, nw / w])}

    return run


def linear_resize(target: tuple[int, int], keep_ratio: bool = True) -> Step:
    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        if keep_ratio:
            r = min(min(target) / min(h, w), max(target) / max(h, w))
            fy = fx = r
        else:
            fy, fx = target[0] / h, target[1] / w
        return {**s, "image": resize(s["image"], round(h * fy), round(w * fx)), "scale": np.array([fy, fx], np.float32)}

    return run


def _up(v: float, multiple: int) -> int:
    return -(-int(v) // multiple) * multiple


def resize_long_side(limit: int = 512, multiple: int = 128, grow: float | None = None) -> Step:
    """Longer side to the limit, both up to the multiple; with grow, enlarged by it unless the height would pass the limit."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        r = limit / max(h, w) if grow is None else min(grow, limit / h)
        nh, nw = _up(h * r, multiple), _up(w * r, multiple)
        return {**s, "image": resize(s["image"], nh, nw), "shape": np.array([h, w, nh / h, nw / w])}

    return run


def resize_on_canvas(long: int = 1024, short: int = 512, multiple: int = 32) -> Step:
    """Fitted to both sides and laid on a square canvas; boxes (x0, y0, x1, y1, ...) in `points` follow, clipped to the image as it was."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        r = min(long / max(h, w), short / min(h, w))
        nh, nw = (_up(int(v * r + 0.5), multiple) for v in (h, w))
        canvas = np.zeros((long, long, s["image"].shape[2]), np.float32)
        canvas[:nh, :nw] = resize(s["image"], nh, nw)[:long, :long]
        out = {**s, "image": canvas, "shape": np.array([nh, nw])}
        if "points" in s:
            out["points"] = np.clip(s["points"] * np.array([nw / w, nh / h] * (s["points"].shape[1] // 2)), 0, np.array([w, h] * (s["points"].shape[1] // 2)))
        return out

    return run


def resize_normalize(width: int, height: int, source: str = "image", name: str = "image") -> Step:
    """CHW of a fixed size, from 0 to 1, from the state's `source` to its `name`."""
    return lambda s: {**s, name: resize(s[source], height, width).astype(np.float32).transpose(2, 0, 1) / 255}


def super_resolution(width: int = 128, height: int = 32, shrink: int = 4, training: bool = False) -> Step:
    """image_lr to img_lr, smaller by `shrink`; in training also image_hr to img_hr, in full size."""
    low = resize_normalize(width // shrink, height // shrink, "image_lr", "img_lr")
    high = resize_normalize(width, height, "image_hr", "img_hr")
    return (lambda s: high(low(s))) if training else low


def line_input(height: int = 32, least: int = 32, most: int = 512) -> Step:
    """A line of text as a batch of one: the given height, the width in proportion, up to the next ten and within both bounds."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        width = min(max(_up(height * w / h, 10), least), most)
        out = resize_normalize(width, height)(s)
        return {**out, "image": out["image"][None]}

    return run


def permute(order: tuple[int, ...] = (2, 0, 1)) -> Step:
    return lambda s: {**s, "image": np.ascontiguousarray(s["image"].transpose(order))}


def crop(x0: int, y0: int, x1: int, y1: int, pad: int = 4) -> Step:
    """A box with a margin, kept inside the image."""

    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        return {**s, "image": s["image"][max(0, y0 - pad) : min(h, y1 + pad), max(0, x0 - pad) : min(w, x1 + pad)]}

    return run


def upright(image: np.ndarray) -> np.ndarray:
    """Turned by a quarter if at least one and a half times as high as wide."""
    return np.rot90(image) if image.shape[0] >= 1.5 * image.shape[1] else image


def stack_crops(crops: list[np.ndarray], cell: int = 60, label: int = 40, gap: int = 4, width: int = 1400, shade: int = 240) -> np.ndarray:
    """Crops below one another, each at the cell's height and right of room for its label; cells start every cell + gap."""
    out = np.full(((cell + gap) * len(crops) + gap, width, 3), shade, np.float64)
    for n, image in enumerate(crops):
        h, w = image.shape[:2]
        fit = min(int(w * cell / max(h, 1)), width - label - 2 * gap)
        if fit > 0 and h:
            y = gap + n * (cell + gap)
            out[y : y + cell, label : label + fit] = resize(image, cell, fit)
    return out


def uncovered_box(width: int, height: int, regions: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int] | None:
    """Bounding box (x1, y1 exclusive) of what regions (edges included) leave uncovered; None if nothing is left."""
    free = np.ones((height, width), bool)
    for x0, y0, x1, y1 in regions:
        free[max(0, y0) : y1 + 1, max(0, x0) : x1 + 1] = False
    ys, xs = np.flatnonzero(free.any(axis=1)), np.flatnonzero(free.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def gray(inverse: bool = False) -> Step:
    """One channel of BGR weights in front; inverse: its distance from 1."""

    def run(s: State) -> State:
        g = (s["image"] @ np.array([0.114, 0.587, 0.299]))[None]
        return {**s, "image": np.abs(g - 1) if inverse else g}

    return run


def letterbox(size: tuple[int, int], border: int = 114) -> Step:
    def run(s: State) -> State:
        h, w = s["image"].shape[:2]
        r = min(size[0] / h, size[1] / w)
        nh, nw = round(h * r), round(w * r)
        top, left = (size[0] - nh) / 2, (size[1] - nw) / 2
        out = np.full((*size, s["image"].shape[2]), border, np.float64)
        y, x = round(top - 0.1), round(left - 0.1)
        out[y : y + nh, x : x + nw] = resize(s["image"], nh, nw)
        return {**s, "image": out, "ratio": r, "pad": (top, left)}

    return run


def batch_padded(images: list[np.ndarray]) -> np.ndarray:
    """CHW images stacked, zeros up to the largest."""
    h, w = (max(i.shape[k] for i in images) for k in (1, 2))
    return np.stack([np.pad(i, ((0, 0), (0, h - i.shape[1]), (0, w - i.shape[2]))) for i in images])


def box_score(prob: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> float:
    """Mean probability inside a box, edges included."""
    return float(prob[max(0, y0) : y1 + 1, max(0, x0) : x1 + 1].mean())


def expand_rectangle(w: float, h: float, ratio: float = 1.5) -> float:
    """How far a rectangle's edges move out when its polygon is offset by area * ratio / perimeter."""
    return w * h * ratio / (2 * (w + h))


STEPS: dict[str, Callable[..., Step]] = {
    "standardize": standardize, "normalize": normalize, "to_chw": to_chw, "pad": pad, "pad_stride": pad_stride, "resize": resize_to,
    "resize_limited": resize_limited, "linear_resize": linear_resize, "gray": gray, "letterbox": letterbox,
    "resize_long_side": resize_long_side, "resize_on_canvas": resize_on_canvas, "permute": permute, "crop": crop,
    "decoded": decoded, "resize_normalize": resize_normalize, "super_resolution": super_resolution, "line_input": line_input,
}


def chain(specs: list[dict[str, dict]]) -> Step:
    """Steps from one-key dicts of name and parameters; a step that gives None ends the chain. Unknown names raise KeyError."""
    steps = [STEPS[name](**params) for spec in specs for name, params in spec.items()]

    def run(s: State) -> State | None:
        for step in steps:
            if s is None:
                return None
            s = step(s)
        return s

    return run
