"""Text regions, crops, codecs and the page reader, on drawn images and stub networks."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe import detection as d
from folioframe import images, inference, sources
from folioframe.plans import documents


def flood(mask, diagonal):
    """Components by brute force: sets of pixels."""
    left, out = set(zip(*np.nonzero(mask), strict=True)), set()
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or a * b == 0]
    while left:
        todo, found = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            found.add((int(y), int(x)))
            for a, b in near:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        out.add(frozenset(found))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**6), st.booleans())
def test_components_equal_flood_fill(h, w, seed, diagonal):
    mask = np.random.default_rng(seed).random((h, w)) < 0.5
    found = {}
    for r, a, b, c in zip(*d.runs(mask, diagonal), strict=True):
        found.setdefault(c, set()).update((int(r), x) for x in range(a, b))
    assert set(map(frozenset, found.values())) == flood(mask, diagonal)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(0, 10**6))
def test_rectangle_holds_all_points_and_no_angle_is_smaller(n, seed):
    points = np.random.default_rng(seed).integers(0, 40, (n, 2))
    box = d.Rectangle(points)
    assert (np.abs((points - box.center) @ box.axes.T) <= box.sides / 2 + 1e-6).all()
    for t in np.linspace(0, np.pi / 2, 91):
        u = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        assert np.prod(box.sides) <= np.prod(np.ptp(points @ u.T, axis=0)) + 1e-6


def test_regions_of_a_map():
    prob = np.zeros((40, 60))
    prob[5:15, 10:41] = 0.9
    prob[25:35, 10:21] = 0.4  # too unsure
    prob[30, 50] = 1  # too small
    (quad, score), = d.text_regions(prob, 120, 80)
    assert score == pytest.approx(0.9)
    # sides 30 x 9, moved out by 270 * 1.5 / 78 on each edge, then doubled
    out = 270 * 1.5 / 78
    assert quad.tolist() == np.round(np.array([[10 - out, 5 - out], [40 + out, 5 - out], [40 + out, 14 + out], [10 - out, 14 + out]]).clip(0) * 2).tolist()
    assert len(d.text_regions(prob, 60, 40, least_score=0.3)) == 2 and d.text_regions(prob * 0, 60, 40) == []
    assert len(d.text_regions(prob, 60, 40, least_score=0.3, most=1)) == 1
    poly, _ = d.text_regions(prob, 60, 40, kind="poly")[0]
    assert np.abs(poly.min(axis=0) - [10 - out, 0]).max() <= 1 and np.abs(poly.max(axis=0) - [40 + out, 14 + out]).max() <= 1
    with pytest.raises(ValueError):
        d.text_regions(prob, 60, 40, kind="circle")


def test_slow_score_counts_enclosed_holes():
    prob = np.full((9, 9), 0.8)
    prob[3:6, 3:6] = 0
    prob[0] = 0
    assert d.filled_score(prob, *d.runs(prob > 0.3)[:3]) == pytest.approx((72 - 9) * 0.8 / 72)
    prob[3:6, 3:] = 0  # the hole is open now
    assert d.filled_score(prob, *d.runs(prob > 0.3)[:3]) == pytest.approx(0.8)
    assert np.argwhere(d.dilate(np.eye(3, dtype=bool)[:1])).tolist() == [[0, 0], [0, 1]]


def test_corners_are_ordered_clipped_and_small_quads_go():
    quad = np.array([[90.0, 50], [-5, 10], [90, 10], [-5, 50]])
    assert d.clipped(quad, 80, 45).tolist() == [[0, 10], [79, 10], [79, 44], [0, 44]]
    assert d.clipped(quad * [1, 0.05], 80, 45) is None
    assert d.clipped(np.ones((4, 2)), 80, 45) is None


def test_crops_follow_the_quadrilateral():
    image = np.random.default_rng(1).integers(0, 255, (50, 70, 3)).astype(np.uint8)
    assert (d.quad_crop(image, [[10, 20], [40, 20], [40, 30], [10, 30]]) == image[20:30, 10:40]).all()
    turned = d.quad_crop(image, [[40, 20], [40, 50], [10, 50], [10, 20]])  # its first edge runs down
    assert turned.shape == (30, 30, 3) and (turned[0, :29] == image[20:49, 40]).all()
    high = d.quad_crop(image, [[10, 10], [20, 10], [20, 40], [10, 40]])
    assert (high == np.rot90(image[10:40, 10:20])).all()
    assert d.quad_crop(image, [[5, 5]] * 4).shape[2] == 3
    with pytest.raises(ValueError):
        d.quad_crop(image, [[0, 0]] * 3)


def test_post_process_by_name():
    prob = np.pad(np.ones((10, 20)), 10)
    assert len(d.post_process({"name": "text_regions", "ratio": 2.0})(prob, 40, 30)) == 1
    assert d.post_process({"name": "None"}) is None
    with pytest.raises(ValueError):
        d.post_process({"name": "other"})


def pixels(png):
    """A PNG file as images.png writes it."""
    w, h, _, kind = struct.unpack(">IIBB", png[16:26])
    raw = zlib.decompress(png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8])
    n = 3 if kind == 2 else 1
    return np.frombuffer(raw, np.uint8).reshape(h, 1 + w * n)[:, 1:].reshape((h, w, 3) if n == 3 else (h, w))


def tiff_pages(data):
    (at,), out = struct.unpack_from("<I", data, 4), []
    while at:
        (n,) = struct.unpack_from("<H", data, at)
        e = {struct.unpack_from("<H", data, at + 2 + 12 * i)[0]: struct.unpack_from("<I", data, at + 10 + 12 * i)[0] for i in range(n)}
        raw = zlib.decompress(data[e[273] : e[273] + e[279]])
        out.append(np.frombuffer(raw, np.uint8).reshape((e[257], e[256], 3) if e[277] == 3 else (e[257], e[256])))
        (at,) = struct.unpack_from("<I", data, at + 2 + 12 * n)
    return out


def test_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    color, gray = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8), rng.integers(0, 256, (4, 9)).astype(np.uint8)
    assert (pixels(images.png(color)) == color).all() and (pixels(images.png(gray)) == gray).all()
    back = tiff_pages(images.tiff([color, gray]))
    assert (back[0] == color).all() and (back[1] == gray).all()
    with pytest.raises(ValueError):
        images.tiff([])

    (tmp_path / "in").mkdir()
    for name, data in (("color.png", images.png(color)), ("gray.png", images.png(gray)), ("bad.png", b"no image")):
        (tmp_path / "in" / name).write_bytes(data)
    read = sources.read_images(spark, str(tmp_path / "in"))
    got = {r.doc_id: r.image for r in read.collect()}
    assert got["bad"] is None
    # the JVM's own decoder reads the same pixels
    assert (images.decode(got["color"].asDict()) == color).all() and (images.decode(got["color"].asDict(), "BGR", True) == color[:, :, ::-1].transpose(2, 0, 1)).all()
    assert (images.decode(got["gray"].asDict()) == gray[:, :, None]).all()
    assert images.chain([{"decoded": {}}, {"to_chw": {}}])({"image": got["color"].asDict()})["image"].shape == (3, 7, 5)
    files = {r.doc_id: r for r in sources.tiff_files(read).collect()}
    assert set(files) == {"color", "gray"} and (tiff_pages(files["color"].content)[0] == color).all()


def test_resizing_steps():
    image = np.random.default_rng(3).integers(0, 255, (16, 33, 3)).astype(np.uint8)
    out = images.line_input()({"image": image})["image"]
    assert out.shape == (1, 3, 32, 70) and 0 <= out.min() and out.max() <= 1
    assert images.line_input(most=64)({"image": image})["image"].shape[3] == 64
    out = images.chain([{"super_resolution": {"training": True}}])({"image_lr": image, "image_hr": image})
    assert out["img_lr"].shape == (3, 8, 32) and out["img_hr"].shape == (3, 32, 128)


def dark():
    """A detector of dark pixels, for inputs that are not normalised."""
    return lambda batch: (batch.mean(axis=1, keepdims=True) < 100).astype(float)


def by_color():
    """A reader of the color in a crop's middle; blue is unreadable."""

    def read(crops):
        middle = [c[c.shape[0] // 2, c.shape[1] // 2] for c in crops]
        return [("red", 1.0) if m[0] > 90 else ("blue", 0.1) if m[2] > 90 else ("black", 0.9) for m in middle]

    return read


def test_pages_are_read_from_images_to_ordered_lines(spark):
    page = np.full((128, 192, 3), 255, np.uint8)
    page[20:30, 100:160] = (120, 0, 0)
    page[24:34, 10:70] = 0  # less than 10 lower than the red line, and left of it
    page[60:70, 10:70] = (0, 0, 120)
    page[100:110, 20:90] = 0
    image = {"height": 128, "width": 192, "nChannels": 3, "data": page[:, :, ::-1].tobytes()}
    df = spark.createDataFrame([("a", 1, image), ("a", 2, None)], "doc_id string, page int, image struct<height:int,width:int,nChannels:int,data:binary>")
    plain = [{"resize_limited": {}}, {"to_chw": {}}]
    lines = documents.read_pages(df, dark, by_color, prepare=plain).orderBy("page", "block_no").collect()
    assert [(r.block_no, r.text) for r in lines] == [(1, "black"), (2, "red"), (3, "black")]
    first = lines[0]
    assert (first.page_w, first.page_h) == (192, 128) and first.x0 <= 10 and first.x1 >= 69 and first.y0 <= 24 and first.y1 >= 33
    found = documents.read_pages(df, dark, None, prepare=plain).collect()
    assert len(found) == 4 and {(r.text, r.score) for r in found} == {("", 0.0)}

    failed = documents.read_pages(df, dark, lambda: lambda crops: [], prepare=plain).collect()
    assert [(r.page, r.block_no, r.text) for r in failed] == [(1, None, None)] and failed[0].error.startswith("ValueError")

    regions = spark.createDataFrame([("a", 1, 0.0, 0.0, 191.0, 80.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    table = regions.select("*", F.lit("|t|").alias("text"), F.lit("table").alias("type"))
    got = documents.read_with_tables(df, regions, table, dark, by_color, prepare=plain).orderBy("block_no").collect()
    assert [(r.block_no, r.type, r.text) for r in got] == [(1, "table", "|t|"), (2, "text", "black")]
    assert abs(got[1].x0 - 20) < 12 and 85 < got[1].y0 <= 100

    def failing():
        def read(crops):
            raise ValueError("no reader")

        return read

    rows = documents.read_with_tables(df, regions, table, dark, failing, prepare=plain).collect()
    assert [(r.type, r.text) for r in rows if r.error is None] == [("table", "|t|")]
    assert ["no reader" in r.error and r.block_no is None for r in rows if r.type == "error"] == [True]


def test_models_load_once_and_permanent_failures_are_not_tried_again(spark):
    def factory():
        import os
        import uuid

        mark = f"{os.getpid()} {uuid.uuid4()}"
        return lambda rows: [{"mark": mark} for _ in rows]

    df = spark.range(0, 32, 1, 16).select("id")
    marks = {r.mark for r in inference.infer(df, factory, "mark string").collect()}
    assert len(marks) == len({m.split()[0] for m in marks})

    tries = []

    def broken():
        def model(rows):
            tries.append(1)
            raise inference.Permanent("HTTP 400") if len(tries) == 1 else ValueError(len(tries))

        return model

    (row,) = inference.infer(df.limit(1), broken, "out string").collect()
    assert row.error == "Permanent: HTTP 400"


def test_chat_requests_and_greedy_decoding():
    body = inference.chat_request({"text": "x", "image": images.png(np.zeros((1, 1)))}, "m", "Read.", schema={"a": "ă"}, json_mode=True, thinking=False)
    assert body["response_format"] == {"type": "json_object"} and body["chat_template_kwargs"] == {"enable_thinking": False}
    assert body["messages"][0]["content"].startswith("Read.") and '"ă"' in body["messages"][0]["content"]
    assert body["messages"][1]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    plain = inference.chat_request({"text": None}, "m", "Read.")
    assert "response_format" not in plain and plain["messages"][1]["content"] == [{"type": "text", "text": ""}]
    # row n ends after n tokens; all go on until the last has ended
    assert inference.greedy(lambda rows: [2 if len(r) >= n else 9 for n, r in enumerate(rows, 1)], 3) == [[1, 2, 2, 2], [1, 9, 2, 2], [1, 9, 9, 2]]
    assert [len(r) for r in inference.greedy(lambda rows: [7] * len(rows), 2)] == [130, 130]
