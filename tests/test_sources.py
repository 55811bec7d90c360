"""Page files read in parts and as a stream, and PDF files written and parsed back."""

import os
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe import images
from folioframe.sources import page_files
from folioframe.sources.page_files import Tiff, read_page_files, stream_page_files


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_lzw_round_trip(data, times):
    whole = data * times
    assert images.unpack_lzw(images.pack_lzw(whole)) == whole


def page(n, shape=(7, 5)):
    return np.random.default_rng(n).integers(0, 256, shape).astype(np.uint8)


def test_lzw_of_a_page():
    a = page(1, (300, 200, 3)) // 32
    assert images.unpack_lzw(images.pack_lzw(a.tobytes())) == a.tobytes()


def pixels(row):
    a = np.frombuffer(row.image.data, np.uint8).reshape(row.image.height, row.image.width, row.image.nChannels)
    return a[:, :, ::-1] if a.shape[2] == 3 else a[:, :, 0]


@pytest.mark.parametrize("packing", ["deflate", "lzw"])
def test_files_give_their_pages(spark, tmp_path, packing):
    held = {f"d{i}": [page(10 * i + k, (4 + k, 6) if k % 2 else (5, 3 + k, 3)) for k in range(1 + i)] for i in range(4)}
    for name, pages in held.items():
        (tmp_path / f"{name}.{'tif' if name < 'd2' else 'TIFF'}").write_bytes(images.tiff(pages, packing=packing))
    (tmp_path / "bad.tif").write_bytes(b"II*\0\xff\xff\0\0")
    (tmp_path / "other.txt").write_bytes(b"no")
    got = read_page_files(spark, str(tmp_path)).collect()
    bad = [r for r in got if r.doc_id == "bad"]
    assert len(bad) == 1 and bad[0].error and bad[0].page is None
    rows = {(r.doc_id, r.page): r for r in got if r.doc_id != "bad"}
    assert set(rows) == {(d, i) for d, p in held.items() for i in range(1, len(p) + 1)} and len(rows) == len(got) - 1
    for (d, i), r in rows.items():
        assert (pixels(r) == held[d][i - 1]).all() and r.n_pages == len(held[d]) and r.is_last == (i == r.n_pages) and r.error is None
    assert read_page_files(spark, str(tmp_path / "nothing")).collect() == []


def test_tiff_variants(tmp_path):
    """Both byte orders, 64-bit offsets, several strips, bits, inverted gray, PackBits, a predictor."""
    gray = page(3, (9, 11))

    def build(order, big, entries, blob):
        q, off = ("Q", 16) if big else ("I", 8)
        head = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, off + len(blob)) if big else struct.pack(order + "I", off + len(blob)))
        out = b""
        for tag, kind, values in entries:
            code, size = {3: ("H", 2), 4: ("I", 4)}[kind]
            value = struct.pack(f"{order}{len(values)}{code}", *values)
            out += struct.pack(f"{order}HH{q}", tag, kind, len(values)) + value.ljust(8 if big else 4, b"\0")
        return head + blob + struct.pack(order + ("Q" if big else "H"), len(entries)) + out + struct.pack(order + q, 0)

    def pages(data):
        import io

        t = Tiff(io.BytesIO(data))
        return [t.pixels(t.tags(raw)) for _, raw in t.directories()]

    for order in "<>":
        for big in (False, True):
            off = 16 if big else 8
            base = [(256, 3, [11]), (257, 3, [9]), (258, 3, [8])]
            raw = gray.tobytes()
            (a,) = pages(build(order, big, [*base, (259, 3, [1]), (262, 3, [0]), (273, 4, [off]), (278, 3, [9]), (279, 4, [99])], raw))
            assert (a[:, :, 0] == 255 - gray).all()
            packed = b"".join(bytes([10]) + bytes(r) for r in gray)
            (a,) = pages(build(order, big, [*base, (259, 3, [32773]), (262, 3, [1]), (273, 4, [off]), (278, 3, [9]), (279, 4, [len(packed)])], packed))
            assert (a[:, :, 0] == gray).all()
            delta = zlib.compress(np.diff(gray, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes())
            (a,) = pages(build(order, big, [*base, (259, 3, [8]), (262, 3, [1]), (273, 4, [off]), (279, 4, [len(delta)]), (317, 3, [2])], delta))
            assert (a[:, :, 0] == gray).all()
            bits = np.packbits(gray > 127, axis=1).tobytes()
            (a,) = pages(build(order, big, [(256, 3, [11]), (257, 3, [9]), (259, 3, [1]), (262, 3, [1]), (273, 4, [off]), (279, 4, [len(bits)])], bits))
            assert (a[:, :, 0] == (gray > 127) * 255).all()
    with pytest.raises(ValueError):
        pages(build("<", False, [(256, 3, [11]), (257, 3, [9]), (258, 3, [16]), (273, 4, [8]), (279, 4, [99])], gray.tobytes()))


def test_many_tasks_read_one_file_and_filters_reach_them(spark, tmp_path):
    """1,000 pages in parts; a filter on pages reads the directories and these pages' bytes only."""
    data = images.tiff([page(i, (40, 50)) for i in range(1000)])
    (tmp_path / "long.tif").write_bytes(data)
    (tmp_path / "short.tif").write_bytes(images.tiff([page(1)]))
    df = read_page_files(spark, str(tmp_path), split=len(data) // 12)
    assert df.rdd.getNumPartitions() >= 12
    per_task = df.where("doc_id = 'long'").groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.min("page"), F.max("page")).collect()
    assert len(per_task) >= 12 and sum(r.n for r in per_task) == 1000 and max(r.n for r in per_task) < 150
    got = df.where("page between 500 and 503 and doc_id in ('long', 'x') and page <> 502").orderBy("page").collect()
    assert [r.page for r in got] == [500, 501, 503] and all((pixels(r) == page(r.page - 1, (40, 50))).all() for r in got)
    plan = df.where("page = 7")._jdf.queryExecution().toString()
    assert "Filter (page" not in plan.split("Physical Plan")[1] or "isnotnull" in plan.split("Physical Plan")[1]

    read = []

    class Counted:
        def __init__(self, f):
            self._f = f

        def seek(self, at):
            self._f.seek(at)

        def read(self, n):
            read.append(n)
            return self._f.read(n)

    r = page_files.PageReader(page_files._columns(None), {"path": str(tmp_path)})
    assert r._asked.take(page_files.EqualTo(("page",), 77)) and not r._asked.take(page_files.EqualTo(("error",), "x"))
    with open(tmp_path / "long.tif", "rb") as f:
        (row,) = r._pages(Tiff(Counted(f)), 0, 1 << 62)
    assert row["page"] == 77 and sum(read) < 1000 * 200 + 2200
    read.clear()
    r = page_files.PageReader(page_files._columns(["doc_id", "page", "is_last"]), {"path": str(tmp_path)})
    with open(tmp_path / "long.tif", "rb") as f:
        assert len(list(r._pages(Tiff(Counted(f)), 0, 1 << 62))) == 1000
    assert sum(read) < 1000 * 200


def test_page_files_as_a_stream(spark, tmp_path):
    """Every page once, the last one marked, across a restart."""
    (tmp_path / "in").mkdir()

    def put(name, n):
        (tmp_path / "part").write_bytes(images.tiff([page(k) for k in range(n)]))
        os.rename(tmp_path / "part", tmp_path / "in" / name)

    def run():
        df = stream_page_files(spark, str(tmp_path / "in"), ["doc_id", "page", "n_pages", "is_last"], split=600)
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect())

    put("b.tif", 30)
    put("c.tif", 1)
    want = [("b", i, 30, i == 30) for i in range(1, 31)] + [("c", 1, 1, True)]
    assert run() == want
    assert run() == want
    put("a.tif", 4)
    assert run() == [("a", i, 4, i == 4) for i in range(1, 5)] + want


def test_stream_of_page_files_feeds_the_extraction(spark, tmp_path):
    from folioframe.streaming import extract_batch, extract_stream, stub_extractor

    for name, n in (("x", 5), ("y", 1)):
        (tmp_path / f"{name}.tif").write_bytes(images.tiff([page(k) for k in range(n)]))
    text = F.concat(F.col("doc_id"), F.lit(" page "), F.col("page")).alias("text")
    pages = stream_page_files(spark, str(tmp_path), ["doc_id", "page", "is_last"], split=300).select("doc_id", "page", text, "is_last")
    q = extract_stream(pages, stub_extractor).writeStream.format("memory").queryName("files_extracted").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = extract_batch(read_page_files(spark, str(tmp_path), ["doc_id", "page"]).select("doc_id", "page", text), stub_extractor)
    assert sorted(spark.table("files_extracted").collect()) == sorted(batch.collect())


def parsed(data):
    """A PDF file's pages, each its lines as (text, x, y, size, cut) and its number of rules, found by the table of places alone."""
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
    assert data[start : start + 4] == b"xref"
    n = int(data[start:].split(b"\n")[1].split()[1])
    places = [int(line[:10]) for line in data[start:].split(b"\n")[3 : 2 + n]]

    def body(i):
        assert data[places[i - 1] :].startswith(b"%d 0 obj\n" % i)
        return data[places[i - 1] : data.index(b"endobj", places[i - 1])]

    def stream(i):
        raw = body(i)
        size = int(re.search(rb"/Length (\d+)", raw)[1])
        at = raw.index(b"stream\n") + 7
        return zlib.decompress(raw[at : at + size])

    fonts = {}
    for name, ref in re.findall(rb"/F(\d+) (\d+) 0 R", body(3)):
        font = body(int(ref))
        back = stream(int(re.search(rb"/ToUnicode (\d+)", font)[1])).decode()
        fonts[int(name)] = re.search(rb"/BaseFont /(\S+)", font)[1].decode(), {int(a, 16): bytes.fromhex(b).decode("utf-16-be") for a, b in re.findall(r"<(..)> <([0-9a-f]+)>\n", back.split("endcodespacerange")[1])}
    pages = []
    for ref in re.search(rb"/Kids \[(.*?)\]", body(2))[1].split(b" 0 R")[:-1]:
        content = stream(int(re.search(rb"/Contents (\d+)", body(int(ref)))[1])).decode()
        lines = []
        for block in re.findall(r"BT 1 0 0 1 (\S+) (\S+) Tm\n(.*?)ET", content, re.S):
            runs = re.findall(r"/F(\d+) (\S+) Tf <([0-9a-f]*)> Tj", block[2])
            lines.append(("".join(fonts[int(f)][1][b] for f, _, codes in runs for b in bytes.fromhex(codes)), float(block[0]), float(block[1]), {float(s) for _, s, _ in runs}, {fonts[int(f)][0] for f, _, _ in runs}))
        pages.append((lines, content.count(" l S")))
    assert len(pages) == int(re.search(rb"/Count (\d+)", body(2))[1])
    return pages


def test_pdf_files_hold_what_was_drawn(spark, tmp_path):
    from folioframe.functions import style
    from folioframe.sources import pdf

    letters = "".join(chr(c) for c in range(0x1EA0, 0x1EFA)) + "".join(chr(c) for c in range(0x400, 0x4F0))
    texts = ["ĐỘC LẬP - TỰ DO - HẠNH PHÚC", "Nơi nhận:", "plain (text) \\ <x>\nsecond line\twith a tab", "TOÀN CHỮ HOA", letters, "\U0001f600 end", "  "]
    rows = [(d, p, b, t, 100.0 + 40 * b, 60.0 + 90 * b, 900.0 + 70 * b, 100.0 + 90 * b, 1785, 2526) for d in ("a/b", "ü", "..") for p in (3, 1) for b, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, page_w int, page_h int")
    blocks = blocks.withColumn("style", style.style(F.col("text"), F.col("x0"), F.col("x1"), F.col("page_w")))
    commands = style.draw_commands(blocks)
    pdf.write_pdf(commands, f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(["%...pdf", "a%2Fb.pdf", "ü.pdf"])
    want = commands.orderBy("doc_id", "page", "block_no", "line_no").collect()
    for doc in ("a/b", "ü", ".."):
        pages = parsed((tmp_path / "out" / pdf.file_name(doc)).read_bytes())
        for p, (lines, rules) in zip((1, 3), pages, strict=True):
            own = [w for w in want if w.doc_id == doc and w.page == p]
            assert [x[0] for x in lines] == [w.line.replace("\t", " ") for w in own] and rules == sum(w.underline for w in own)
            for (text, x, y, sizes, cuts), w in zip(lines, own, strict=True):
                long = pdf.width(text, w.font, w.size)
                assert abs(x + {"left": 0, "center": long / 2, "right": long}[w.anchor] - w.x) < 0.01 and abs(y - w.y) < 0.01 and sizes == {w.size} and cuts == {pdf.CUTS[w.font]}
    assert {w.font for w in want} == {"regular", "bold", "bold-italic"} and {w.anchor for w in want} >= {"left", "center"}
    # a task that fails leaves nothing, and what was there stays
    broken = commands.withColumn("size", F.when(F.col("doc_id") != "ü", F.col("size"))).withColumn("x", F.when(F.col("doc_id") != "ü", F.col("x")))
    before = {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")}
    with pytest.raises(Exception, match="TypeError"):
        pdf.write_pdf(broken, f"{tmp_path}/out", mode="overwrite")
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")} == before
    pdf.write_pdf(commands.where("doc_id = '..'"), f"{tmp_path}/out", mode="overwrite")
    assert os.listdir(tmp_path / "out") == ["%...pdf"]
    pdf.write_pdf(commands.limit(0), f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_pdf_folders_are_moved_and_read_by_task(spark, tmp_path):
    """However many documents, the driver moves one folder a task; the files are those of the flat form, and all are read."""
    from folioframe.sources import pdf

    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 500))  # three fonts
    rows = [(f"d{i}", p, 0, k, many[i:] if i % 9 == 0 else f"line {i} of {p}", "bold" if k else "regular", 13.0, "left", 20.0, 700.0, False) for i in range(60) for p in range(i % 4 + 1) for k in range(2)]
    commands = spark.createDataFrame(rows, pdf.COMMANDS)
    pdf.write_pdf(commands, f"{tmp_path}/flat")
    pdf.write_pdf(commands, f"{tmp_path}/deep", folders=True)
    parts = os.listdir(tmp_path / "deep")
    assert 1 <= len(parts) <= 4 and all(p.startswith("part-") for p in parts)
    deep = {f: (tmp_path / "deep" / p / f).read_bytes() for p in parts for f in os.listdir(tmp_path / "deep" / p)}
    assert deep == {f: (tmp_path / "flat" / f).read_bytes() for f in os.listdir(tmp_path / "flat")} and len(deep) == 60
    for top in ("flat", "deep"):
        got = pdf.read_pdf(spark, f"{tmp_path}/{top}").collect()
        assert sorted((r.doc_id, r.n_pages, r.length) for r in got) == sorted((f"d{i}", i % 4 + 1, len(deep[f"d{i}.pdf"])) for i in range(60))
        assert all(os.path.getsize(r.path.removeprefix("file:")) == r.length for r in got)
    pages = parsed(deep["d9.pdf"])
    assert [x[0] for x in pages[0][0]] == [many[9:]] * 2
    pdf.write_pdf(commands.limit(0), f"{tmp_path}/none", folders=True)
    assert pdf.read_pdf(spark, f"{tmp_path}/none").count() == 0


def test_pdf_query_writes_every_document(spark):
    from folioframe.plans import derived as d
    from folioframe.plans.queries import QUERIES, drawn_blocks

    sf = "/root/testdata/sf0.001"
    commands = {}
    for r in drawn_blocks(d.blocks(spark, sf)).collect():
        commands.setdefault(str(r.doc_id), {}).setdefault(r.page, []).append((r.block_no, r.line_no, r.line))
    got = QUERIES["q_pdf_files"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(commands)
    for r in got:
        own = commands[r.doc_id]
        assert r.n_pages == len(own)
        with open(r.path.removeprefix("file:").replace("///", "/"), "rb") as f:
            pages = parsed(f.read())
        assert [[x[0] for x in lines] for lines, _ in pages] == [[re.sub(r"[\x00-\x1f\x7f]", " ", t) for _, _, t in sorted(own[p])] for p in sorted(own)]
