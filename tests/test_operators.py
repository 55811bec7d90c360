"""Merging, tables, orders, streaming and inference on small cases."""

import json
import time
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe import images
from folioframe.inference import infer, stub_recognizer
from folioframe.operators import layout, merge, pages, reading_order, tables
from folioframe.operators.cleanup import keep_apart
from folioframe.schema import EXTRACTION, TABLE_CELL


def person(name=None, dob=None, crimes=(), **more):
    e = {"thong_tin_ket_an": {"ten_toi_danh": list(crimes)}, "bi_cao_vn": {"ho_va_ten": name, "ngay_sinh": dob}, **more}
    return e


def part(*entities, note=None):
    return {"thong_tin_chung": {"ghi_chu": note}, "danh_sach_doi_tuong": list(entities)}


def names(result):
    return [(e["bi_cao_vn"] or {}).get("ho_va_ten") for e in result["danh_sach_doi_tuong"]]


def merged(*parts):
    """What the fold holds before its cleanup."""
    fold = merge.Fold()
    for p in parts:
        fold.add(merge.complete(p, EXTRACTION))
    return fold.merged


def plain_place(entities, new):
    """Where an entity belongs, by a look at all."""
    key = merge.entity_key(new)
    if key[0] is None:
        return len(entities) - 1 if entities else None
    for i, e in enumerate(entities):
        k = merge.entity_key(e)
        if k[0] == key[0] and merge.compatible(k, key):
            return i
    return next((i for i, e in enumerate(entities) if merge.empty(e)), None)


def plain_absorb(entities, new):
    at = plain_place(entities, new)
    if at is not None:
        return [merge.fill(e, new) if i == at else e for i, e in enumerate(entities)]
    return [*entities, new] if merge.entity_key(new)[0] is not None else entities


def plain_fold(parts):
    """The fold without an index: every entity is compared with all."""
    base = None
    for p in (merge.complete(p, EXTRACTION) for p in parts):
        if base is None:
            base = p
            continue
        entities = base["danh_sach_doi_tuong"]
        for new in p["danh_sach_doi_tuong"]:
            if not merge.empty(new):
                entities = plain_absorb(entities, new)
        base = {**base, "thong_tin_chung": merge.fill(base["thong_tin_chung"] or {}, p["thong_tin_chung"] or {}), "danh_sach_doi_tuong": entities}
    if base is None:
        return merge.empty_result()
    result, entities = merge.sanitize(base), []
    for e in result["danh_sach_doi_tuong"]:
        if not merge.empty(e):
            entities = plain_absorb(entities, e)
    for e in entities:
        if (e["thong_tin_ket_an"] or {}).get(merge.LAWS) is not None:
            e["thong_tin_ket_an"][merge.LAWS] = merge.merge_laws(e["thong_tin_ket_an"][merge.LAWS])
    return {**result, "danh_sach_doi_tuong": entities}


@pytest.mark.parametrize("seed", range(300))
def test_fold_is_the_plain_fold(seed):
    """Keys that are known, unknown or filled later, placeholders, empty entities, foreign names behind own ones, lists that grow."""
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)

    def one():
        if rng.random() < 0.15:
            return pick({}, person(), {"bi_cao_vn": None, "thong_tin_ket_an": {"ten_toi_danh": None}})
        e = person(pick("A", "a ", "B", "C", None, "N/A", "", "..."), pick(None, "1/1/90", "01-01-1990", "2/2/1991", "", "null"), [pick("x", "X ", "y", "z", "null", None) for _ in range(rng.randrange(3))])
        e["bi_cao_vn"]["giay_to_dinh_danh"] = pick(None, {}, {"so_giay_to": pick("1", "2", "-", None)})
        e["bi_cao_nuoc_ngoai"] = pick(None, None, {"ho_ten": pick("A", "F", None), "so_giay_to": pick("1", "9", None), "ngay_sinh": pick(None, "3/3/1993")})
        e["thong_tin_ket_an"][merge.LAWS] = [pick("Điều 5", "khoản 1 Điều 5", "điểm a Điều 5 BLHS", "other", "null") for _ in range(rng.randrange(3))]
        return e

    parts = [part(*(one() for _ in range(rng.randrange(4))), note=pick(None, "N/A", "n", "")) for _ in range(rng.randrange(1, 14))]
    assert merge.fold(parts) == plain_fold(json.loads(json.dumps(parts)))


def test_fold_of_a_hundred_thousand_entities():
    """Names that differ, one name with many birth dates, and one entity that takes a long list."""
    parts = [part(*(person(f"N{i + k}", crimes=["x"]) for k in range(100))) for i in range(0, 60_000, 100)]
    parts += [part(*(person("Same", f"{d % 28 + 1}/{d // 28 % 12 + 1}/{1000 + d // 336}") for d in range(i, i + 100))) for i in range(0, 40_000, 100)]
    parts += [part(*(person("Same", f"{d % 28 + 1}/{d // 28 % 12 + 1}/{1000 + d // 336}", [f"again {d}"]) for d in range(i, i + 100))) for i in range(0, 40_000, 100)]
    parts += [part(person("N5", crimes=[f"crime {i}"])) for i in range(20_000)]
    began = time.time()
    out = merge.fold(parts)["danh_sach_doi_tuong"]
    assert time.time() - began < 90
    assert len(out) == 100_000 and len(out[5]["thong_tin_ket_an"]["ten_toi_danh"]) == 20_001 and out[-1]["thong_tin_ket_an"]["ten_toi_danh"] == ["again 39999"]


def test_first_part_is_taken_whole_and_cleaned_later():
    base = merged(part(person("A"), person("A")))
    assert names(base) == ["A", "A"]
    assert names(merge.fold([part(person("A"), person("A"))])) == ["A"]


def test_unnamed_goes_to_the_last_or_is_lost():
    out = merge.fold([part(person("A"), person("B")), part(person(crimes=["x"]))])
    assert names(out) == ["A", "B"] and out["danh_sach_doi_tuong"][1]["thong_tin_ket_an"]["ten_toi_danh"] == ["x"]
    assert names(merge.fold([part(), part(person(crimes=["x"]))])) == []


def test_conflicting_birth_dates_split_and_filled_ones_can_split_later():
    assert names(merge.fold([part(person("A", "1/1/1990")), part(person("A", "1/1/1991"))])) == ["A", "A"]
    out = merge.fold([part(person("A")), part(person("a", "1/1/1990")), part(person("A", "1/1/1991"))])
    assert [e["bi_cao_vn"]["ngay_sinh"] for e in out["danh_sach_doi_tuong"]] == ["1/1/1990", "1/1/1991"]


@pytest.mark.parametrize("first, want", [("X", "X"), (None, "Y"), ("N/A", "Y"), ("", "")])
def test_header_takes_the_first_known(first, want):
    assert merge.fold([part(note=first), part(note="Y")])["thong_tin_chung"]["ghi_chu"] == want


def test_empty_entity_is_filled_and_no_part_gives_the_template():
    assert names(merged(part(person()), part(person("B")))) == ["B"]
    assert merge.fold([]) == merge.empty_result()


def test_lists_keep_old_repeats(spark):
    assert merge.merge_lists("x", ["x", "X"], [" x ", "y", None]) == ["x", "X", "y"]
    df = spark.createDataFrame([(["x", "X"], [" x ", "y", None])], "a array<string>, b array<string>")
    assert df.select(merge.ordered_distinct(F.col("a"), F.col("b")).alias("r")).first().r == ["x", "X", "y"]


def test_long_lists_keep_first_items(spark):
    """20,000 new items, each twice: comparing each with all before it would take far longer than the limit here."""
    old, new = ["A0", None, "n/a", "A0"], [f"{'Ａa'[i % 2]}{i // 2}\u3000" for i in range(40_000)] + [None, "N/A"]
    df = spark.createDataFrame([(old, new)], "a array<string>, b array<string>")
    began = time.time()
    got = df.select(merge.ordered_distinct(F.col("a"), F.col("b")).alias("r")).first().r
    assert time.time() - began < 15
    assert got == merge.merge_lists("x", old, new) and len(got) == 4 + 19_999


def test_merge_partials_does_not_depend_on_arrival(spark):
    rows = [(1, p, json.dumps(part(person("A" if p % 2 else "B", crimes=[str(p)]), note=str(p)))) for p in range(1, 7)] + [(2, 1, "not json")]
    a, b = (merge.merge_partials(spark.createDataFrame(r, "doc_id long, page int, partial string")).orderBy("doc_id").collect() for r in (rows, rows[::-1]))
    assert a == b
    assert json.loads(a[1].result) == merge.empty_result()


def test_read_extraction_fills_lists(spark):
    raw = json.dumps({"thong_tin_chung": {}, "danh_sach_doi_tuong": [{"thong_tin_ket_an": {"ten_toi_danh": None}}]})
    out = spark.createDataFrame([(raw,)], "raw string").select(merge.read_extraction(F.col("raw")).alias("r")).first().r
    assert out.danh_sach_doi_tuong[0].thong_tin_ket_an.ten_toi_danh == []


def test_windows_and_texts(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, None), (1, 4, "d")], "doc_id int, page int, text string")
    got = [(r.page, r.first_page, r.window_text) for r in pages.page_windows(df).orderBy("page").collect()]
    assert got == [(1, 1, "a"), (2, 1, "a"), (4, 3, "d")]
    assert pages.plain_text(df.where("page < 3")).first().text == "<!-- Page 1 -->\na\n\n---\n\n<!-- Page 2 -->\n "


def test_page_round_trip(spark):
    rows = [(1, p, 100, 200, b, f"t{b}", 1.0, 2.0, 3.0, 4.0) for p in (1, 2) for b in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id int, page int, width int, height int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    back = pages.explode_pages(pages.nest_pages(df), F.col("doc_id"))
    assert sorted(back.select(df.columns).collect()) == sorted(df.collect())


def test_overlap_ties_take_the_last(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 900.0)], "page int, b_idx int, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    regions = spark.createDataFrame([(1, i, 0.0, 0.0, 10.0, 900.0) for i in (1, 2, 3)], "page int, r_idx int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    assert [r.r_idx for r in layout.best_overlap(boxes, regions, 0.3).collect()] == [3]
    assert [r.r_idx for r in layout.nearest_column(boxes, regions).collect()] == [1]


def test_box_joins_take_more_tasks_for_more_boxes(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_ROWS", 2, raising=False)
    boxes = spark.createDataFrame([(p, 1, 0.0, 0.0, 10.0, 900.0) for p in range(20)], "page int, b_idx int, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    regions = spark.createDataFrame([(p, i, 0.0, 0.0, 10.0, 900.0) for p in range(20) for i in (1, 2)], "page int, r_idx int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    for got, found in ((layout.nearest_column(boxes, regions), 20), (layout.overlapping(boxes, regions), 40)):
        assert got.count() == found and got.rdd.getNumPartitions() == 11


def test_tables_take_more_tasks_for_more_cells(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_CELLS", 4, raising=False)
    cells = spark.createDataFrame([(t, 0, 0, 1, "12", 1) for t in range(20)], "table_id int, rn int, cn int, cell_no int, text string, H int")
    main = tables.dominant_type(cells)
    assert {r.btype for r in main.collect()} == {"Nu"} and main.rdd.getNumPartitions() == 6
    assert tables.header_rows(cells, main).count() == 0 and tables.header_rows(cells, main).rdd.getNumPartitions() == 6


def cell(n, text, r, c, x0=None, top=None, h=None, sp=None, kind="table"):
    x, y = (c or 0) * 100.0 if x0 is None else x0, (r or 0) * 30.0 if top is None else top
    return ("t", n, text, x, x + 90, y, y + 20, kind, 1, r, y, y + 25, h, None, None, None, None, c, x, x + 95, sp)


def table(spark, *cells, **how):
    rows = tables.construct_tables(spark.createDataFrame(list(cells), TABLE_CELL), **how).collect()
    return rows[0].body if rows else None


def test_many_tables_come_as_one_stream(spark):
    """No call of Python for each table: one for a task's sorted tables, whose batches cut through them."""
    cells = [(f"t{t}", *cell(n, f"{t}.{n}", n, 0)[1:]) for t in range(40) for n in range(t % 4 + 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = tables.construct_tables(spark.createDataFrame(cells, TABLE_CELL).repartition(5))
        bodies = {r.table_id: r.body for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {f"t{t}": "".join(f"| {t}.{n} |\n" + "| --- |\n" * (n == 0) for n in range(t % 4 + 1)) for t in range(40)}
    assert bodies == want
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_markdown(spark):
    cells = [cell(1, "h1", 0, 0), cell(2, "h2", 0, 1), cell(3, "a", 1, 0)]
    want = "| h1 | h2 |\n| --- | --- |\n| a |  |\n"
    assert table(spark, *cells) == want
    assert table(spark, cell(0, "T", 0, 0, kind="table caption"), *cells) == "**T**\n\n" + want
    placed = spark.createDataFrame([("t", 0, 0, 1, "h1"), ("t", 0, 1, 2, "h2"), ("t", 1, 0, 3, "a")], "table_id string, rn int, cn int, cell_no int, text string")
    assert tables.markdown(placed).first().markdown == want


def test_lonely_column_moves(spark):
    rows = [cell(10 * r + c, f"{r}{c}", r, c) for r in range(4) for c in (0, 1)] + [cell(99, "x", 2, 2, x0=195.0)]
    rows = [r for r in rows if r[2] != "21"]
    body = table(spark, *rows)
    assert body.count("|") and "| 20 | x |" in body


def test_sentences(spark):
    cells = [cell(1, "name", 0, 0, h=1), cell(2, "age", 0, 1, h=1), cell(3, "Ann", 1, 0), cell(4, "7", 1, 1)]
    assert table(spark, *cells, style="sentences") == "name：Ann; age：7"


def test_span_shares_content(spark):
    cells = [cell(1, "top", 0, 0, sp=1), cell(2, "a", 1, 0), cell(3, "b", 1, 1)]
    wide = [list(c) for c in cells]
    wide[0][13:17] = [0.0, 25.0, 0.0, 200.0]  # the span's extents
    assert table(spark, *map(tuple, wide)) == "| top | top |\n| --- | --- |\n| a | b |\n"


def test_tolerance_orders():
    rows = [{"top": t, "x0": x, "R": r} for t, x, r in ((0, 50, 1), (4, 10, 0), (30, 5, None), (31, 0, 2))]
    assert [r["x0"] for r in reading_order.tolerance_order(rows, "top", "x0", 10)] == [10, 50, 0, 5]
    assert [r["x0"] for r in reading_order.page_order(rows)] == [10, 50, 0, 5]
    assert [r["R"] for r in reading_order.repair(rows[:2], "R", "x0")] == [0, 1]


def test_cleanup_drops_the_lower_score():
    a = {"type": "x", "score": 0.9, "x0": 0, "y0": 0, "x1": 10, "y1": 10}
    assert keep_apart([a, {**a, "score": 0.5}, {**a, "type": "y"}], 2, 0.7) == [a, {**a, "type": "y"}]
    assert keep_apart([a, dict(a)], 2, 0.7) == [a]
    assert keep_apart([a, {**a, "x0": 9, "x1": 30}], 2, 0.7)[0] is a


PAGE = "doc_id string, page int, text string, is_last boolean"


def streamed(spark, rows, top, **options):
    """One availableNow run over all files of top/in, going on from top/state; rows that are new."""
    from folioframe.streaming import extract_stream, stub_extractor

    if rows:
        spark.createDataFrame(rows, PAGE).repartition(4).write.mode("append").parquet(f"{top}/in")
    run = extract_stream(spark.readStream.schema(PAGE).options(**options).parquet(f"{top}/in"), stub_extractor)
    q = run.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(run.schema).parquet(f"{top}/out").collect())


def batched(spark, rows):
    from folioframe.streaming import extract_batch, stub_extractor

    return sorted(tuple(r) for r in extract_batch(spark.createDataFrame(rows, PAGE).drop("is_last"), stub_extractor).collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"d{i}", p, f"Name{i % 2} Last word{p}\nline", p == 4) for i in range(3) for p in (3, 1, 4, 2)]
    assert streamed(spark, rows, tmp_path, maxFilesPerTrigger=1) == batched(spark, rows)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Pages that came early, the texts before and the record outlive a restart; a repeated page counts once, its first text stays."""
    rows = [("a", p, f"A{p} b\nc{p % 3}", p == 9) for p in range(1, 10)] + [("b", 1, None, True), ("c", 1, "x", False), ("c", 2, "  ", False), ("c", 3, "y z", True)]
    first = [r for r in rows if r[:2] in {("a", 1), ("a", 2), ("a", 5), ("a", 9), ("c", 3)}]
    assert streamed(spark, first, tmp_path) == []
    assert streamed(spark, [("a", 5, "other text", False), ("a", 1, "other", False), rows[9], rows[10], rows[11]], tmp_path) == [r for r in batched(spark, rows) if r[0] != "a"]
    assert streamed(spark, [r for r in rows if r[0] == "a" and r not in first], tmp_path) == batched(spark, rows)


def test_stream_takes_a_long_document_in_any_order(spark, tmp_path):
    """10,000 pages, shuffled over triggers: time in proportion to the pages."""
    import random
    import time as clock

    def took(n):
        rows = [("long", p, f"Name{p % 7} x\npage{p % 5}", p == n) for p in range(1, n + 1)]
        random.Random(n).shuffle(rows)
        began = clock.time()
        for k in range(2):
            got = streamed(spark, rows[k * n // 2 : (k + 1) * n // 2], f"{tmp_path}/{n}")
        began = clock.time() - began
        assert got == batched(spark, rows)
        return began

    short, long = took(1000), took(10_000)
    assert long < 10 * short + 60


def test_stream_gives_up_pages_that_never_come(spark, tmp_path):
    from folioframe.streaming import extract_stream, stub_extractor

    rows = [("d", 1, "a b", False), ("d", 4, "e f", True), ("d", 3, "c d", False), ("e", 1, "g h", True)]
    spark.createDataFrame(rows, PAGE).write.parquet(f"{tmp_path}/in")
    run = extract_stream(spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in"), stub_extractor, patience=3000)
    q = run.writeStream.format("memory").queryName("patient_stream").outputMode("append").start()
    try:
        def wait(n):
            for _ in range(120):
                if q.exception() or spark.table("patient_stream").count() >= n:
                    break
                time.sleep(0.5)
            return sorted(tuple(r) for r in spark.table("patient_stream").collect())

        assert wait(2) == batched(spark, rows)  # without page 2
        spark.createDataFrame([("e", 1, "g h", True), ("f", 1, "i", True)], PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert {r[0] for r in wait(3)} == {"d", "e", "f"}
    finally:
        q.stop()


def test_documents_are_handed_out_page_by_page(spark, tmp_path):
    from folioframe.streaming import documents_stream, land_documents, pages_of

    rows = [("a", 2, "x"), ("a", 1, None), ("a", 7, ""), ("a", 7, "z"), ("b", 3, "y"), ("c", None, "gone")]
    land_documents(spark.createDataFrame(rows, "doc_id string, page long, text string"), f"{tmp_path}/in")
    q = pages_of(documents_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("handed_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("handed_out").collect()) == [("a", 1, None, False), ("a", 2, "x", False), ("a", 3, "", True), ("b", 1, "y", True)]


def test_inference_reports_failures(spark):
    def broken():
        def model(rows):
            if any(r["text"] == "bad" for r in rows):
                raise ValueError("no")
            return [{"out": r["text"].upper()} for r in rows]

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "text string").coalesce(1)
    got = {r.text: (r.out, r.error) for r in infer(df, broken, "out string", batch=1).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}
    assert infer(df.withColumnRenamed("text", "t").withColumn("text", F.col("t")), stub_recognizer, "score double").count() == 3


def test_image_steps():
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    out = images.chain([{"pad": {"multiple": 4}}, {"to_chw": {}}, {"pad_stride": {"stride": 16}}])({"image": image})
    assert out["image"].shape == (3, 16, 16)
    assert np.allclose(images.resize(image, 5, 7), image)
    assert images.resize_limited(limit=4)({"image": image})["image"].shape == (32, 32, 3)
    assert images.letterbox((14, 14))({"image": image})["image"].shape == (14, 14, 3)
    assert images.standardize([0.0] * 3, [1.0] * 3)({"image": image})["image"].max() == pytest.approx(104 / 255)
    assert images.expand_rectangle(10, 10) == 3.75
    with pytest.raises(KeyError):
        images.chain([{"nothing": {}}])


def test_document_end_to_end(spark):
    from folioframe.plans import documents

    boxes = spark.createDataFrame(
        [(1, p, x, y, x + 100.04, y + 20.0) for p in (1, 2) for x, y in ((300.0, 12.0), (10.0, 11.0), (10.0, 50.0))] + [(1, 1, 0.0, 0.0, 4.0, 40.0)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double"
    )
    blocks = documents.detected_blocks(boxes)
    assert [(r.block_no, r.x0) for r in blocks.where("page = 1").orderBy("block_no").collect()] == [(1, 10.0), (2, 300.0), (3, 50.0 - 40.0)]

    def read():
        return lambda rows: [{"raw": "<think>..</think>" + json.dumps({str(n): f"p{r['page']} line {n}" for n in r["labels"] if n != 2})} for r in rows]

    texts = documents.recognized(blocks, read, size=2).cache()
    assert sorted((r.page, r.label, r.text, r.x1) for r in texts.collect()) == [(p, n, f"p{p} line {n}", 110.0) for p in (1, 2) for n in (1, 3)]
    whole = documents.extract_whole(texts.withColumn("block_no", F.col("label")), lambda: lambda rows: [{"raw": json.dumps({"thong_tin_chung": {"ghi_chu": r["text"]}})} for r in rows]).first()
    assert json.loads(whole.result)["thong_tin_chung"]["ghi_chu"] == "p1 line 1\np1 line 3\np2 line 1\np2 line 3"
    from folioframe.streaming import stub_extractor

    merged = documents.extract_windows(texts, stub_extractor).first()
    assert merged.n_pages == 2 and json.loads(merged.result)["danh_sach_doi_tuong"][0]["bi_cao_vn"]["ho_va_ten"] == "p1 line"
    drawn = documents.drawn(texts.withColumns({"page_w": F.lit(1000), "page_h": F.lit(1000)})).collect()
    assert len(drawn) == 4 and {r.anchor for r in drawn} == {"left"}


def test_tables_from_components(spark):
    from folioframe.plans import documents

    words = [("t", n, x, y, x + 80.0, y + 20.0, f"{n}", "table", 1) for n, (x, y) in enumerate(((0.0, 0.0), (100.0, 0.0), (0.0, 30.0), (100.0, 30.0)))]
    cells = spark.createDataFrame(words, "table_id string, b_idx int, b_x0 double, b_y0 double, b_x1 double, b_y1 double, text string, layout_type string, page_number int")
    parts = [("t", "table row", i, 0.0, 30.0 * i, 200.0, 30.0 * i + 25) for i in (0, 1)] + [("t", "table column", i, 100.0 * i, 0.0, 100.0 * i + 90, 60.0) for i in (0, 1)]
    parts += [("t", "table column header", 0, 0.0, 0.0, 200.0, 25.0)]
    components = spark.createDataFrame(parts, "table_id string, label string, r_idx int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    box = spark.createDataFrame([("t", 1, 1, 0.0, 0.0, 200.0, 60.0)], "table_id string, doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert documents.tables_as_blocks(cells, components, box).first().text == "| 0 | 1 |\n| --- | --- |\n| 2 | 3 |\n"


def test_letterboxed_detections(spark):
    rows = [("i", n, x, 10.0, x + 20, 30.0, s, c, 2.0, 2.0, 5.0, 5.0) for n, (x, s, c) in enumerate(((10.0, 0.9, 0), (11.0, 0.8, 0), (10.0, 0.05, 0), (10.0, 0.7, 1), (10.0, 0.7, 9)))]
    df = spark.createDataFrame(rows, "image string, idx int, x0 double, y0 double, x1 double, y1 double, score double, cls int, scale_x double, scale_y double, pad_x double, pad_y double")
    assert sorted((r.type, r.x0, r.y1) for r in layout.decode_letterboxed(df, ["Text", "Title"]).collect()) == [("text", 10.0, 50.0), ("title", 10.0, 50.0)]
    raw = spark.createDataFrame([("i", 0, 10.0, 10.0, 4.0, 4.0, [0.1, 0.9], 1.0, 2.0), ("i", 1, 10.0, 10.0, 4.0, 4.0, [0.1, 0.2], 1.0, 1.0)], "image string, idx int, cx double, cy double, w double, h double, scores array<double>, scale_x double, scale_y double")
    assert [(r.cls, r.x0, r.y0) for r in layout.decode_detections(raw, 0.5, 0.2).collect()] == [(1, 8.0, 16.0)]


def test_more_image_steps():
    image = np.arange(40 * 60 * 3, dtype=np.float64).reshape(40, 60, 3)
    assert images.resize_long_side(100)({"image": image})["image"].shape == (128, 128, 3)
    out = images.resize_on_canvas(64, 32)({"image": image, "points": np.array([[0, 0, 60, 40]])})
    assert out["image"].shape == (64, 64, 3) and out["points"].tolist() == [[0, 0, 60, 32]]
    assert images.uncovered_box(10, 8, [(0, 0, 9, 3), (0, 4, 4, 7)]) == (5, 4, 10, 8) and images.uncovered_box(4, 4, [(0, 0, 9, 9)]) is None
    assert images.stack_crops([image, image[:, :0]]).shape == (132, 1400, 3)
    assert images.upright(image[:, :20]).shape == (20, 40, 3)
    assert images.crop(10, 10, 20, 20)({"image": image})["image"].shape == (18, 18, 3)


def test_most_covered(spark):
    boxes = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0)], "page int, b_idx int, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    regions = spark.createDataFrame([(1, 1, 5.0, 0.0, 15.0, 10.0), (1, 2, 0.0, 0.0, 5.0, 5.0), (1, 3, 1.0, 1.0, 2.0, 2.0)], "page int, r_idx int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    assert [(r.b_idx, r.r_idx) for r in layout.most_covered(boxes, regions).collect()] == [(7, 2)]


def test_sources(spark, tmp_path):
    from folioframe.sources import read_files, read_ocr, write_json, write_text

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.b.png").write_bytes(b"x")
    (tmp_path / "in" / "skip.txt").write_text("x")
    assert [(r.doc_id, bytes(r.content)) for r in read_files(spark, str(tmp_path / "in")).collect()] == [("a.b", b"x")]
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "doc.json").write_text(json.dumps({"pages": [{"page": 1, "width": 5, "height": 6, "blocks": [{"text": "é", "x0": 1, "y0": 2, "x1": 3, "y1": 4}]}]}, indent=2))
    blocks = read_ocr(spark, str(tmp_path / "ocr"))
    assert [(r.doc_id, r.block_no, r.text, r.x1) for r in blocks.collect()] == [("doc", 1, "é", 3.0)]
    write_json(blocks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    write_text(pages.document_text(blocks), F.col("text"), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text" / "doc_id=doc")).collect()] == ["é"]


def test_least_compatible_against_pairs(spark):
    people = [(i, s, d, p) for i, (s, d, p) in enumerate((s, d, p) for s in ("a", "b", None) for d in (None, "", "01/01/1990", "02/01/1990") for p in ("x1", None, "y2", "") for _ in range(2))]
    random.Random(5).shuffle(people)
    people = [(n, *row[1:]) for n, row in enumerate(people)]
    df = spark.createDataFrame(people, "person long, scope string, dob_key string, id_key string")
    a, b = df.alias("a"), df.alias("b")
    fit = merge.keys_compatible(F.col("a.dob_key"), F.col("a.id_key"), F.col("b.dob_key"), F.col("b.id_key"))
    pairs = a.join(b, F.col("a.scope") == F.col("b.scope")).where("b.person < a.person").where(fit)
    want = {(r.p, r.m) for r in pairs.groupBy(F.col("a.person").alias("p")).agg(F.min("b.person").alias("m")).collect()}
    assert {(r.person, r.matched) for r in merge.least_compatible(df, ["scope"], "person").collect()} == want
    assert merge.least_compatible(df.limit(0), ["scope"], "person").count() == 0


@pytest.mark.parametrize("batch", [4, 16, 50])
def test_batches_by_width_pad_little(spark, batch):
    """On the boxes of part: every row answered once under its own key, and padding below the bound."""
    from folioframe.inference import infer_by_width
    from folioframe.plans import derived as d

    boxes = d.boxes(spark, "/root/testdata/sf0.001").withColumn("_width", F.lit("own"))
    wide = F.ceil((F.col("x1") - F.col("x0")) * 48 / (F.col("y1") - F.col("y0")))

    def padded():
        def model(rows):
            widths = [-(-(r["x1"] - r["x0"]) * 48 // (r["y1"] - r["y0"])) for r in rows]
            return [{"padded": max(widths), "own": w, "size": len(rows)} for w in widths]

        return model

    out = infer_by_width(boxes, padded, "padded long, own long, size int", wide, batch=batch)
    got = out.collect()
    assert out.columns == [*boxes.columns, "padded", "own", "size", "error"] and sorted(r.idx for r in got) == sorted(r.idx for r in boxes.collect())
    assert all(r.own == math.ceil((r.x1 - r.x0) * 48 / (r.y1 - r.y0)) and r.error is None and r.size <= batch for r in got)
    seams = 2 * out.rdd.getNumPartitions()
    spread = max(r.own for r in got) - min(r.own for r in got)
    assert sum(r.padded - r.own for r in got) <= batch * spread
    plain = infer(boxes, padded, "padded long, own long, size int", batch=batch).collect()
    assert sum(r.padded - r.own for r in got) < 0.5 * sum(r.padded - r.own for r in plain) and len({(r.padded, r.size) for r in got}) <= len(got) // batch + seams + 1
