"""Documents end to end: detected boxes to ordered blocks, texts, and merged or single extractions.

Models come as factories (see folioframe.inference); everything between them is relational.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.detection import LINES, Detector, Reader, page_reader
from folioframe.functions import geometry as g
from folioframe.functions import style
from folioframe.inference import Model, infer
from folioframe.operators import layout, merge, pages, reading_order, tables
from folioframe.streaming import Extractor, extract_batch


def detected_blocks(boxes: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, page, x0..y1) to blocks numbered in reading order, too small ones left out."""
    kept = boxes.where(g.large_enough(g.Box.of(), least)).withColumn("__place", F.struct("y0", "x0", "y1", "x1"))
    order = reading_order.bucketed(F.col("y0"), F.col("x0"), F.col("__place"))
    return reading_order.numbered(kept, ["doc_id", "page"], order, "block_no").drop("__place")


def read_pages(page_images: DataFrame, detector: Callable[[], Detector], reader: Callable[[], Reader] | None, workers: int = 1, **options) -> DataFrame:
    """(doc_id, page, image) to lines: doc_id, page, page_w, page_h, block_no in reading order, x0..y1, quad, text, score, error.

    The images go to Python once and don't come back. Pages without lines have no rows; a page that fails has one, with its error and no line. Options are those of detection.page_reader()."""
    found = infer(page_images, page_reader(detector, reader, **options), LINES, batch=1, workers=workers, drop=("image", "regions"))
    lines = found.select("doc_id", "page", F.col("width").alias("page_w"), F.col("height").alias("page_h"), "error", F.posexplode_outer("lines").alias("at", "line"))
    lines = lines.where("line is not null or error is not null")
    box = [c.alias(n) for c, n in zip(g.quad_box(F.col("line.quad"), F.lit(1.0)), ("x0", "y0", "x1", "y1"), strict=True)]
    return lines.select("doc_id", "page", "page_w", "page_h", (F.col("at") + 1).alias("block_no"), *box, "line.quad", "line.text", "line.score", "error")


def read_with_tables(page_images: DataFrame, regions: DataFrame, table_blocks: DataFrame, detector: Callable[[], Detector], reader: Callable[[], Reader], **options) -> DataFrame:
    """Pages by regions: the tables' blocks (see tables_as_blocks), and the lines read outside all regions, in one
    reading order by y0, then x0, then text: doc_id, page, x0..y1, text, type, block_no.

    Regions (doc_id, page, x0..y1) are gathered for each page; pages without any are read whole. A page that fails keeps its tables, and has
    a row without a place that says why (error; null elsewhere)."""
    covered = regions.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("regions"))
    lines = read_pages(page_images.join(covered, ["doc_id", "page"], "left"), detector, reader, **options)
    texts = lines.where("text <> ''").select("doc_id", "page", "x0", "y0", "x1", "y1", "text", F.lit("text").alias("type"))
    placed = reading_order.numbered(texts.unionByName(table_blocks), ["doc_id", "page"], [F.col(c) for c in ("y0", "x0", "text")], "block_no")
    failed = lines.where("error is not null").select("doc_id", "page", F.lit("error").alias("type"), "error")
    return placed.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def recognized(blocks: DataFrame, read: Callable[[], Model], size: int = 20, workers: int = 4) -> DataFrame:
    """Blocks with texts: batches of a page go to a model that answers rows (doc_id, page, batch_no, labels) with `raw`.

    A batch that fails or doesn't parse gives no texts; its blocks go, and missing_labels() finds them."""
    b = pages.assign_batches(blocks, size)
    batches = b.groupBy("doc_id", "page", "batch_no").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    replies = infer(batches, read, "raw string", batch=1, workers=workers)
    return pages.assemble(b, pages.reply_texts(replies))


def extract_whole(blocks: DataFrame, extract: Callable[[], Model], clean: bool = False) -> DataFrame:
    """(doc_id, result JSON) from the whole text at once; placeholders stay and entities aren't merged, unless clean."""
    raw = infer(pages.document_text(blocks), extract, "raw string", batch=1).where("error is null")
    if clean:
        return merge.merge_partials(raw.select("doc_id", F.lit(1).alias("page"), F.col("raw").alias("partial")))
    return raw.select("doc_id", F.to_json(merge.read_extraction(F.col("raw")), {"ignoreNullFields": "false"}).alias("result"))


def extract_windows(blocks: DataFrame, extract: Extractor, overlap: int = 1) -> DataFrame:
    """(doc_id, n_pages, skipped, result JSON) from overlapping page windows, merged in order."""
    return extract_batch(pages.page_text(blocks), extract, overlap)


def drawn(blocks: DataFrame) -> DataFrame:
    """Draw commands of blocks with page_w and page_h."""
    return style.draw_commands(blocks.withColumn("style", style.style(F.col("text"), F.col("x0"), F.col("x1"), F.col("page_w"))))


def tables_as_blocks(cells: DataFrame, components: DataFrame, boxes: DataFrame) -> DataFrame:
    """Markdown blocks of tables: cells (table_id, b_idx, b_x0.., text, layout_type, page_number), their components
    (table_id, label, r_idx, r_x0..), and the tables' own boxes (table_id, doc_id, page, x0..y1)."""
    c = tables.tag_cells(cells, components)
    c = c.select(
        "table_id", F.col("b_idx").alias("cell_no"), "text", *(F.col(a).cast("double").alias(b) for a, b in (("b_x0", "x0"), ("b_x1", "x1"), ("b_y0", "top"), ("b_y1", "bottom"))), "layout_type", "page_number",
        "R", "R_top", "R_bott", "H", "H_top", "H_bott", "H_left", "H_right", "C", "C_left", "C_right", "SP",
    )
    return boxes.join(tables.construct_tables(c), "table_id").select("doc_id", "page", "x0", "y0", "x1", "y1", F.col("body").alias("text"), F.lit("table").alias("type"))


def tagged_blocks(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks (page, b_idx, b_x0.., text) with layout_type, without page furniture that repeats."""
    tags = layout.tag_layout(blocks, regions)
    return layout.drop_repeated(blocks.join(tags, ["page", "b_idx"]), "page")
