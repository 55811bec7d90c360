"""Pages and blocks: batches, replies, assembly, text roll-up and page windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import is_blank, parse_reply, strip


def explode_pages(ocr: DataFrame, doc_id: Column) -> DataFrame:
    """One row per block of nested OCR documents: doc_id, page, width, height, block_no and the block's fields."""
    pages = ocr.select(doc_id.alias("doc_id"), F.explode("pages").alias("p"))
    return pages.select("doc_id", "p.page", "p.width", "p.height", F.posexplode("p.blocks").alias("pos", "b")).select(
        "doc_id", "page", "width", "height", (F.col("pos") + 1).alias("block_no"), "b.text", "b.x0", "b.y0", "b.x1", "b.y1", "b.type"
    )


def nest_pages(blocks: DataFrame) -> DataFrame:
    """The reverse: doc_id and pages, in page and block order."""
    block = F.struct("block_no", "text", "x0", "y0", "x1", "y1", "page", F.lit(None).cast("string").alias("type"))
    pages = blocks.groupBy("doc_id", "page", "width", "height").agg(F.array_sort(F.collect_list(block)).alias("b"))
    plain = F.transform("b", lambda b: b.dropFields("block_no"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", plain.alias("blocks")))).alias("pages"))


def assign_batches(blocks: DataFrame, size: int = 20) -> DataFrame:
    """Adds label (from 1 within the page, by block_no) and batch_no."""
    label = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block_no"))
    return blocks.withColumn("label", label).withColumn("batch_no", F.floor((F.col("label") - 1) / size).cast("int"))


def reply_texts(replies: DataFrame) -> DataFrame:
    """(doc_id, page, label, text) from replies (doc_id, page, batch_no, raw); a later batch's text wins, a broken reply gives none."""
    each = replies.select("doc_id", "page", "batch_no", F.explode(parse_reply(F.col("raw"))).alias("label", "text"))
    return each.groupBy("doc_id", "page", F.col("label").try_cast("int").alias("label")).agg(F.max_by("text", "batch_no").alias("text"))


def assemble(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks with their texts, stripped; blocks without one go. Coordinates are rounded half up to one decimal."""
    joined = blocks.drop("text").join(texts, ["doc_id", "page", "label"]).withColumn("text", strip(F.col("text"))).where(~is_blank(F.col("text")))
    return joined.withColumns({c: F.round(c, 1) for c in ("x0", "y0", "x1", "y1")})


def missing_labels(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels of each page for which no text came."""
    return blocks.select("doc_id", "page", "label").join(texts.select("doc_id", "page", "label"), ["doc_id", "page", "label"], "left_anti")


def page_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): non-blank lines in block order; blank pages vanish."""
    kept = blocks.where(~is_blank(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("block_no", strip(F.col("text")).alias("t"))))
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def document_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the pages' texts, joined by line ends."""
    pages = F.array_sort(F.collect_list(F.struct("page", "text")))
    return page_text(blocks).groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda x: x["text"]), "\n").alias("text"))


def plain_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, page, text or null): each page under a comment with its number, empty pages too."""
    one = F.concat(F.lit("<!-- Page "), F.col("page").cast("string"), F.lit(" -->\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("page", one.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("text"))


def page_windows(pages: DataFrame, overlap: int = 1) -> DataFrame:
    """For each page (doc_id, page, text) the text of it and the `overlap` pages before; windows that are blank go."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(-overlap, 0)
    held = F.collect_list(F.struct("page", "text")).over(w)
    text = F.array_join(F.transform(F.filter(held, lambda x: ~is_blank(x["text"])), lambda x: x["text"]), "\n")
    out = pages.withColumn("first_page", F.min("page").over(w)).withColumn("window_text", text)
    return out.where(~is_blank(F.col("window_text"))).select("doc_id", "page", "first_page", "window_text")


def page_markdown(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, markdown) from fragments (doc_id, page, y, text) by y, a blank line between them."""
    parts = F.array_sort(F.collect_list(F.struct("y", "text")))
    return fragments.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("markdown"))
