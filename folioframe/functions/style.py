"""Rule-based text styles and how blocks are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.functions.text import SPACE, is_blank, strip

# The patterns that set a style, and its font.
RECIPIENTS = rf"(?iu)^{SPACE}*(Nơi\s+nhận|Noi\s+nhan)\s*:?"
MOTTO = r"(?iu)(ĐỘC\s+LẬP|DOC\s+LAP).*(TỰ\s+DO|TU\s+DO).*(HẠNH\s+PHÚC|HANH\s+PHUC)"
FONT, SIZE = "Times New Roman", 13.0


def all_caps(c: Column) -> Column:
    """At least one letter, and none that is not upper case."""
    return c.rlike(r"\p{L}") & ~c.rlike(r"[^\P{L}\p{Lu}]")


def alignment(x0: Column, x1: Column, page_w: Column) -> Column:
    w = x1 - x0
    return (
        F.when((F.abs((x0 + x1) / 2 - page_w / 2) < page_w * 0.12) & (w < page_w * 0.65), "center")
        .when((x0 / page_w > 0.50) & (w < page_w * 0.45), "right")
        .when(w > page_w * 0.75, "justify")
        .otherwise("left")
    )


def style(text: Column, x0: Column, x1: Column, page_w: Column) -> Column:
    """struct<font,size,bold,italic,underline,align>; the first rule that holds decides."""
    t = F.coalesce(text, F.lit(""))
    to, motto, caps = t.rlike(RECIPIENTS), t.rlike(MOTTO), all_caps(t)
    return F.struct(
        F.lit(FONT).alias("font"),
        F.lit(SIZE).alias("size"),
        (to | motto | caps).alias("bold"),
        to.alias("italic"),
        (~to & motto).alias("underline"),
        F.when(to, "left").when(motto, "center").otherwise(alignment(x0, x1, page_w)).alias("align"),
    )


def font_name(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, "bold-italic").when(bold, "bold").when(italic, "italic").otherwise("regular")


def draw_commands(blocks: DataFrame) -> DataFrame:
    """One row per line of each block (doc_id, page, block_no, text, x0..y1, page_w, page_h, style).

    y runs upward; a block's last line stands on its lower edge. Justified text is drawn from the left."""
    b = blocks.where(~is_blank(F.col("text")))
    lines = F.split(strip(F.col("text")), "\n")
    b = b.select("*", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("line_no", "line"))
    x0, x1 = g.scale_x(F.col("x0"), F.col("page_w")), g.scale_x(F.col("x1"), F.col("page_w"))
    base = F.lit(g.A4_HEIGHT) - g.scale_y(F.col("y1"), F.col("page_h"))
    align = F.col("style.align")
    return b.select(
        "doc_id",
        "page",
        "block_no",
        "line_no",
        "line",
        font_name(F.col("style.bold"), F.col("style.italic")).alias("font"),
        F.col("style.size").alias("size"),
        F.when(align.isin("center", "right"), align).otherwise("left").alias("anchor"),
        F.when(align == "center", (x0 + x1) / 2).when(align == "right", x1).otherwise(x0).alias("x"),
        (base + (F.col("n_lines") - 1 - F.col("line_no")) * F.col("style.size") * 1.3).alias("y"),
        F.col("style.underline").alias("underline"),
    )
