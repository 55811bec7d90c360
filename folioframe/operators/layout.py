"""Box joins and layout tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.functions.text import is_garbage, strip

# Layout types in the order in which they claim boxes, and those that may be dropped.
PRIORITY = ("footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation")
DROPPABLE = ("footer", "header", "reference")
#: Height of the bands that narrow a box join on crowded pages.
BAND = 400
#: Rows that one task of a box join takes; each may meet many of its page.
TASK_ROWS = 25_000


def _tasks(boxes: DataFrame) -> int:
    """Tasks for a join of these boxes: as many more as there are more boxes, however few bytes they have."""
    return 1 + boxes.count() // TASK_ROWS


def _banded(df: DataFrame, prefix: str) -> DataFrame:
    first, last = F.floor(F.col(f"{prefix}y0") / BAND), F.floor(F.col(f"{prefix}y1") / BAND)
    return df.withColumn("band", F.explode(F.sequence(first, F.greatest(first, last))))


def overlapping(boxes: DataFrame, regions: DataFrame, page: str = "page") -> DataFrame:
    """Pairs of boxes (b_x0.., idx b_idx) and regions (r_.., r_idx) of a page that are not disjoint.

    An equi-join on page and height band, each pair taken in the band where the later of the two
    begins, so that no pair comes twice."""
    n = _tasks(boxes)
    pairs = _banded(boxes, "b_").repartition(n, page, "band").join(_banded(regions, "r_").repartition(n, page, "band"), [page, "band"])
    a, b = g.Box.of("b_"), g.Box.of("r_")
    return pairs.where((F.floor(F.greatest("b_y0", "r_y0") / BAND) == F.col("band")) & ~g.disjoint(a, b)).drop("band")


def best_overlap(boxes: DataFrame, regions: DataFrame, threshold: float, by: tuple[str, ...] = (), page: str = "page") -> DataFrame:
    """For each box (and each value of `by`) the region that covers most of it, at least `threshold`.

    Equal cover: the region that is covered most, then the one with the greatest r_idx."""
    a, b = g.Box.of("b_"), g.Box.of("r_")
    pairs = overlapping(boxes, regions, page).withColumn("cover", g.overlap_ratio(a, b)).withColumn("covered", g.overlap_ratio(b, a))
    # a cover of 0.3 is not below 0.3 for the last bit of a quotient
    pairs = pairs.where(F.col("cover") >= threshold - 1e-12)
    rank = F.struct("cover", "covered", "r_idx")
    keep = [c for c in pairs.columns if c not in (page, "b_idx", *by)]
    best = pairs.groupBy(page, "b_idx", *by).agg(F.max_by(F.struct(*keep), rank).alias("m"))
    return best.select(page, "b_idx", *by, "m.*")


def nearest_column(boxes: DataFrame, columns: DataFrame, page: str = "page") -> DataFrame:
    """For each box the column whose edges or middle lie nearest in x; equal distance: the least r_idx. No overlap needed."""
    n = _tasks(boxes)
    pairs = boxes.repartition(n, page).join(columns.repartition(n, page), page)
    middle = F.abs((F.col("b_x0") + F.col("b_x1")) - (F.col("r_x0") + F.col("r_x1"))) / 2
    distance = F.least(F.abs(F.col("b_x0") - F.col("r_x0")), F.abs(F.col("b_x1") - F.col("r_x1")), middle)
    pairs = pairs.withColumn("distance", distance).where("distance < 1000000")
    return pairs.groupBy(page, "b_idx").agg(F.min("distance").alias("distance"), F.min_by("r_idx", F.struct("distance", "r_idx")).alias("r_idx"))


def keep_region(score: Column, kind: Column) -> Column:
    return (score >= 0.4) | ~F.lower(kind).isin(*DROPPABLE)


def tag_layout(boxes: DataFrame, regions: DataFrame, threshold: float = 0.4, page: str = "page") -> DataFrame:
    """(page, b_idx, layout_type, region): the first type in order of PRIORITY with a region that covers the box.

    region is "type-r_idx"; equations count as figures; boxes without a region have an empty type."""
    order = F.array_position(F.array(*[F.lit(t) for t in PRIORITY]), F.col("r_type"))
    hits = best_overlap(boxes, regions.where(F.col("r_type").isin(*PRIORITY)), threshold, ("r_type",), page).withColumn("o", order)
    first = hits.groupBy(page, "b_idx").agg(F.min_by(F.struct("r_type", "r_idx"), "o").alias("m"))
    out = boxes.select(page, "b_idx").join(first, [page, "b_idx"], "left")
    kind = F.col("m.r_type")
    return out.select(
        page,
        "b_idx",
        F.coalesce(F.when(kind == "equation", "figure").otherwise(kind), F.lit("")).alias("layout_type"),
        F.coalesce(F.concat(kind, F.lit("-"), F.col("m.r_idx")), F.lit("")).alias("region"),
    )


def keeps_place(kind: Column, top: Column, bottom: Column, page_h: Column) -> Column:
    """Headers and footers away from the page's edge are content; references are not."""
    return F.when(kind == "footer", bottom < 0.9 * page_h).when(kind == "header", top > 0.1 * page_h).otherwise(kind != "reference")


def drop_repeated(boxes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Boxes (doc, layout_type, text) without garbage texts and without texts that a document's
    headers, footers or references hold more than once, per type.

    The repeated texts are counted as they are, and compared with the box's text stripped."""
    clean = boxes.where(~F.coalesce(is_garbage(F.col("text")), F.lit(False)))
    often = clean.where(F.col("layout_type").isin(*DROPPABLE)).groupBy(doc, "layout_type", "text").count().where("count > 1")
    often = often.select(doc, F.col("text").alias("bare")).distinct()
    return clean.withColumn("bare", strip(F.col("text"))).join(often, [doc, "bare"], "left_anti").drop("bare")


def unvisited(regions: DataFrame, tagged: DataFrame, page: str = "page") -> DataFrame:
    """Figure and equation regions that no box took, as boxes without text."""
    figures = regions.where(F.col("r_type").isin("figure", "equation"))
    number = F.row_number().over(Window.partitionBy(page).orderBy("r_idx")) - 1
    taken = tagged.where("region <> ''").select(page, F.col("region"))
    out = figures.withColumn("region", F.concat("r_type", F.lit("-"), F.col("r_idx"))).withColumn("figure", F.concat(F.lit("figure-"), number))
    return out.join(taken, [page, "region"], "left_anti").select(page, "r_idx", "figure", F.lit("").alias("text"))


def suppress(boxes: DataFrame, threshold: float, plus: int = 0, strict: bool = False, keys: tuple[str, ...] = ("page", "cls")) -> DataFrame:
    """Non-maximum suppression within each page and class of (keys, score, idx, x0, y0, x1, y1)."""
    fields = ("score", "idx", "x0", "y0", "x1", "y1")
    kind = "struct<" + ",".join(f"{f}:{dict(boxes.dtypes)[f]}" for f in fields) + ">"
    kept = boxes.groupBy(*keys).agg(g.keep_by_nms(F.collect_list(F.struct(*fields)), kind, threshold, plus, strict).alias("k"))
    return kept.select(*keys, F.explode("k").alias("k")).select(*keys, "k.*")


def decode_detections(raw: DataFrame, threshold: float, iou: float) -> DataFrame:
    """Rows (image, idx, cx, cy, w, h, scores array, scale_x, scale_y) to boxes: best class above the
    threshold, corners at the image's scale, then suppression per class."""
    best = F.array_max("scores")
    boxes = raw.where(best > threshold).withColumn("score", best).withColumn("cls", (F.array_position("scores", best) - 1).cast("int"))
    x0, y0, x1, y1 = g.from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    boxes = boxes.select("image", "cls", "score", "idx", (x0 * F.col("scale_x")).alias("x0"), (y0 * F.col("scale_y")).alias("y0"), (x1 * F.col("scale_x")).alias("x1"), (y1 * F.col("scale_y")).alias("y1"))
    return suppress(boxes, iou, strict=True, keys=("image", "cls"))


def most_covered(boxes: DataFrame, regions: DataFrame, page: str = "page") -> DataFrame:
    """For each box the region of which it covers most, more than nothing; equal cover: the least r_idx."""
    pairs = overlapping(boxes, regions, page).withColumn("cover", g.overlap_ratio(g.Box.of("r_"), g.Box.of("b_"))).where("cover > 0")
    return pairs.groupBy(page, "b_idx").agg(F.max_by("r_idx", F.struct("cover", -F.col("r_idx"))).alias("r_idx"))


def decode_letterboxed(raw: DataFrame, labels: list[str], threshold: float = 0.08, iou: float = 0.45) -> DataFrame:
    """Rows (image, idx, x0, y0, x1, y1, score, cls, scale_x, scale_y, pad_x, pad_y) to boxes at the image's
    scale with their label: padding off, then scaled, then suppression per class."""
    b = raw.where((F.col("score") > threshold) & (F.col("cls") < len(labels)))
    b = b.withColumns({c: (F.col(c) - F.col(f"pad_{c[0]}")) * F.col(f"scale_{c[0]}") for c in ("x0", "y0", "x1", "y1")})
    kept = suppress(b.select("image", "cls", "score", "idx", "x0", "y0", "x1", "y1"), iou, plus=1, keys=("image", "cls"))
    return kept.withColumn("type", F.lower(F.get(F.array(*[F.lit(x) for x in labels]), F.col("cls"))))


def above(df: DataFrame, score: float = 0.5) -> DataFrame:
    return df.where(F.col("score") >= score)


def first_candidates(df: DataFrame, keys: list[str], order: str, most: int = 1000) -> DataFrame:
    """The first `most` rows of each group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
