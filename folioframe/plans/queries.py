"""Queries over the driver's tables, one or more for each operator, with their SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import decode, laws, style, text
from folioframe.functions import geometry as g
from folioframe.operators import layout, merge, pages, reading_order, tables
from folioframe.plans import derived as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register the function under its name; sql may use the views before it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + ", ".join(views) + sql) if views else sql
        return f

    return add


def drawn_blocks(blocks: DataFrame) -> DataFrame:
    b = blocks.withColumns({"page_w": F.lit(d.PAGE_W), "page_h": F.lit(d.PAGE_H)})
    return style.draw_commands(b.withColumn("style", style.style(F.col("text"), F.col("x0"), F.col("x1"), F.col("page_w"))))


NONBLANK = "length(regexp_replace(text, '\\s+', '', 'g')) > 0"
ALIGN = (
    "CASE WHEN abs((x0 + x1) / 2 - 1785 / 2) < 1785 * 0.12 AND x1 - x0 < 1785 * 0.65 THEN 'center' WHEN x0 / 1785 > 0.5 AND x1 - x0 < 1785 * 0.45 THEN 'right' "
    "WHEN x1 - x0 > 1785 * 0.75 THEN 'justify' ELSE 'left' END"
)


@query(f" SELECT doc_id, string_agg(t, chr(10) ORDER BY page) AS text FROM (SELECT doc_id, page, string_agg(trim(text), chr(10) ORDER BY block_no) AS t FROM v_blocks WHERE {NONBLANK} GROUP BY 1, 2) GROUP BY 1", d.BLOCKS)
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.document_text(d.blocks(spark, sf_dir))


@query(f" SELECT doc_id, block_no, {ALIGN} AS align FROM v_blocks", d.BLOCKS)
def q_style_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.blocks(spark, sf_dir).select("doc_id", "block_no", style.alignment(F.col("x0"), F.col("x1"), F.lit(d.PAGE_W)).alias("align"))


@query(" SELECT doc_id, block_no FROM v_blocks WHERE regexp_matches(text, '\\pL') AND NOT regexp_matches(text, '[^\\PL\\p{Lu}]')", d.BLOCKS)
def q_allcaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.blocks(spark, sf_dir).where(style.all_caps(F.col("text"))).select("doc_id", "block_no")


@query(f" SELECT doc_id, block_no, coalesce(regexp_matches(text, '\\pL') AND NOT regexp_matches(text, '[^\\PL\\p{{Lu}}]'), false) AS bold, false AS italic, {ALIGN} AS align, 13.0::DOUBLE AS size FROM v_blocks", d.BLOCKS)
def q_style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = style.style(F.col("text"), F.col("x0"), F.col("x1"), F.lit(d.PAGE_W))
    return d.blocks(spark, sf_dir).select("doc_id", "block_no", s.alias("s")).select("doc_id", "block_no", "s.bold", "s.italic", "s.align", "s.size")


@query(
    " SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY (round_even(y0 / 5.0, 0) * 5)::BIGINT, x0, block_no) AS order_no FROM v_blocks", d.BLOCKS
)
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.blocks(spark, sf_dir)
    return reading_order.numbered(b, ["doc_id", "page"], reading_order.bucketed(F.col("y0"), F.col("x0"), F.col("block_no"))).select("doc_id", "page", "block_no", "order_no")


@query(" SELECT doc_id, block_no FROM v_blocks WHERE x1 - x0 >= 60 AND y1 - y0 >= 5", d.BLOCKS)
def q_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.blocks(spark, sf_dir).where(g.large_enough(g.Box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1") + 55), 60))
    return b.where(F.col("y1") - F.col("y0") >= 5).select("doc_id", "block_no")


@query(
    " SELECT doc_id, page, (label - 1) // 20 AS batch_no, count(*) AS n, min(label) AS first_label FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) AS label FROM v_blocks) GROUP BY 1, 2, 3",
    d.BLOCKS,
)
def q_batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assign_batches(d.blocks(spark, sf_dir)).groupBy("doc_id", "page", "batch_no").agg(F.count("*").alias("n"), F.min("label").alias("first_label"))


@query(
    " SELECT doc_id, page, first_page, window_text FROM (SELECT doc_id, page, min(page) OVER w AS first_page, string_agg(text, chr(10)) OVER w AS window_text FROM v_pages"
    " WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))",
    d.PAGES,
)
def q_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_windows(d.pages(spark, sf_dir))


@query(" SELECT doc_id, string_agg('<!-- Page ' || page || ' -->' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS text FROM v_pages GROUP BY 1", d.PAGES)
def q_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.plain_text(d.pages(spark, sf_dir))


@query(" SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY y0, text) AS markdown FROM v_blocks GROUP BY 1, 2", d.BLOCKS)
def q_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_markdown(d.blocks(spark, sf_dir).withColumnRenamed("y0", "y"))


@query(" SELECT count(*) AS n_blocks, count(DISTINCT (doc_id, page)) AS n_pages, count(DISTINCT doc_id) AS n_docs FROM v_blocks", d.BLOCKS)
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return p.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("p")).agg(F.sum("n").alias("n_blocks"), F.sum("p").alias("n_pages"), F.count("*").alias("n_docs"))


PAIRS = (
    ", v_pairs AS (SELECT b.page, b.idx AS b_idx, r.r_idx, r.r_type, greatest(least(b.x1, r_x1) - greatest(b.x0, r_x0), 0) * greatest(least(b.y1, r_y1) - greatest(b.y0, r_y0), 0) AS shared,"
    " (b.x1 - b.x0) * (b.y1 - b.y0) AS area, (r_x1 - r_x0) * (r_y1 - r_y0) AS r_area FROM v_boxes b JOIN v_regions r ON b.page = r.page AND b.x0 <= r_x1 AND r_x0 <= b.x1 AND b.y0 <= r_y1 AND r_y0 <= b.y1)"
)


@query(
    PAIRS + " SELECT page, b_idx, r_idx, r_type FROM (SELECT *, row_number() OVER (PARTITION BY page, b_idx ORDER BY shared / area DESC, shared / r_area DESC, r_idx DESC) AS n FROM v_pairs WHERE shared * 10 >= area * 3) WHERE n = 1",
    d.BOXES, d.REGIONS,
)
def q_overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.best_overlap(d.prefixed(d.boxes(spark, sf_dir), "b_"), d.regions(spark, sf_dir), 0.3)
    return found.select("page", "b_idx", "r_idx", "r_type")


@query(PAIRS + " SELECT page, b_idx, r_idx, shared FROM v_pairs", d.BOXES, d.REGIONS)
def q_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.overlapping(d.prefixed(d.boxes(spark, sf_dir), "b_"), d.regions(spark, sf_dir))
    return found.select("page", "b_idx", "r_idx", g.shared_area(g.Box.of("b_"), g.Box.of("r_")).alias("shared"))


@query(
    " SELECT page, b_idx, min(dist) AS distance, arg_min(r_idx, dist * 1000000000 + r_idx) AS r_idx FROM (SELECT b.page, b.idx AS b_idx, r_idx,"
    " least(abs(b.x0 - r_x0)::DOUBLE, abs(b.x1 - r_x1)::DOUBLE, abs(b.x0 + b.x1 - r_x0 - r_x1) / 2) AS dist FROM v_boxes b JOIN v_regions r ON b.page = r.page) GROUP BY 1, 2",
    d.BOXES, d.REGIONS,
)
def q_nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nearest_column(d.prefixed(d.boxes(spark, sf_dir), "b_"), d.regions(spark, sf_dir))


TAGS = (
    PAIRS
    + ", v_best AS (SELECT page, b_idx, r_type, r_idx, list_position(["
    + ", ".join(f"'{x}'" for x in layout.PRIORITY)
    + "], r_type) AS o FROM (SELECT *, row_number() OVER (PARTITION BY page, b_idx, r_type ORDER BY shared / area DESC, shared / r_area DESC, r_idx DESC) AS n FROM v_pairs WHERE shared * 10 >= area * 4) WHERE n = 1),"
    " v_tag AS (SELECT page, b_idx, arg_min(r_type, o) AS kind, arg_min(r_idx, o) AS r FROM v_best GROUP BY 1, 2),"
    " v_tagged AS (SELECT b.page, b.idx AS b_idx, coalesce(CASE kind WHEN 'equation' THEN 'figure' ELSE kind END, '') AS layout_type, coalesce(kind || '-' || r, '') AS region"
    " FROM v_boxes b LEFT JOIN v_tag t ON t.page = b.page AND t.b_idx = b.idx)"
)


@query(TAGS + " SELECT * FROM v_tagged", d.BOXES, d.REGIONS)
def q_layout_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tag_layout(d.prefixed(d.boxes(spark, sf_dir), "b_"), d.regions(spark, sf_dir))


@query(
    TAGS.replace("v_boxes", "v_sparse") + " SELECT page, r_idx, 'figure-' || n AS figure, '' AS text FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY r_idx) - 1 AS n FROM v_regions WHERE r_type IN ('figure', 'equation')) f"
    " WHERE NOT EXISTS (SELECT 1 FROM v_tagged t WHERE t.page = f.page AND t.region = f.r_type || '-' || f.r_idx)",
    d.BOXES, d.REGIONS, d.SPARSE,
)
def q_unvisited_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = d.regions(spark, sf_dir)
    return layout.unvisited(r, layout.tag_layout(d.prefixed(d.sparse(spark, sf_dir), "b_"), r))


@query(" SELECT page, r_idx, r_type FROM v_regions WHERE r_score >= 400 OR r_type NOT IN ('footer', 'header', 'reference')", d.BOXES, d.REGIONS)
def q_region_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.regions(spark, sf_dir).where(layout.keep_region(F.col("r_score") / 1000, F.col("r_type"))).select("page", "r_idx", "r_type")


@query(
    " SELECT page, r_idx, r_type FROM v_regions WHERE CASE r_type WHEN 'footer' THEN r_y1 < 0.9 * 2300 WHEN 'header' THEN r_y0 > 0.1 * 2300 ELSE r_type <> 'reference' END", d.BOXES, d.REGIONS
)
def q_header_footer_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.regions(spark, sf_dir).where(layout.keeps_place(F.col("r_type"), F.col("r_y0"), F.col("r_y1"), F.lit(2300))).select("page", "r_idx", "r_type")


def _nms_sql(plus: int, keep: str) -> str:
    inter = f"greatest(0, least(k.x1, b.x1) - greatest(k.x0, b.x0) + {plus}) * greatest(0, least(k.y1, b.y1) - greatest(k.y0, b.y0) + {plus})"
    iou = f"({inter}) / ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - ({inter}))"
    # the highest box that no kept box suppresses is kept next; rounds go down the ranks
    return (
        ", v_rank AS (SELECT *, row_number() OVER (PARTITION BY page, cls ORDER BY score DESC, idx DESC) AS n FROM v_group),"
        " v_kept AS (SELECT page, cls, n, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'idx': idx}] AS kept FROM v_rank WHERE n = 1 UNION ALL"
        f" SELECT r.page, r.cls, r.n, CASE WHEN len(list_filter(k.kept, lambda q: {iou.replace('k.', 'q.').replace('b.', 'r.')} {keep})) > 0 THEN k.kept"
        " ELSE list_append(k.kept, {'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'idx': r.idx}) END FROM v_kept k JOIN v_rank r ON r.page = k.page AND r.cls = k.cls AND r.n = k.n + 1),"
        " v_last AS (SELECT page, cls, arg_max(kept, n) AS kept FROM v_kept GROUP BY 1, 2) SELECT page, cls, unnest(list_transform(kept, lambda q: q.idx)) AS idx FROM v_last"
    )


GROUP = ", v_group AS (SELECT page // 8 AS page, cls, score, idx, x0, y0, x0 + 400 AS x1, y0 + 400 AS y1 FROM v_boxes)"


def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.boxes(spark, sf_dir)
    return b.select(F.floor(F.col("page") / 8).alias("page"), "cls", "score", "idx", "x0", "y0", (F.col("x0") + 400).alias("x1"), (F.col("y0") + 400).alias("y1"))


@query(GROUP + _nms_sql(1, "> 0.45"), d.BOXES)
def q_nms_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppress(_group(spark, sf_dir), 0.45, plus=1).select("page", "cls", "idx")


@query(GROUP + _nms_sql(0, ">= 0.2"), d.BOXES)
def q_nms_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppress(_group(spark, sf_dir), 0.2, strict=True).select("page", "cls", "idx")


FOOT = ", v_foot AS (SELECT doc_id, block_no, text, (['text', 'header', 'footer', 'reference'])[block_no % 4 + 1] AS layout_type FROM v_blocks)"


@query(
    FOOT + " SELECT doc_id, block_no FROM v_foot b WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, layout_type, text FROM v_foot WHERE layout_type <> 'text' GROUP BY 1, 2, 3 HAVING count(*) > 1) g WHERE g.doc_id = b.doc_id AND g.text = trim(b.text))",
    d.BLOCKS,
)
def q_repeated_footer_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("text", "header", "footer", "reference")]), (F.col("block_no") % 4 + 1).cast("int"))
    return layout.drop_repeated(d.blocks(spark, sf_dir).withColumn("layout_type", kinds)).select("doc_id", "block_no")


@query(" SELECT event_id, CASE WHEN lower(trim(header)) NOT IN ('null', 'không rõ', 'không xác định', 'n/a', 'none') THEN header END AS header FROM v_partials", d.PARTIALS)
def q_placeholder_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.partials(spark, sf_dir).select("event_id", text.null_if_placeholder(F.col("header")).alias("header"))


@query(
    " SELECT doc_id, arg_min(header, (ts, event_id)) FILTER (lower(trim(header)) NOT IN ('null', 'không rõ', 'không xác định', 'n/a', 'none')) AS header FROM v_partials GROUP BY 1", d.PARTIALS
)
def q_header_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_known(d.partials(spark, sf_dir), ["doc_id"], "page", "header")


@query(" SELECT person, name_key, dob_key, id_key FROM v_keys", d.PEOPLE)
def q_entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.person_keys(d.people(spark, sf_dir), F.col("name"), F.col("dob"), F.col("paper")).select("person", "name_key", "dob_key", "id_key")


@query(" SELECT person, dob_key FROM v_keys", d.PEOPLE)
def q_date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.people(spark, sf_dir).select("person", text.date_key(F.col("dob")).alias("dob_key"))


@query(" SELECT person, id_key FROM v_keys", d.PEOPLE)
def q_id_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.people(spark, sf_dir).select("person", text.id_key(F.col("paper")).alias("id_key"))


@query(" SELECT person, translate(name, '‘’‚ʼ`´', '''''''''''''') AS name FROM v_people", d.PEOPLE)
def q_quote_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.people(spark, sf_dir).select("person", text.fold_quotes(F.col("name")).alias("name"))


@query(
    " SELECT a.person, min(b.person) AS matched FROM v_keys a JOIN v_keys b ON b.nation = a.nation AND b.dob_key[4:5] = a.dob_key[4:5] AND b.person < a.person"
    " WHERE coalesce(a.dob_key = b.dob_key, true) AND coalesce(nullif(a.id_key, '') = nullif(b.id_key, ''), true) GROUP BY 1",
    d.PEOPLE,
)
def q_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = merge.person_keys(d.people(spark, sf_dir), F.col("name"), F.col("dob"), F.col("paper")).withColumn("month", F.substring("dob_key", 4, 2))
    return merge.least_compatible(k, ["nation", "month"], "person")


@query(" SELECT list_id, pos, code, dieu, khoan, diem, specific, display FROM v_shown", d.LAWS)
def q_law_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the items are written in full-width digits and letters; they parse as the plain ones do."""
    wide = F.translate("item", "0123456789BLHS", "０１２３４５６７８９ＢＬＨＳ")
    item = F.when(F.col("pos") % 3 == 0, wide).otherwise(F.col("item"))
    out = d.laws(spark, sf_dir).select("list_id", "pos", F.explode(laws.parse_clauses(item)).alias("c"))
    return out.select("list_id", "pos", *(f"c.{n}" for n in ("code", "dieu", "khoan", "diem", "specific", "display")))


@query(
    ", v_group AS (SELECT *, bool_or(specific) OVER (PARTITION BY list_id, code, dieu) AS exact FROM v_shown),"
    " v_first AS (SELECT *, row_number() OVER (PARTITION BY list_id, code, dieu, khoan, diem ORDER BY pos) AS n FROM v_group WHERE specific OR NOT exact)"
    " SELECT list_id, string_agg(display, '; ' ORDER BY pos) AS clauses FROM v_first WHERE n = 1 GROUP BY 1",
    d.LAWS,
)
def q_law_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laws.with_clauses(d.laws(spark, sf_dir), "item")
    lists = rows.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clauses"))), lambda x: x["clauses"]).alias("clauses"))
    return lists.select("list_id", F.array_join(laws.normal_list(F.col("clauses")), "; ").alias("clauses"))


@query(
    " SELECT list_id, string_agg(item, '; ' ORDER BY pos) AS items FROM (SELECT list_id, pos, item, row_number() OVER (PARTITION BY list_id, lower(item) ORDER BY pos) AS n FROM v_laws) WHERE n = 1 GROUP BY 1",
    d.LAWS,
)
def q_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = d.laws(spark, sf_dir).groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
    none = F.array().cast("array<string>")
    return lists.select("list_id", F.array_join(merge.ordered_distinct(none, F.col("items")), "; ").alias("items"))


@query(
    "SELECT event_id, event_id % 4 + 1 AS label, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR ELSE 'a' END AS text FROM events WHERE event_id % 4 <> 3"
)
def q_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('<think>x {</think> {"1": "'), "event_type", F.lit('"}'))).when(k == 1, F.concat(F.lit('```json\n{"2": "'), F.col("user_id").cast("string"), F.lit('"}\n```')))
    raw = raw.when(k == 2, 'Here: {"3": "a"}').otherwise('{"4": "b"} done')
    e = d.read(spark, sf_dir, "events").select("event_id", F.explode(text.parse_reply(raw)).alias("label", "text"))
    return e.withColumn("label", F.col("label").cast("long"))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = pages.assign_batches(d.blocks(spark, sf_dir))
    t = b.where("label % 7 <> 3").select("doc_id", "page", "label", F.when(F.col("label") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" t"), F.col("label"), F.lit(" "))).alias("text"))
    return b, t


@query(
    ", v_lab AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) AS label FROM v_blocks)"
    " SELECT doc_id, page, label, 't' || label AS text, x0, y0 FROM v_lab WHERE label % 7 <> 3 AND label % 5 <> 0",
    d.BLOCKS,
)
def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assemble(*_labelled(spark, sf_dir)).select("doc_id", "page", "label", "text", "x0", "y0")


@query(", v_lab AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) AS label FROM v_blocks) SELECT doc_id, page, label FROM v_lab WHERE label % 7 = 3", d.BLOCKS)
def q_missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.missing_labels(*_labelled(spark, sf_dir))


@query(" SELECT table_id, cell_no, btype FROM v_typed", d.CELLS)
def q_block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.cells(spark, sf_dir).select("table_id", "cell_no", text.block_type(F.col("text")).alias("btype"))


@query(" SELECT table_id, btype FROM v_dominant", d.CELLS)
def q_dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dominant_type(d.cells(spark, sf_dir))


@query(
    ", v_place AS (SELECT table_id, rn, cn, arg_min(coalesce(btype, ''), cell_no) AS first, bool_or(coalesce(H <> 0, false)) AS headed FROM v_typed GROUP BY 1, 2, 3)"
    " SELECT p.table_id, rn FROM v_place p JOIN v_dominant USING (table_id) GROUP BY 1, 2 HAVING avg(CASE WHEN coalesce(btype = 'Nu', false) THEN (first <> 'Nu')::INT ELSE headed::INT END) > 0.5",
    d.CELLS,
)
def q_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.cells(spark, sf_dir)
    return tables.header_rows(c, tables.dominant_type(c))


@query(
    ", v_place AS (SELECT table_id, rn, cn, string_agg(text, ' ' ORDER BY cell_no) AS text FROM v_cells GROUP BY 1, 2, 3), v_width AS (SELECT table_id, max(cn) + 1 AS w FROM v_cells GROUP BY 1),"
    " v_full AS (SELECT r.table_id, r.rn, c.cn, coalesce(p.text, '') AS text FROM (SELECT DISTINCT table_id, rn FROM v_cells) r JOIN (SELECT table_id, unnest(range(w::BIGINT)) AS cn FROM v_width) c USING (table_id)"
    " LEFT JOIN v_place p ON p.table_id = r.table_id AND p.rn = r.rn AND p.cn = c.cn), v_line AS (SELECT table_id, rn, '| ' || string_agg(text, ' | ' ORDER BY cn) || ' |' || chr(10) AS line FROM v_full GROUP BY 1, 2),"
    " v_no AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY rn) AS n FROM v_line) SELECT table_id, string_agg(CASE WHEN n = 1 THEN line || '|' || repeat(' --- |', w::BIGINT) || chr(10) ELSE line END, '' ORDER BY n) AS markdown"
    " FROM v_no JOIN v_width USING (table_id) GROUP BY 1",
    d.CELLS,
)
def q_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.markdown(d.cells(spark, sf_dir))


PARTS = ", v_comp AS (SELECT page AS table_id, idx, (['table row', 'table column', 'table projected row header', 'table'])[idx % 4 + 1] AS label, x0, x1, y0 AS top, y1 AS bottom FROM v_boxes)"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in ("table row", "table column", "table projected row header", "table")]), (F.col("idx") % 4 + 1).cast("int"))
    return d.boxes(spark, sf_dir).select(F.col("page").alias("table_id"), "idx", label.alias("label"), "x0", "x1", F.col("y0").alias("top"), F.col("y1").alias("bottom"))


@query(
    PARTS + ", v_edge AS (SELECT table_id, avg(x0) FILTER (r) AS al, min(x0) FILTER (r) AS ml, avg(x1) FILTER (r) AS ar, max(x1) FILTER (r) AS mr, count(*) FILTER (r) AS nr, median(top) FILTER (c) AS mean_t, min(top) FILTER (c) AS mt,"
    " median(bottom) FILTER (c) AS ab, max(bottom) FILTER (c) AS mb, count(*) FILTER (c) AS nc FROM (SELECT *, label LIKE '%row%' AS r, label = 'table column' AS c FROM v_comp) GROUP BY 1)"
    " SELECT table_id, idx, CASE WHEN label LIKE '%row%' THEN least(x0, CASE WHEN nr > 4 THEN al ELSE ml END) ELSE x0 END::DOUBLE AS x0, CASE WHEN label LIKE '%row%' THEN greatest(x1, CASE WHEN nr > 4 THEN ar ELSE mr END) ELSE x1 END::DOUBLE AS x1,"
    " CASE WHEN label = 'table column' THEN least(top, CASE WHEN nc > 4 THEN mean_t ELSE mt END) ELSE top END::DOUBLE AS top, CASE WHEN label = 'table column' THEN greatest(bottom, CASE WHEN nc > 4 THEN ab ELSE mb END) ELSE bottom END::DOUBLE AS bottom"
    " FROM v_comp JOIN v_edge USING (table_id)",
    d.BOXES,
)
def q_edge_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.align_edges(_components(spark, sf_dir))
    return out.select("table_id", "idx", *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")))


@query(
    " SELECT table_id, cell_no, (dense_rank() OVER (PARTITION BY table_id ORDER BY rn) - 1)::INT AS rn FROM v_cells", d.CELLS
)
def q_row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.cells(spark, sf_dir).select("table_id", "cell_no", F.col("rn").alias("R"), F.col("cn").alias("x0"))
    return tables.row_segments(c).select("table_id", "cell_no", "rn")


CTC = ", v_ids AS (SELECT list_id, list((pos // 10000) % 37 % 4 ORDER BY pos) AS ids, list(((pos % 100) / 100.0)::DOUBLE ORDER BY pos) AS probs FROM v_laws GROUP BY 1)"


def _ctc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos")
    one = F.struct("pos", (F.floor(p / 10000) % 37 % 4).cast("int").alias("id"), ((p % 100) / 100.0).alias("prob"))
    rows = d.laws(spark, sf_dir).groupBy("list_id").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return rows.select("list_id", F.transform("a", lambda x: x["id"]).alias("ids"), F.transform("a", lambda x: x["prob"]).alias("probs"))


@query(
    CTC + ", v_keep AS (SELECT list_id, ids, probs, list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0 AND (i = 1 OR ids[i] <> ids[i - 1])) AS k FROM v_ids)"
    " SELECT list_id, list_aggregate(list_transform(k, lambda i: '0123456789'[ids[i]]), 'string_agg', '') AS text, round(coalesce(list_avg(list_transform(k, lambda i: probs[i])), 0), 9) AS confidence FROM v_keep WHERE len(k) > 0",
    d.LAWS,
)
def q_ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ctc(spark, sf_dir).select("list_id", decode.ctc_text(F.col("ids")).alias("text"), F.round(decode.ctc_confidence(F.col("ids"), F.col("probs")), 9).alias("confidence"))
    return out.where("text <> ''")


@query("SELECT p_partkey, p_brand AS text, length(p_brand) + 2 AS n FROM part")
def q_vocab_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    charset = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789# "
    p = d.read(spark, sf_dir, "part").select("p_partkey", decode.encode(F.col("p_brand"), charset).alias("ids"))
    return p.select("p_partkey", decode.decode(F.col("ids"), charset).alias("text"), F.size("ids").cast("long").alias("n"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.read(spark, sf_dir, "embeddings").select("vec_id", decode.argmax(F.col("embedding")).cast("long").alias("best"))


@query(
    f", v_st AS (SELECT *, coalesce(regexp_matches(text, '\\pL') AND NOT regexp_matches(text, '[^\\PL\\p{{Lu}}]'), false) AS bold, {ALIGN} AS align, x0 / 1785 * 555 + 20 AS a, x1 / 1785 * 555 + 20 AS b, 421 + (y1 / 2526 * 802 + 20 - 421) * 1.1 AS yy FROM v_blocks WHERE {NONBLANK})"
    " SELECT doc_id, page, block_no, CASE WHEN bold THEN 'bold' ELSE 'regular' END AS font, CASE WHEN align IN ('center', 'right') THEN align ELSE 'left' END AS anchor,"
    " round(CASE align WHEN 'center' THEN (a + b) / 2 WHEN 'right' THEN b ELSE a END, 6)::DOUBLE AS x, round(842 - yy, 6)::DOUBLE AS y FROM v_st",
    d.BLOCKS,
)
def q_draw_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_blocks(d.blocks(spark, sf_dir)).select("doc_id", "page", "block_no", "font", "anchor", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def q_pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' draw commands as PDF files in a new folder, and what is found in each file."""
    import uuid

    from folioframe.sources.pdf import read_pdf, write_pdf
    from folioframe.streaming import shared_folder

    top = f"{shared_folder(spark)}/pdf-{uuid.uuid4().hex}"
    write_pdf(drawn_blocks(d.blocks(spark, sf_dir)), top, folders=True)
    return read_pdf(spark, top)


@query(
    " SELECT idx, least(greatest(ceil(32 * (x1 - x0) // (y1 - y0) / 10.0) * 10, 32), 512)::INT AS rec_w, greatest((round_even(((x1 - x0) * r)::DOUBLE // 1 / 32, 0) * 32)::INT, 32) AS det_w,"
    " greatest(x0 - 4, 0) AS crop_x0, least(x1 + 4, 1500) AS crop_x1, least((x1 - x0) * 60 // (y1 - y0), 1352)::INT AS cell_w FROM (SELECT *, CASE WHEN greatest(x1 - x0, y1 - y0) > 200 THEN 200.0::DOUBLE / greatest(x1 - x0, y1 - y0) ELSE 1.0::DOUBLE END AS r FROM v_boxes)",
    d.BOXES,
)
def q_resize_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    crop = g.crop_window(g.Box.of(), F.lit(1500), F.lit(3000))
    return d.boxes(spark, sf_dir).select(
        "idx", g.recognizer_width(w, h).alias("rec_w"), g.detector_size(w, h, 200).alias("det_w"), crop[0].cast("long").alias("crop_x0"), crop[2].cast("long").alias("crop_x1"), g.grid_cell(w, h, F.lit(0))[0]
    )


@query(" SELECT idx, round(x0 / 1785 * 555 + 20, 6) AS x, round(421 + (y0 / 2526 * 802 + 20 - 421) * 1.1, 6) AS y FROM v_boxes", d.BOXES)
def q_scale_a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.scale_x(F.col("x0"), F.lit(d.PAGE_W)), g.scale_y(F.col("y0"), F.lit(d.PAGE_H))
    return d.boxes(spark, sf_dir).select("idx", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(
    " SELECT idx, x0 AS tl_x, y0 AS tl_y, x1 AS br_x, y1 AS br_y, least(greatest(x0 - 30, 0), 999)::INT AS clip_x FROM v_boxes", d.BOXES
)
def q_quad_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    q = d.boxes(spark, sf_dir).withColumn("q", g.corners(F.array(point("x1", "y1"), point("x1", "y0"), point("x0", "y1"), point("x0", "y0"))))
    at = lambda i, f, n: F.get("q", F.lit(i))[f].alias(n)
    return q.select("idx", at(0, "x", "tl_x"), at(0, "y", "tl_y"), at(2, "x", "br_x"), at(2, "y", "br_y"), g.clip_point(F.col("x0") - 30, F.col("y0"), F.lit(3000), F.lit(1000))[0].alias("clip_x"))


@query(" SELECT doc_id, block_no, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y0) AS line_no FROM v_blocks", d.BLOCKS)
def q_line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order.lines(d.blocks(spark, sf_dir).withColumnRenamed("y0", "top"), ["doc_id", "page"], 10.0).select("doc_id", "block_no", "line_no")


@query(
    " SELECT doc_id, block_no FROM v_marked WHERE regexp_matches(text, '^•+$') OR regexp_matches(text, '^[0-9]{1,2} / ?[0-9]{1,2}$') OR regexp_matches(text, '^[0-9]{1,2} of [0-9]{1,2}$') OR regexp_matches(text, '^http://[^ ]{12,}') OR length(text) = 0 OR regexp_matches(text, '\\(cid *: *[0-9]+ *\\)')",
    d.BLOCKS, d.MARKED,
)
def q_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.marked(spark, sf_dir).where(text.is_garbage(F.col("text")) | (F.length("text") == 0)).select("doc_id", "block_no")


# no SQL: Python's sort, Unicode folding, the ordered fold and streaming


@query()
def q_tolerance_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.boxes(spark, sf_dir).withColumnRenamed("y0", "top").select("page", "idx", "top", "x0")
    return reading_order.exact_order(b, ["page"], "y", 10, "idx")


@query(
    # one box a step goes behind the last one that it doesn't pass
    ", v_rank AS (SELECT page, {idx: idx, top: y0, x0: x0} AS b, row_number() OVER (PARTITION BY page ORDER BY y0, x0, idx) AS n FROM v_boxes),"
    " v_fold AS (SELECT page, n, [b] AS l FROM v_rank WHERE n = 1 UNION ALL SELECT page, n, l[:p] || [b] || l[p + 1:] FROM (SELECT f.page, r.n, l, b,"
    " coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: abs(l[i].top - b.top) >= 10 OR l[i].x0 <= b.x0)), 0) AS p"
    " FROM v_fold f JOIN v_rank r ON r.page = f.page AND r.n = f.n + 1)),"
    " v_whole AS (SELECT page, arg_max(l, n) AS l FROM v_fold GROUP BY 1), v_placed AS (SELECT page, unnest(l) AS b, unnest(range(1, len(l) + 1)) AS order_no FROM v_whole)"
    " SELECT page, b.idx AS idx, b.top AS top, b.x0 AS x0, order_no FROM v_placed",
    d.BOXES,
)
def q_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.boxes(spark, sf_dir).withColumnRenamed("y0", "top").select("page", "idx", "top", "x0")
    return reading_order.exact_order(b, ["page"], "page", 10, "idx")


@query(
    # a step takes the region at i and the first overlapping one of the four behind it (at j), and moves on or drops one of both
    ", v_far AS (SELECT page, n, i, l, list_min(list_filter(range(i + 1, least(i + 4, len(l)) + 1), lambda k:"
    " NOT (l[k].x1 < l[i].x0 OR l[i].x1 < l[k].x0 OR l[k].y1 < l[i].y0 OR l[i].y1 < l[k].y0))) AS j FROM"
    " (SELECT page, 0::BIGINT AS n, 1::BIGINT AS i, list({idx: idx, x0: x0, y0: y0, x1: x1, y1: y1, score: score} ORDER BY idx) AS l FROM v_boxes GROUP BY 1)"
    " UNION ALL SELECT page, n, i, l, list_min(list_filter(range(i + 1, least(i + 4, len(l)) + 1), lambda k:"
    " NOT (l[k].x1 < l[i].x0 OR l[i].x1 < l[k].x0 OR l[k].y1 < l[i].y0 OR l[i].y1 < l[k].y0))) AS j"
    " FROM (SELECT page, n + 1 AS n, CASE WHEN gone IS NULL THEN i + 1 ELSE i END AS i, CASE WHEN gone IS NULL THEN l ELSE l[:gone - 1] || l[gone + 1:] END AS l"
    " FROM (SELECT *, CASE WHEN j IS NULL OR shared < 0.6 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) THEN NULL"
    " WHEN a.score > 0 AND b.score > 0 AND a.score > b.score THEN j ELSE i END AS gone"
    " FROM (SELECT *, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared FROM (SELECT *, l[i] AS a, l[j] AS b FROM v_far WHERE i < len(l))))))"
    " SELECT page, r.idx AS idx, '' AS type, r.score AS score, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1 FROM (SELECT page, unnest(arg_max(l, n)) AS r FROM v_far GROUP BY 1)",
    d.BOXES,
)
def q_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.operators.cleanup import drop_overlapping

    return drop_overlapping(d.boxes(spark, sf_dir).select("page", "idx", F.lit("").alias("type"), "score", "x0", "y0", "x1", "y1"), far=5, threshold=0.6)


# the key alone doesn't know placeholders
@query(" SELECT person, coalesce(name_key, CASE WHEN name = 'N/A' THEN 'n a' END) AS name_key FROM v_keys JOIN v_people USING (person)", d.PEOPLE)
def q_name_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names, a third of them with full-width digits and letters; those of the plain names come out."""
    wide = F.translate("name", "0123456789Cu", "０１２３４５６７８９Ｃｕ")
    return d.people(spark, sf_dir).select("person", text.name_key(F.when(F.col("person") % 3 == 0, wide).otherwise(F.col("name"))).alias("name_key"))


def _json_of(note: str, entity: dict) -> tuple[str, str]:
    """The result of one part in whose places SQL puts its own: all but the entities, and an entity."""
    found = merge.fold([{"thong_tin_chung": {"ghi_chu": note}, "danh_sach_doi_tuong": [entity]}])
    dumped = lambda v: json.dumps(v, ensure_ascii=False)
    return dumped({**found, "danh_sach_doi_tuong": ["@entities"]}), dumped(found["danh_sach_doi_tuong"][0])


_NULLS = "('null', 'không rõ', 'không xác định', 'n/a', 'none')"
_WHOLE, _PERSON = _json_of("@note", {"thong_tin_ket_an": {"dieu_khoan_luat_ap_dung": ["@laws"], "ten_toi_danh": ["@crimes"]}, "bi_cao_vn": {"ho_va_ten": "@name", "ngay_sinh": "@born"}})


@query(
    # a person without a name goes to the last one before; those before the first name are lost
    f", v_parts AS (SELECT person // 75 AS doc_id, person, name, dob, paper, lower(trim(name)) NOT IN {_NULLS} AS named, lower(trim(dob)) NOT IN {_NULLS} AS known,"
    " trim(regexp_replace(lower(dob), '\\s+', ' ', 'g')) AS key, 'khoản 1 Điều ' || (person % 5 + 100) || ' BLHS' AS law FROM v_people),"
    " v_grouped AS (SELECT *, sum(named::INT) OVER (PARTITION BY doc_id ORDER BY person) AS g FROM v_parts),"
    " v_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY person) AS n, row_number() OVER (PARTITION BY doc_id, g, law ORDER BY person) AS n_law,"
    " row_number() OVER (PARTITION BY doc_id, g, known, key ORDER BY person) AS n_key FROM v_grouped),"
    " v_entities AS (SELECT doc_id, g, replace(replace(replace(replace("
    f"'{_PERSON}', '\"@laws\"', string_agg(to_json(law)::VARCHAR, ', ' ORDER BY person) FILTER (n_law = 1)),"
    " '\"@crimes\"', string_agg(CASE WHEN known THEN to_json(dob)::VARCHAR ELSE 'null' END, ', ' ORDER BY person) FILTER (n = 1 OR (known AND n_key = 1))),"
    " '\"@name\"', to_json(arg_min(name, person))::VARCHAR), '\"@born\"', coalesce(to_json(arg_min(dob, person) FILTER (known))::VARCHAR, 'null')) AS entity FROM v_ranked WHERE g > 0 GROUP BY doc_id, g)"
    f" SELECT doc_id, replace(replace('{_WHOLE}', '\"@note\"', coalesce(to_json(note)::VARCHAR, 'null')), '\"@entities\"', coalesce(entities, '')) AS result"
    f" FROM (SELECT doc_id, arg_min(paper, person) FILTER (lower(trim(paper)) NOT IN {_NULLS}) AS note FROM v_parts GROUP BY 1)"
    " LEFT JOIN (SELECT doc_id, string_agg(entity, ', ' ORDER BY g) AS entities FROM v_entities GROUP BY 1) USING (doc_id)",
    d.PEOPLE,
)
def q_merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.people(spark, sf_dir).withColumn("law", F.concat(F.lit("khoản 1 Điều "), F.col("person") % 5 + 100, F.lit(" BLHS")))
    verdict = F.struct(F.array("law").alias("dieu_khoan_luat_ap_dung"), F.array(F.col("dob")).alias("ten_toi_danh"))
    entity = F.struct(verdict.alias("thong_tin_ket_an"), F.struct(F.col("name").alias("ho_va_ten"), F.col("dob").alias("ngay_sinh")).alias("bi_cao_vn"))
    part = F.to_json(F.struct(F.struct(F.col("paper").alias("ghi_chu")).alias("thong_tin_chung"), F.array(entity).alias("danh_sach_doi_tuong")))
    return merge.merge_partials(p.select(F.floor(F.col("person") / 75).alias("doc_id"), F.col("person").alias("page"), part.alias("partial")))


def placed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cells with the columns of TABLE_CELL: a row and a column for each number."""
    c = d.cells(spark, sf_dir)
    n = F.lit(None)
    y, x = (F.col("rn") * 30).cast("double"), (F.col("cn") * 100).cast("double")
    return c.select(
        F.col("table_id").cast("string").alias("table_id"), "cell_no", "text", x.alias("x0"), (x + 90).alias("x1"), y.alias("top"), (y + 20).alias("bottom"), F.lit("table").alias("layout_type"), F.lit(1).alias("page_number"),
        F.col("rn").cast("int").alias("R"), y.alias("R_top"), (y + 25).alias("R_bott"), F.col("H"), n.cast("double").alias("H_top"), n.cast("double").alias("H_bott"), n.cast("double").alias("H_left"), n.cast("double").alias("H_right"),
        F.col("cn").alias("C"), x.alias("C_left"), (x + 95).alias("C_right"), n.cast("int").alias("SP"),
    )


@query()
def q_table_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.construct_tables(placed_cells(spark, sf_dir))


_STUBBED, _FOUND = _json_of("@note", {"thong_tin_ket_an": {"ten_toi_danh": ["@lines"]}, "bi_cao_vn": {"ho_va_ten": "@name"}})
# windows of a page and the one before it; people by their name's key, each with the line counts in the order in which they came
_EXTRACTED = (
    " , v_windows AS (SELECT doc_id, page, concat_ws(chr(10), CASE WHEN regexp_matches(before, '\\S') THEN before END, CASE WHEN regexp_matches(text, '\\S') THEN text END) AS w"
    " FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM v_pages)),"
    " v_stub AS (SELECT doc_id, page, array_to_string(l[1:2], ' ') AS name, l[-1] AS note, length(w) - length(replace(w, chr(10), '')) + 1 AS n_lines"
    " FROM (SELECT *, list_filter(regexp_split_to_array(w, '\\s+'), lambda x: x <> '') AS l FROM v_windows WHERE w <> '')),"
    " v_named AS (SELECT *, trim(regexp_replace(regexp_replace(lower(nfc_normalize(name)), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM v_stub),"
    " v_counts AS (SELECT doc_id, key, n_lines, min(page) AS first FROM v_named GROUP BY ALL),"
    " v_crimes AS (SELECT doc_id, key, string_agg('\"lines ' || n_lines || '\"', ', ' ORDER BY first) AS crimes FROM v_counts GROUP BY 1, 2),"
    " v_people_found AS (SELECT doc_id, key, min(page) AS first, arg_min(name, page) AS name FROM v_named GROUP BY 1, 2),"
    f" v_all AS (SELECT doc_id, string_agg(replace(replace('{_FOUND}', '\"@lines\"', crimes), '\"@name\"', to_json(name)::VARCHAR), ', ' ORDER BY first) AS entities"
    " FROM v_people_found JOIN v_crimes USING (doc_id, key) GROUP BY 1),"
    f" v_notes AS (SELECT doc_id, arg_min(note, page) FILTER (lower(trim(note)) NOT IN {_NULLS}) AS note FROM v_stub GROUP BY 1)"
    " SELECT {id} AS doc_id, n_pages::INT AS n_pages, 0 AS skipped,"
    f" replace(replace('{_STUBBED}', '\"@note\"', coalesce(to_json(note)::VARCHAR, 'null')), '\"@entities\"', coalesce(entities, '')) AS result"
    " FROM (SELECT doc_id, count(*) AS n_pages FROM v_pages GROUP BY 1) LEFT JOIN v_all USING (doc_id) LEFT JOIN v_notes USING (doc_id)"
)


@query(_EXTRACTED.replace("{id}", "doc_id"), d.PAGES)
def q_extract_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.streaming import extract_batch, stub_extractor

    return extract_batch(d.pages(spark, sf_dir), stub_extractor)


@query(_EXTRACTED.replace("{id}", "doc_id::VARCHAR"), d.PAGES)
def q_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a stream of whole documents that a producer hands out page by page; equals q_extract_batch."""
    import uuid

    from folioframe.streaming import documents_stream, extract_stream, land_documents, pages_of, shared_folder, stub_extractor

    top = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    land_documents(d.pages(spark, sf_dir), f"{top}/landed")
    merged = extract_stream(pages_of(documents_stream(spark, f"{top}/landed")), stub_extractor)
    run = merged.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(merged.schema).parquet(f"{top}/rows")
