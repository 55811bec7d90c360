"""Pages, boxes, clauses and people derived from the driver's tables by integer arithmetic, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_W, PAGE_H = 1785, 2526
LABELS = ("header", "footer", "text", "table", "figure", "title", "reference", "equation", "figure caption", "table caption")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n = F.col("pos")
    x0 = (F.col("doc_id") * 37 + (n + 1) * 91) % 900
    d = d.select("doc_id", (_div(n, 40) + 1).alias("page"), (n + 1).cast("long").alias("block_no"), "text", x0.alias("x0"), (60 + (n % 40) * 50).cast("long").alias("y0"))
    return d.withColumn("x1", F.least(F.col("x0") + 20 + F.length("text") * 7, F.lit(1785)).cast("long")).withColumn("y1", F.col("y0") + 30)


BLOCKS = """
v_blocks AS (SELECT doc_id, page, block_no, text, x0, y0, least(x0 + 20 + length(text) * 7, 1785)::BIGINT AS x1, y0 + 30 AS y1 FROM (
  SELECT doc_id, ((n - 1) // 40 + 1)::BIGINT AS page, n::BIGINT AS block_no, l[n] AS text, ((doc_id * 37 + n * 91) % 900)::BIGINT AS x0,
    (60 + ((n - 1) % 40) * 50)::BIGINT AS y0
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


MARKS = ("•••", "3 / 12", "4 of 12", "http://example.org/some/path", "x (cid:12)", "")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks, some with texts that are garbage."""
    at = (F.col("doc_id") + F.col("block_no")) % 17
    return blocks(spark, sf_dir).withColumn("text", F.coalesce(F.get(F.array(*map(F.lit, MARKS)), at.cast("int")), F.col("text")))


MARKED = "v_marked AS (SELECT doc_id, block_no, coalesce(([" + ", ".join(f"'{x}'" for x in MARKS) + "])[(doc_id + block_no) % 17 + 1], text) AS text FROM v_blocks)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    p = p.select(_div(k, 50).alias("page"), k.alias("idx"), ((k * 37) % 1500).alias("x0"), ((k * 53) % 2200).alias("y0"), "p_size", k, ((k * 7919) % 1000).alias("score"), (k % 10).alias("cls"))
    p = p.withColumn("x1", F.col("x0") + 40 + F.col("p_size") * 6).withColumn("y1", F.col("y0") + 20 + (F.col("p_partkey") * 7) % 60)
    return p.select("page", "idx", "x0", "y0", "x1", "y1", "score", "cls")


BOXES = """
v_boxes AS (SELECT page, idx, x0, y0, x0 + 40 + p_size * 6 AS x1, y0 + 20 + (idx * 7) % 60 AS y1, score, cls FROM (
  SELECT p_partkey // 50 AS page, p_partkey AS idx, (p_partkey * 37) % 1500 AS x0, (p_partkey * 53) % 2200 AS y0, p_size,
    (p_partkey * 7919) % 1000 AS score, p_partkey % 10 AS cls FROM part))"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes, those of every third page far to the right, so that they leave its regions without any."""
    away = F.when(F.col("page") % 3 == 0, 9000).otherwise(0)
    return boxes(spark, sf_dir).withColumns({"x0": F.col("x0") + away, "x1": F.col("x1") + away})


SPARSE = "v_sparse AS (SELECT * REPLACE (x0 + CASE page % 3 WHEN 0 THEN 9000 ELSE 0 END AS x0, x1 + CASE page % 3 WHEN 0 THEN 9000 ELSE 0 END AS x1) FROM v_boxes)"


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select("page", *(F.col(c).alias(f"{p}{c}") for c in df.columns if c != "page"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("idx") % 10 + 1).cast("int"))
    zero = F.lit(0)
    return b.select(
        "page", F.col("idx").alias("r_idx"), F.greatest(F.col("x0") - 200, zero).alias("r_x0"), F.greatest(F.col("y0") - 100, zero).alias("r_y0"), (F.col("x1") + 200).alias("r_x1"),
        (F.col("y1") + 100).alias("r_y1"), F.col("score").alias("r_score"), kind.alias("r_type"),
    )


REGIONS = (
    """
v_regions AS (SELECT page, idx AS r_idx, greatest(x0 - 200, 0) AS r_x0, greatest(y0 - 100, 0) AS r_y0, x1 + 200 AS r_x1, y1 + 100 AS r_y1, score AS r_score,
  (["""
    + ", ".join(f"'{x}'" for x in LABELS)
    + """])[idx % 10 + 1] AS r_type FROM v_boxes)"""
)


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list_id, pos, item): each item one clause, some without point or clause."""
    li = read(spark, sf_dir, "lineitem")
    point = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("điểm "), F.char(97 + F.col("l_linenumber") % 5), F.lit(" "))).otherwise("")
    clause = F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("khoản "), (F.col("l_linenumber") % 3 + 1).cast("string"), F.lit(" "))).otherwise("")
    code = F.element_at(F.array(F.lit(" BLHS"), F.lit(" Bộ luật Hình sự"), F.lit("")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    item = F.concat(point, clause, F.lit("Điều "), (F.col("l_partkey") % 4 + 100).cast("string"), code)
    return li.select(F.col("l_orderkey").alias("list_id"), (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey")).alias("pos"), item.alias("item"))


LAWS = """
v_laws AS (SELECT l_orderkey AS list_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS pos,
  CASE WHEN l_partkey % 3 = 0 THEN 'điểm ' || chr((97 + l_linenumber % 5)::INT) || ' ' ELSE '' END
  || CASE WHEN l_partkey % 4 <> 0 THEN 'khoản ' || (l_linenumber % 3 + 1) || ' ' ELSE '' END
  || 'Điều ' || (l_partkey % 4 + 100) || ([' BLHS', ' Bộ luật Hình sự', ''])[l_suppkey % 3 + 1] AS item FROM lineitem),
v_clauses AS (SELECT list_id, pos, item, regexp_matches(item, '(?i)\\bblhs\\b|bộ\\s+luật\\s+hình\\s+sự') AS coded,
  nullif(regexp_extract(item, '(?i)điểm ([a-zđ])', 1), '') AS diem, nullif(regexp_extract(item, '(?i)khoản (\\d+[a-z]?)', 1), '') AS khoan,
  regexp_extract(item, '(?i)điều (\\d+[a-z]?)', 1) AS dieu FROM v_laws),
v_shown AS (SELECT *, diem IS NOT NULL OR khoan IS NOT NULL AS specific, CASE WHEN coded THEN 'BLHS' END AS code,
  concat_ws(' ', CASE WHEN diem IS NOT NULL AND khoan IS NOT NULL THEN 'điểm ' || diem END, CASE WHEN khoan IS NOT NULL THEN 'khoản ' || khoan END,
    'Điều ' || dieu, CASE WHEN coded THEN 'BLHS' END) AS display FROM v_clauses)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


PAGES = "v_pages AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)"


def partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, header): a header value that is a text, null or a placeholder."""
    e = read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 1, "N/A").when(F.col("event_id") % 5 == 2, " Không rõ ")
    v = v.when(F.col("event_id") % 5 == 3, "").otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("event_id") % 7))
    order = F.struct("ts", "event_id")
    return e.select(F.col("user_id").alias("doc_id"), order.alias("page"), "event_id", v.alias("header"))


PARTIALS = """
v_partials AS (SELECT user_id AS doc_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN ' Không rõ ' WHEN 3 THEN ''
  ELSE event_type || ' ' || event_id % 7 END AS header FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed cells: table, row and column numbers, place in the list, text and a header number."""
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey")
    text = F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).when(F.col("l_partkey") % 3 == 1, F.col("l_quantity").cast("int").cast("string"))
    text = text.otherwise(F.concat(F.lit("2020-"), F.col("l_linenumber").cast("string")))
    head = F.when(F.col("l_suppkey") % 2 == 0, (F.col("l_linenumber") % 3).cast("int"))
    return li.select(F.col("l_orderkey").alias("table_id"), n.alias("cell_no"), F.col("l_linenumber").alias("rn"), (F.col("l_suppkey") % 4).cast("int").alias("cn"), text.alias("text"), head.alias("H"))


CELLS = """
v_cells AS (SELECT l_orderkey AS table_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS cell_no, l_linenumber AS rn, l_suppkey % 4 AS cn,
  CASE l_partkey % 3 WHEN 0 THEN l_returnflag WHEN 1 THEN (l_quantity::INT)::VARCHAR ELSE '2020-' || l_linenumber END AS text,
  CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber % 3 END AS H FROM lineitem),
v_typed AS (SELECT *, CASE WHEN regexp_matches(text, '^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$') THEN 'Dt' WHEN regexp_matches(text, '^[0-9]{1,2}[月-][0-9]{1,2}日*$') THEN 'Dt'
  WHEN regexp_matches(text, '^[0-9.,+%/ -]+$') THEN 'Nu' WHEN regexp_matches(text, '^[0-9A-Z/\\._~-]+$') THEN 'Ca'
  WHEN regexp_matches(text, '^[A-Z]*[a-z'' -]+$') THEN 'En' WHEN length(text) = 1 THEN 'Sg' END AS btype FROM v_cells),
v_dominant AS (SELECT table_id, btype FROM (SELECT table_id, btype, row_number() OVER (PARTITION BY table_id ORDER BY count(*) DESC, min(cell_no)) AS r
  FROM v_typed GROUP BY table_id, btype) WHERE r = 1)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, name, dob, paper) with variants of case, quotes and punctuation."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 4 == 0, F.upper("c_name")).when(k % 4 == 1, F.concat(F.lit("  "), F.translate("c_name", "#", "’"), F.lit(". "))).when(k % 4 == 2, F.lit("N/A"))
    name = name.otherwise(F.concat(F.col("c_name"), F.lit("_x"), F.lit(" ‘"), k % 3, F.lit("`")))
    dob = F.concat((k % 28 + 1).cast("string"), F.element_at(F.array(F.lit("/"), F.lit(" - "), F.lit(".")), (k % 3 + 1).cast("int")), (k % 12 + 1).cast("string"))
    dob = F.concat(dob, F.element_at(F.array(F.lit("/"), F.lit(" - "), F.lit(".")), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, F.lpad((k % 100).cast("string"), 2, "0")).otherwise((F.lit(1900) + k % 100).cast("string")))
    dob = F.when(k % 11 == 0, F.lit("Năm  1990")).when(k % 13 == 0, F.lit("null")).otherwise(F.concat(F.lit("born "), dob))
    paper = F.when(k % 7 == 0, F.lit("---")).when(k % 7 == 1, F.lit("Không rõ")).otherwise(F.concat(F.lit("AB-"), k.cast("string"), F.lit(" _"), k % 5))
    return c.select(k.alias("person"), F.col("c_nationkey").alias("nation"), name.alias("name"), dob.alias("dob"), paper.alias("paper"))


PEOPLE = """
v_people AS (SELECT c_custkey AS person, c_nationkey AS nation, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN '  ' || replace(c_name, '#', '’') || '. ' WHEN 2 THEN 'N/A'
  ELSE c_name || '_x' || ' ‘' || c_custkey % 3 || '`' END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN 'Năm  1990' WHEN c_custkey % 13 = 0 THEN 'null' ELSE 'born ' || (c_custkey % 28 + 1) || s || (c_custkey % 12 + 1) || s
    || CASE WHEN c_custkey % 2 = 0 THEN lpad((c_custkey % 100)::VARCHAR, 2, '0') ELSE (1900 + c_custkey % 100)::VARCHAR END END AS dob,
  CASE c_custkey % 7 WHEN 0 THEN '---' WHEN 1 THEN 'Không rõ' ELSE 'AB-' || c_custkey || ' _' || c_custkey % 5 END AS paper
  FROM (SELECT *, (['/', ' - ', '.'])[c_custkey % 3 + 1] AS s FROM customer)),
v_keys AS (SELECT person, nation, CASE WHEN lower(trim(name)) NOT IN ('null', 'không rõ', 'không xác định', 'n/a', 'none') THEN
  trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(name, '‘’‚ʼ`´', ''''''''''''''), '[^\\pL\\pN_\\s]', ' ', 'g')), '\\s+', ' ', 'g'), '^ | $', '', 'g')) END AS name_key,
  CASE WHEN lower(trim(dob)) IN ('null', 'không rõ', 'không xác định', 'n/a', 'none') THEN NULL WHEN regexp_matches(dob, '\\d{1,2}\\s*[/.-]\\s*\\d{1,2}\\s*[/.-]\\s*\\d{2,4}') THEN
    lpad(regexp_extract(dob, '(\\d{1,2})\\s*[/.-]\\s*(\\d{1,2})\\s*[/.-]\\s*(\\d{2,4})', 1), 2, '0') || '/' || lpad(regexp_extract(dob, '(\\d{1,2})\\s*[/.-]\\s*(\\d{1,2})\\s*[/.-]\\s*(\\d{2,4})', 2), 2, '0') || '/'
    || CASE WHEN length(regexp_extract(dob, '(\\d{1,2})\\s*[/.-]\\s*(\\d{1,2})\\s*[/.-]\\s*(\\d{2,4})', 3)) = 2 THEN '19' ELSE '' END || regexp_extract(dob, '(\\d{1,2})\\s*[/.-]\\s*(\\d{1,2})\\s*[/.-]\\s*(\\d{2,4})', 3)
    ELSE trim(regexp_replace(lower(dob), '\\s+', ' ', 'g')) END AS dob_key,
  CASE WHEN lower(trim(paper)) NOT IN ('null', 'không rõ', 'không xác định', 'n/a', 'none') THEN nullif(regexp_replace(lower(paper), '[^\\pL\\pN_]+', '', 'g'), '') END AS id_key FROM v_people)"""
