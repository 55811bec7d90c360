"""The table functions in SQL against the DataFrame operators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioframe import table_functions
from folioframe.operators import layout, merge, tables
from folioframe.plans import derived as d
from folioframe.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    table_functions.register(spark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_partials(spark):
    note = lambda i, p: json.dumps({"thong_tin_chung": {"ghi_chu": f"n{p}" if p > 1 else None}, "danh_sach_doi_tuong": [{"bi_cao_vn": {"ho_va_ten": f"N{(i + p) % 3}"}, "thong_tin_ket_an": {"ten_toi_danh": [f"c{p}"]}}]})
    parts = [(i, p, note(i, p) if p != 4 else "not json") for i in range(5) for p in (3, 1, 4, 2, 5)] + [(9, 1, None), (10, 1, "[]")]
    df = spark.createDataFrame(parts, "doc_id long, page int, partial string").repartition(4).withColumn("more", F.lit("x"))
    df.createOrReplaceTempView("partials")
    got = spark.sql("SELECT * FROM merge_partials(TABLE(partials) PARTITION BY doc_id ORDER BY page)")
    assert dict(got.dtypes) == {"doc_id": "bigint", "result": "string"}
    assert rows(got) == rows(merge.merge_partials(df.drop("more"))) and got.count() == 7
    with pytest.raises(Exception, match="the table has no partial"):
        spark.sql("SELECT * FROM merge_partials(TABLE(SELECT 1 AS doc_id, 2 AS page) PARTITION BY doc_id)")


@pytest.mark.parametrize("style", ["markdown", "sentences"])
def test_construct_table(spark, style):
    cells = queries.placed_cells(spark, SF).where("table_id % 40 = 1")
    tables.typed_cells(cells).createOrReplaceTempView("typed_cells")
    got = spark.sql(f"SELECT * FROM construct_table(TABLE(typed_cells) PARTITION BY table_id, style => '{style}')")
    assert rows(got) == rows(tables.construct_tables(cells, style)) and got.count() > 10


@pytest.mark.parametrize(("threshold", "plus", "strict"), [(0.45, 1, False), (0.2, 0, True)])
def test_suppress(spark, threshold, plus, strict):
    boxes = queries._group(spark, SF)
    boxes.createOrReplaceTempView("boxes")
    got = spark.sql(f"SELECT page, cls, idx FROM suppress(TABLE(boxes) PARTITION BY (page, cls) ORDER BY (score DESC, idx DESC), threshold => {threshold}, plus => {plus}, strict => {str(strict).lower()})")
    want = layout.suppress(boxes, threshold, plus=plus, strict=strict).select("page", "cls", "idx")
    assert rows(got) == rows(want) and 0 < got.count() < boxes.count()
    assert d.boxes(spark, SF).count() == boxes.count()
