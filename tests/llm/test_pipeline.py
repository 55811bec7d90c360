"""The pipeline against a brute-force version, and the registered queries."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import quality
from folioframe.llm.queries import ORACLES, QUERIES
from tests.llm.test_llm import EMPTY, brute_components, brute_spans, edited, graded, shingle_set, vocabulary_text, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(20)
    rows, labels = graded(rng, 500)
    items = [(i, vocabulary_text(rng, 40, 900)) for i in range(6)]
    n = 1000
    for i in range(30):
        rows.append((n + i, edited(rng, rows[i][1], i % 3) if rows[i][1] else "", "en", "s1", 5))
    for i, (_, t) in enumerate(items):
        rows.append((1100 + i, f"{vocabulary_text(rng, 80)} {t} {vocabulary_text(rng, 80)}", "en", "s2", 5))
    rows += [(1200, 'x token = "0123456789abcdef" ' + vocabulary_text(rng, 60), "en", "s3", 9), (1201, None, None, None, None), (1202, "", "en", "s1", 0)]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, EMPTY).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = {r.doc_id: r.rejected for r in quality.classify(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    live = {i for i in rows if not model[i]}
    component = {i: c for i, _, c in brute_components([(i, rows[i].text) for i in sorted(live)], 5, 80, 100)}
    live = {i for i in live if component[i] == i}
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    live = {i for i in live if not any(100 * len(q & shingle_set(rows[i].text, 5)) >= 80 * len(q) for q in items)}

    def masked(t):
        out, at = "", 0
        for a, _, e, _ in brute_spans(t):
            if a > at or not out:
                out += t[at:a] + "[SECRET]"
            at = max(at, e)
        return out + (t or "")[at:]

    out = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in out} <= live and len(out) == len({r.doc_id for r in out})
    assert all(r.text == masked(rows[r.doc_id].text) and r["size"] == len(words(r.text)) and r.copies in (1, 2) for r in out)
    total = sum(len(words(masked(rows[i].text))) for i in live)
    assert abs(sum(r["size"] * r.copies for r in out) - 1.5 * total) <= 300 * len({r.source for r in out})


def test_each_stage_returns_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), tables).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import collections

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = c.execute(ORACLES[name])
    at = [[x[0] for x in cur.description].index(x) for x in cols]
    assert collections.Counter(tuple(r[i] for i in at) for r in cur.fetchall()) == collections.Counter(tuple(r) for r in df.select(cols).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_cover_the_table(spark, name):
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    whole = {"op6_quality_classifier", "op7_mixing_sources", "op10_lm_scoring"}
    assert df.count() == n if name in whole else df.limit(1).count() == 1


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
