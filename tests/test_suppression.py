"""Suppression in rounds against the greedy order."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import layout
from folioframe.operators.suppression import suppress_many

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("threshold", "plus", "strict"), [(0.45, 1, False), (0.2, 0, True)])
def test_rounds_give_the_rows_of_the_queries(spark, threshold, plus, strict):
    from folioframe.plans import queries

    boxes = queries._group(spark, SF)
    want = layout.suppress(boxes, threshold, plus=plus, strict=strict)
    for cell in (None, 90.0):
        got = suppress_many(boxes, threshold, plus, strict, cell=cell)
        assert rows(got.select(want.columns)) == rows(want)
    assert suppress_many(boxes.limit(0), threshold, plus, strict).count() == 0


def greedy(x, order, threshold):
    """The greedy order in NumPy."""
    kept, live = [], np.ones(len(x), bool)
    area = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    for i in order:
        if live[i]:
            kept.append(int(i))
            w = np.maximum(0, np.minimum(x[:, 2], x[i, 2]) - np.maximum(x[:, 0], x[i, 0]))
            h = np.maximum(0, np.minimum(x[:, 3], x[i, 3]) - np.maximum(x[:, 1], x[i, 1]))
            live &= ~(w * h > threshold * (area + area[i] - w * h))
    return kept


def test_one_page_of_very_many_boxes(spark):
    """One group, a third of it copies of one box, with sizes from tiny to a whole page."""
    rng = np.random.default_rng(3)
    n = 30_000
    side = rng.choice([20.0, 60.0, 150.0], (n, 2)) * rng.uniform(0.5, 1.5, (n, 2))
    corner = rng.uniform(0, 9000, (n, 2))
    x = np.hstack([corner, corner + side]).round()
    x[: n // 3] = x[0]
    x[-1] = (0, 0, 9200, 9200)
    score = rng.permutation(n)
    df = spark.createDataFrame([(1, 0, int(s), i, *map(float, b)) for i, (s, b) in enumerate(zip(score, x, strict=True))], "page int, cls int, score long, idx long, x0 double, y0 double, x1 double, y1 double").repartition(4)
    began = time.time()
    got = suppress_many(df, 0.4)
    assert sorted(r.idx for r in got.select("idx").collect()) == sorted(greedy(x, np.argsort(-score), 0.4))
    assert time.time() - began < 300
    with pytest.raises(ValueError, match="threshold"):
        suppress_many(df, 0.0, strict=True)
    assert got.where(F.col("page") != 1).count() == 0
