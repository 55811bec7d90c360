"""The operators that work on ordered groups, as table functions for SQL.

    table_functions.register(spark)
    SELECT * FROM merge_partials(TABLE(partials) PARTITION BY doc_id ORDER BY page)
    SELECT * FROM construct_table(TABLE(SELECT * FROM typed_cells) PARTITION BY table_id, style => 'markdown')
    SELECT * FROM suppress(TABLE(boxes) PARTITION BY (page, cls) ORDER BY (score DESC, idx DESC), threshold => 0.45, plus => 1)

Each tells its result's columns from its argument's, so any table that has the
columns asked for will do. Spark partitions and sorts; a function sees one
partition's rows in order, and holds no more of them than the operator needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folioframe.operators import merge, tables
from folioframe.schema import EXTRACTION


def _table(argument: AnalyzeArgument, *columns: str) -> T.StructType:
    """The table argument's columns, among which these must be."""
    if not argument.isTable:
        raise ValueError("give the rows as TABLE(...)")
    if missing := [c for c in columns if c not in argument.dataType.names]:
        raise ValueError(f"the table has no {', '.join(missing)}")
    return argument.dataType


def _constant(argument: AnalyzeArgument | None, default, name: str):
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class MergePartials:
    """(doc_id, result) of (doc_id, page, partial JSON), PARTITION BY doc_id ORDER BY page: holds the merged record, not the parts."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        kind = _table(rows, "doc_id", "page", "partial")
        return AnalyzeResult(T.StructType([T.StructField("doc_id", kind["doc_id"].dataType), T.StructField("result", T.StringType())]))

    def __init__(self):
        self._doc, self._fold, self._any = None, merge.Fold(), False

    def eval(self, row: Row) -> None:
        self._doc, self._any = row["doc_id"], True
        try:
            part = json.loads(row["partial"])
        except (TypeError, ValueError):
            return
        if isinstance(part, dict):
            self._fold.add(merge.complete(part, EXTRACTION))

    def terminate(self) -> Iterator[tuple]:
        if self._any:
            yield self._doc, json.dumps(self._fold.result(), ensure_ascii=False)


class ConstructTable:
    """(table_id, body) of cells with the columns of tables.typed_cells(), PARTITION BY table_id: holds one table."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, style: AnalyzeArgument | None = None, english: AnalyzeArgument | None = None) -> AnalyzeResult:
        _table(rows, "table_id", "cell_no", "text", "btype", "caption", "R", "C", "H", "SP")
        if _constant(style, "markdown", "style") not in ("markdown", "sentences"):
            raise ValueError("style is markdown or sentences")
        _constant(english, False, "english")
        return AnalyzeResult(T.StructType([T.StructField("table_id", T.StringType()), T.StructField("body", T.StringType())]))

    def __init__(self):
        self._rows, self._options = [], ("markdown", False)

    def eval(self, row: Row, style: str = "markdown", english: bool = False) -> None:
        self._rows.append(row.asDict())
        self._options = (style, english)

    def terminate(self) -> Iterator[tuple]:
        if self._rows and (body := tables.table_body(self._rows, *self._options)) is not None:
            yield str(self._rows[0]["table_id"]), body


class Suppress:
    """The rows that greedy suppression keeps, PARTITION BY what is apart, ORDER BY score DESC (and what breaks ties): holds the kept boxes.

    A box goes if its intersection over union with a kept one exceeds the threshold (strict => true: or equals it); plus widens
    the intersection, as some detectors do."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, threshold: AnalyzeArgument, plus: AnalyzeArgument | None = None, strict: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = _table(rows, "x0", "y0", "x1", "y1")
        _constant(threshold, None, "threshold"), _constant(plus, 0, "plus"), _constant(strict, False, "strict")
        return AnalyzeResult(T.StructType(list(kind)))

    def __init__(self):
        self._kept: list[tuple] = []

    def eval(self, row: Row, threshold, plus=0, strict: bool = False) -> Iterator[Row]:
        threshold, plus = float(threshold), float(plus)
        x0, y0, x1, y1 = box = tuple(float(row[c]) for c in ("x0", "y0", "x1", "y1"))
        area = (x1 - x0) * (y1 - y0)
        for a0, b0, a1, b1 in self._kept:
            both = max(0.0, min(x1, a1) - max(x0, a0) + plus) * max(0.0, min(y1, b1) - max(y0, b0) + plus)
            whole = area + (a1 - a0) * (b1 - b0) - both
            if whole and (both / whole > threshold or (strict and both / whole == threshold)):
                return
        self._kept.append(box)
        yield row


FUNCTIONS = {"merge_partials": MergePartials, "construct_table": ConstructTable, "suppress": Suppress}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
