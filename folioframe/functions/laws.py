"""Legal clauses: parsing, display and list normalisation, all by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import bound, collapse, compat, firsts, fold_quotes, generic_key, is_null_like

# The clause pattern (point, clause, article) and the code's names.
CLAUSE = r"(?iu)(?:(?:điểm|diem)\s+([a-zđ]))?\s*(?:(?:khoản|khoan)\s+(\d+[a-z]?))?\s*(?:điều|dieu)\s+(\d+[a-z]?)"
CODE = r"(?iu)b(?:(?<![\p{L}\p{N}_]b)lhs(?![\p{L}\p{N}_])|ộ\s+luật\s+hình\s+sự)"
CODE_LONG = r"(?iu)(?<![\p{L}\p{N}_])bộ\s+luật\s+hình\s+sự(?![\p{L}\p{N}_])"


def law_code(c: Column) -> Column:
    return F.when(c.rlike(CODE), "BLHS")


def clean_law(c: Column) -> Column:
    return F.when(c.isNotNull(), collapse(F.btrim(F.regexp_replace(compat(fold_quotes(c)), CODE_LONG, "BLHS"), F.lit(" .;,"))))


def clause_display(code: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    """A point is shown only with its clause; nulls leave no gap."""
    return F.concat_ws(
        " ",
        F.when(diem.isNotNull() & khoan.isNotNull(), F.concat(F.lit("điểm "), F.lower(diem))),
        F.when(khoan.isNotNull(), F.concat(F.lit("khoản "), khoan)),
        F.concat(F.lit("Điều "), dieu),
        code,
    )


def parse_clauses(c: Column) -> Column:
    """array<struct<code,dieu,khoan,diem,specific,display,raw>>; an item without a clause is one raw struct.

    The text is cleaned once, its code found once, and a clause's groups come from one replacement inside it."""
    none = F.lit(None).cast("string")

    def clause(code: Column) -> Callable[[Column], Column]:
        def of(m: Column) -> Column:
            return bound(F.split(F.regexp_replace(m, CLAUSE, "$1\x01$2\x01$3"), "\x01", -1), groups)

        def groups(g: Column) -> Column:
            diem, khoan, dieu = (F.nullif(g[i], F.lit("")) for i in range(3))
            return F.struct(
                code.alias("code"), F.lower(dieu).alias("dieu"), F.lower(khoan).alias("khoan"), F.lower(diem).alias("diem"), (khoan.isNotNull() | diem.isNotNull()).alias("specific"),
                clause_display(code, dieu, khoan, diem).alias("display"), none.alias("raw"),
            )

        return of

    def of(x: Column) -> Column:
        raw = F.struct(none.alias("code"), none.alias("dieu"), none.alias("khoan"), none.alias("diem"), F.lit(False).alias("specific"), x["text"].alias("display"), generic_key(x["text"]).alias("raw"))
        return F.when(F.size(x["found"]) > 0, F.transform(x["found"], clause(x["code"]))).otherwise(F.array(raw))

    def parts(text: Column) -> Column:
        return F.struct(text.alias("text"), law_code(text).alias("code"), F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)).alias("found"))

    return bound(clean_law(c), lambda text: bound(parts(text), of))


def keyed_clauses(c: Column) -> Column:
    """The clauses of one item as what normal_list() compares and shows; null for a null-like item."""
    key = lambda x, *fields: F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), x[f]), F.lit("")) for f in fields))

    def keyed(x: Column) -> Column:
        return F.struct(F.when(x["raw"].isNull(), key(x, "code", "dieu")).alias("article"), x["specific"].alias("specific"), key(x, "code", "dieu", "khoan", "diem", "raw").alias("key"), x["display"].alias("display"))

    return F.when(~is_null_like(c), F.transform(parse_clauses(c), keyed))


def normal_list(clauses: Column) -> Column:
    """Displays of the clauses of a list's items, as normalize_clauses() gives them.

    Clauses are sorted by article, the general one first: repeats stand next to each other then, and what follows a general one tells whether it stays."""

    def kept(items: Column) -> Column:
        return F.filter(items, lambda x, i: x["article"].isNull() | x["specific"] | ~F.get(items, i + 1)["article"].eqNullSafe(x["article"]))

    placed = F.array_sort(F.transform(F.flatten(F.filter(clauses, lambda v: v.isNotNull())), lambda x, i: F.struct(x["article"], x["specific"], x["key"], i.alias("at"), x["display"])))
    return F.transform(F.array_sort(F.transform(bound(firsts(placed), kept), lambda x: F.struct(x["at"], x["display"]))), lambda x: x["display"])


def normalize_clauses(values: Column) -> Column:
    """Displays of a list's clauses: general ones go where their article has a specific one, repeats go, order stays."""
    return normal_list(F.transform(values, keyed_clauses))


#: So many texts at most, of 100 characters on average if all were as long as the longest, are parsed apart and sent to all tasks.
TEXTS = 100_000


def with_clauses(df: DataFrame, item: str, texts: int = TEXTS) -> DataFrame:
    """df and keyed_clauses(item) as column clauses. Laws are cited in few ways: a text that stands in many rows is parsed once,
    where the texts, counted first, are few enough to be sent to all tasks; else each row's text is."""
    n, longest = df.agg(F.approx_count_distinct(item), F.coalesce(F.max(F.length(item)), F.lit(0))).first()
    if n > texts or n * longest > 100 * texts:
        return df.withColumn("clauses", keyed_clauses(F.col(item)))
    each = df.select(item).distinct().withColumn("clauses", keyed_clauses(F.col(item)))
    return df.join(F.broadcast(each), item, "left")
