"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import decode, laws, style, text
from folioframe.functions import geometry as g


def one(spark, expr, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, want",
    [("3/4/1990", "03/04/1990"), ("sinh ngày 03 - 12 - 85", "03/12/1985"), ("31.02.2001", "31/02/2001"), ("1/2/199", "01/02/199"), ("Năm  1990", "năm 1990"), ("N/A", None), (None, None), ("", "")],
)
def test_date_key(spark, given, want):
    assert one(spark, text.date_key(F.col("v")), v=given) == want


@pytest.mark.parametrize("given, want", [("012-345 678", "012345678"), ("AB_12", "ab_12"), ("---", None), ("null", None), ("", None)])
def test_id_key(spark, given, want):
    assert one(spark, text.id_key(F.col("v")), v=given) == want


@pytest.mark.parametrize("given, want", [("Nguyễn Văn A.", "nguyễn văn a"), ("Y’ĐĂM", "y đăm"), (" a_b  C ", "a_b c")])
def test_name_key(spark, given, want):
    assert one(spark, text.name_key(F.col("v")), v=given) == want


def test_exact_name_key_folds_what_spark_does_not(spark):
    assert one(spark, text.name_key(F.col("v")), v="ＳＴＲＡＳＳＥ ß") == "strasse ss"


@pytest.mark.parametrize("given, want", [(None, True), ("null", True), (" N/A ", True), ("Không rõ", True), ("NONE", True), ("", False), ("unknown", False), ("[]", False)])
def test_null_like(spark, given, want):
    assert one(spark, text.is_null_like(F.col("v")), v=given) is want


CLAUSES = [
    (["Điều 51 BLHS", "khoản 1 Điều 51 Bộ luật Hình sự"], ["khoản 1 Điều 51 BLHS"]),
    (["điểm s khoản 1 Điều 51", "Điều 51 BLHS"], ["điểm s khoản 1 Điều 51", "Điều 51 BLHS"]),
    (["điểm a, b khoản 1 Điều 51 BLHS"], ["khoản 1 Điều 51 BLHS"]),
    (["điểm c Điều 9 BLHS"], ["Điều 9 BLHS"]),
    (["Điều 173, Điều 174 BLHS"], ["Điều 173 BLHS", "Điều 174 BLHS"]),
    (["Luật Đất đai 2013."], ["Luật Đất đai 2013"]),
    ([None, "KHOẢN 2 ĐIỀU 8"], ["khoản 2 Điều 8"]),
    ([], []),
]


@pytest.mark.parametrize("given, want", CLAUSES)
def test_clauses(spark, given, want):
    from folioframe.operators.merge import merge_laws

    assert one(spark, laws.normalize_clauses(F.col("v")), v=given) == want
    assert merge_laws(given) == want


def test_clauses_of_rows_are_those_of_lists(spark):
    """Each text is parsed once or each row's is: the same clauses; and one long list takes no time that grows with its square."""
    many = [f"{'khoản 1 ' if i % 3 else ''}Điều {i // 2} BLHS" for i in range(6_000)] + ["Điều 7 BLHS", "văn bản khác", "VĂN BẢN  KHÁC", None, "N/A", ""]
    rows = [(0, i, x) for i, x in enumerate(many)] + [(n + 1, i, x) for n, (given, _) in enumerate(CLAUSES) for i, x in enumerate(given)]
    df = spark.createDataFrame(rows, "list int, pos int, item string")
    from folioframe.operators.merge import merge_laws

    want = {0: merge_laws(many)} | {n + 1: w for n, (given, w) in enumerate(CLAUSES) if given}
    for texts in (0, 100_000):
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("pos", "clauses"))), lambda x: x["clauses"])
        got = laws.with_clauses(df, "item", texts).groupBy("list").agg(sorted_.alias("c")).select("list", laws.normal_list(F.col("c")).alias("r"))
        assert {r.list: r.r for r in got.collect()} == want



@pytest.mark.parametrize(
    "raw, want",
    [('<think>x</think>{"1":"a"}', {"1": "a"}), ('```json\n{"1":"a"}\n```', {"1": "a"}), ('Here: {"1":"a"}', {"1": "a"}), ('{"1":"a"} done', None), (None, None), ("", None)],
)
def test_reply(spark, raw, want):
    assert one(spark, text.parse_reply(F.col("v")), v=raw) == want


@pytest.mark.parametrize(
    "given, want", [("12.5%", "Nu"), ("2020年", "Dt"), ("2020-1", "Dt"), ("ABC-12", "Ca"), ("Hello world", "En"), ("x", "En"), ("5", "Nu"), ("A", "Ca"), ("Đ", "Sg"), ("Điều 5", None)]
)
def test_block_type(spark, given, want):
    assert one(spark, text.block_type(F.col("v")), v=given) == want


def test_reverse_rtl(spark):
    assert one(spark, text.reverse_rtl(F.col("v")), v="ab cم12ن") == "ن12مab c"


@pytest.mark.parametrize("x0, x1, want", [(400, 600, "center"), (600, 900, "right"), (50, 950, "justify"), (50, 500, "left")])
def test_alignment(spark, x0, x1, want):
    assert one(spark, style.alignment(F.col("a"), F.col("b"), F.lit(1000)), a=x0, b=x1) == want


@pytest.mark.parametrize(
    "given, bold, italic, underline, align",
    [("TÒA ÁN NHÂN DÂN", True, False, False, None), ("Nơi nhận:", True, True, False, "left"), ("Độc lập - Tự do - Hạnh phúc", True, False, True, "center"), ("12345", False, False, False, None)],
)
def test_style(spark, given, bold, italic, underline, align):
    s = one(spark, style.style(F.col("v"), F.lit(400), F.lit(600), F.lit(1000)), v=given)
    assert (s.bold, s.italic, s.underline) == (bold, italic, underline) and s.align == (align or "center")


def box(*v):
    return g.Box(*[F.lit(float(x)) for x in v])


def test_overlap(spark):
    assert one(spark, g.overlap_ratio(box(0, 0, 10, 10), box(5, 5, 15, 15)), v=0) == 0.25
    assert one(spark, g.overlap_ratio(box(0, 0, 10, 10), box(10, 0, 20, 10)), v=0) == 0
    assert one(spark, g.disjoint(box(0, 0, 10, 10), box(10, 0, 20, 10)), v=0) is False
    assert one(spark, g.overlap_ratio(box(0, 0, 0, 10), box(0, 0, 20, 10)), v=0) == 0


def test_nms_keeps_first_and_third(spark):
    rows = [(1, 0.9, 1, 0.0, 0.0, 10.0, 10.0), (1, 0.8, 2, 1.0, 1.0, 10.0, 10.0), (1, 0.7, 3, 20.0, 20.0, 30.0, 30.0), (1, 0.6, 4, 2.0, 2.0, 11.0, 11.0)]
    from folioframe.operators.layout import suppress

    df = spark.createDataFrame([(p, 0, *r) for p, *r in rows], "page int, cls int, score double, idx int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.idx for r in suppress(df, 0.45, plus=1).collect()) == [1, 3]


def test_clip_and_order(spark):
    assert one(spark, F.array(*g.clip_point(F.lit(-3), F.lit(120), F.lit(100), F.lit(50))), v=0) == [0, 99]
    from folioframe.operators.reading_order import bucketed

    assert [one(spark, bucketed(F.lit(y), F.lit(0), F.lit(0))[0], v=0) for y in (12.0, 12.5, 17.5)] == [10, 10, 20]


def test_decode(spark):
    ids = F.array(*[F.lit(i) for i in (0, 1, 1, 0, 1, 2, 2)])
    assert one(spark, decode.ctc_text(ids), v=0) == "001"
    assert one(spark, decode.ctc_text(F.array().cast("array<int>")), v=0) == ""
    probs = F.array(*[F.lit(p) for p in (0.1, 0.5, 0.9, 0.1, 0.7, 0.6, 0.2)])
    assert one(spark, decode.ctc_confidence(ids, probs), v=0) == pytest.approx(0.6)
    charset = "abcd"
    assert one(spark, decode.decode(F.array(*[F.lit(i) for i in (1, 6, 7, 2, 4)]), charset), v=0) == "cd"
    assert one(spark, decode.decode(F.array(*[F.lit(i) for i in (6, 7)]), charset), v=0) == "cd"
    assert one(spark, decode.decode(decode.encode(F.col("v"), charset), charset), v="badc") == "badc"


def test_normal_form_and_case_folding_of_all_code_points(spark):
    """As Python has them, wherever its Unicode version knows the code point."""
    import sys
    import unicodedata

    known = [c for i in range(sys.maxunicode + 1) if unicodedata.category(c := chr(i)) not in ("Cn", "Cs")]
    known += [a + b for a in "aeAEdơ가ᄀ\u0301" for b in "\u0300\u0301\u0302\u0323\u031bᅡᆨ"] + ["e\u0323\u0302", "e\u0302\u0323", "Điê\u0300u", ""]
    got = spark.createDataFrame([(c,) for c in known], "c string").select("c", text.nfkc(F.col("c")).alias("n"), text.casefold(F.col("c")).alias("f")).collect()
    assert [r.c for r in got if (r.n, r.f) != (unicodedata.normalize("NFKC", r.c), r.c.casefold())] == []
    assert one(spark, text.nfkc(F.col("v")), v=None) is None


def test_clauses_in_full_width_and_decomposed_letters(spark):
    import unicodedata

    plain = "điểm b khoản 2 Điều 173 Bộ luật Hình sự"
    for given in (plain, unicodedata.normalize("NFD", plain), plain.translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789"})):
        assert [c.display for c in one(spark, laws.parse_clauses(F.col("v")), v=given)] == ["điểm b khoản 2 Điều 173 BLHS"]
