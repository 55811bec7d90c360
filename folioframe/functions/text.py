"""Text, date and identifier keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that count as null, and quote marks that count as an apostrophe.
PLACEHOLDERS = ("null", "không rõ", "không xác định", "n/a", "none")
QUOTES = "‘’‚ʼ`´"
#: White space as str.split() and str.strip() know it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f" {SPACE}+|{SPACE[:-1]}&&[^ ]]{SPACE}*", " "), F.lit(" "))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(f"[^{SPACE[1:]}"), F.lit(False))


def is_null_like(c: Column) -> Column:
    """Null or a placeholder; the empty string is neither."""
    return c.isNull() | (c.rlike(f"(?iu)^{SPACE}*(?:{'|'.join(PLACEHOLDERS)}){SPACE}*$") & F.lower(strip(c)).isin(*PLACEHOLDERS))


def null_if_placeholder(c: Column) -> Column:
    return F.when(~is_null_like(c), c)


def fold_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES, "'" * len(QUOTES))


def compat(c: Column) -> Column:
    """nfkc() of what is never null. A chain of steps checks its input for nulls once, as each check evaluates all steps before it again."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def _folded(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))


def nfkc(c: Column) -> Column:
    """Compatibility normal form, by the Unicode library that Spark itself ships for its collations: no Python worker runs."""
    return F.when(c.isNotNull(), compat(c))


def casefold(c: Column) -> Column:
    """Full case folding (ß as ss), which lower() isn't."""
    return F.when(c.isNotNull(), _folded(c))


def name_key(c: Column) -> Column:
    """Comparison key of a name: compatibility forms unified, punctuation gone, case folded, spaces collapsed."""
    return F.when(c.isNotNull(), collapse(_folded(F.regexp_replace(compat(fold_quotes(c)), r"[^\p{L}\p{N}_\s]", " "))))


def generic_key(c: Column) -> Column:
    """Key of a list item: compatibility forms, quotes and case folded, spaces collapsed, punctuation kept."""
    return F.when(c.isNotNull(), collapse(_folded(compat(fold_quotes(c)))))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def firsts(keyed: Column) -> Column:
    """Of structs sorted by what decides and then their place, the first of each field key: one sort, however long the list."""
    return bound(keyed, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["key"] != x["key"])))


DATE = rf"(?<!{WORD})(\d{{1,2}})\s*[/.-]\s*(\d{{1,2}})\s*[/.-]\s*(\d{{2,4}})(?!{WORD})"


def date_key(c: Column) -> Column:
    """dd/mm/yyyy of the first date; two-digit years are 19yy, and the calendar is not checked. Other text: collapsed, lower case."""
    v = nfkc(c)
    day, month, year = (F.regexp_extract(v, DATE, i) for i in (1, 2, 3))
    year = F.when(F.length(year) == 2, F.concat(F.lit("19"), year)).otherwise(year)
    found = F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year)
    return F.when(~is_null_like(c), F.when(v.rlike(DATE), found).otherwise(collapse(casefold(v))))


def id_key(c: Column) -> Column:
    """Letters, digits and underscores, lower case; null if none is left."""
    v = casefold(nfkc(c))
    return F.when(~is_null_like(c), F.nullif(F.regexp_replace(v, r"[^\p{L}\p{N}_]+", ""), F.lit("")))


def document_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parse_reply(c: Column) -> Column:
    """The JSON object of a model's reply as map<string,string>; null where it doesn't parse.

    Thoughts up to </think> go; a fenced block counts alone, else what begins at the first brace."""
    raw = strip(c)
    end = F.instr(raw, "</think>")
    raw = F.when((F.instr(raw, "<think>") > 0) & (end > 0), strip(F.substr(raw, end + 8))).otherwise(raw)
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    at = F.instr(raw, "{")
    body = F.when(raw.rlike(fence), strip(F.regexp_extract(raw, fence, 1))).otherwise(F.when(at > 0, F.substr(raw, at)).otherwise(raw))
    return F.when(body.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(body, "map<string,string>"))


def reverse_rtl(c: Column) -> Column:
    """Order of pieces reversed; runs of Latin letters, digits and common signs stay as they are."""
    return F.array_join(F.reverse(F.regexp_extract_all(c, F.lit(r"([a-zA-Z0-9 :*./%+-]+|(?s:.))"), F.lit(1))), "")


# A cell's type is that of the first pattern that matches its text.
BLOCK_TYPES = (
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    (r"^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
)


def block_type(c: Column) -> Column:
    text = strip(c)
    out = F.lit(None).cast("string")
    for pattern, name in reversed(BLOCK_TYPES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


# Fixed value: what begins a caption.
CAPTION = r"^[图表]+[ 0-9:：]{2,}"


def is_caption(text: Column, layout_type: Column) -> Column:
    return strip(text).rlike(CAPTION) | F.coalesce(layout_type.contains("caption"), F.lit(False))


# Texts that are never content.
GARBAGE = (r"^•+$", r"^[0-9]{1,2} / ?[0-9]{1,2}$", r"^[0-9]{1,2} of [0-9]{1,2}$", r"^http://[^ ]{12,}", r"\(cid *: *[0-9]+ *\)")


def is_garbage(c: Column) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in GARBAGE))
