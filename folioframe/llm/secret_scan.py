"""Operator 1: secret scans by multipart credential linking. DataFrame functions only.

Strong spans (an assignment of 12 or more characters, an access key id, a run of
hex digits) are always reported. Weak candidates (an account, an endpoint, a
short or an opaque secret) are reported only where a complementary part lies
within SCOPE code points: a secret needs an identifier or an endpoint, an
identifier or an endpoint needs a secret. A part that overlaps the candidate is no
other part and complements nothing. This interval join is a sweep over
each text's parts: the nearest part of each role that ends before the candidate, and
the nearest that begins after it, decide, so no pairs are made.

All of it is row-local: no text and no part is shuffled or sorted with another
row's. Sequential steps (offsets, sweeps, the rebuilding of a text) are
folds whose results are gathered in blocks, so very long texts with very many parts
take time in proportion to their length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points between a weak candidate and its complement.
SCOPE = 200
# The patterns of the kinds, in the order in which spans of equal start are listed.
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "account": r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
    "endpoint": r"""(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|""" + ADDRESS,
    "opaque": r"[A-Za-z0-9+/_-]{20,}",
    "short": ASSIGN,
}
#: What the lower-cased text of a match holds one of; a text without them is not searched for the kind.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "account": ("user", "login", "client"), "endpoint": ("://",), "hex": (), "opaque": ()}
#: A match of these is a whole run of its characters, so it need not be tried inside one.
RUNS = {"hex": "(?<![0-9a-f])", "opaque": "(?<![A-Za-z0-9+/_-])"}
KINDS = list(PATTERNS)
#: The kinds with a pattern of their own; a short one is an assignment's.
REGEXES = [k for k in KINDS if k != "short"]
STRONG = ("assign", "access", "hex")
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "short": "secret", "access": "ident", "account": "ident", "endpoint": "endpoint"}


#: Items that are folded at once, and code points of a text that are cut off at once.
BLOCK, CUT = 64, 4096
ROLES = ("secret", "ident", "endpoint")
_PART = "struct<start:bigint,rank:int,end:bigint>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, kind: str, state: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """out(state, item) for each item, the state then becoming step(state, item); kind: the type of the results.

    A fold copies what it has gathered at each step, so items are folded in blocks, and those in blocks of blocks."""
    empty = F.array().cast(f"array<{kind}>")

    def fold(some: Column, start: Column, level: int) -> Column:
        zero = F.struct(start.alias("state"), empty.alias("outs"))
        if level == 0:
            return F.aggregate(some, zero, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["outs"], F.array(out(acc["state"], x))).alias("outs")))
        size = BLOCK**level

        def inside(all_items: Column) -> Column:
            def merge(acc: Column, at: Column) -> Column:
                inner = fold(F.slice(all_items, at, F.lit(size)), acc["state"], level - 1)
                return bound(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], r["outs"]).alias("outs")))

            firsts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(size))
            return F.aggregate(firsts, zero, merge)

        return bound(some, inside)

    return fold(items, state, 2)["outs"]


def _found(text: Column, low: Column, kind: str, note: Callable[[Column], Column]) -> Column:
    """The kind's matches in order: what lies before each, its length and its note, which must be positive for it to count."""
    kind_of, pattern = F.lit(REGEXES.index(kind)), RUNS.get(kind, "") + PATTERNS[kind]
    sized = lambda found: lambda pieces: F.transform(
        found, lambda m, i: F.struct(kind_of.alias("kind"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), note(m).cast("int").alias("note"))
    )
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,note:int>>")
    # a text in which nothing matches is not cut
    each = lambda found: F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), sized(found))).otherwise(none)
    hints = [low.contains(x) for x in HINTS[kind]]
    if kind == "endpoint":  # without the mark of a URL only an address can match
        pattern = F.when(hints[0], F.lit(pattern)).otherwise(F.lit(ADDRESS))
        hints.append(text.rlike(r"[0-9]\.[0-9]"))
    else:
        pattern = F.lit(pattern)
    found = bound(F.regexp_extract_all(text, pattern, F.lit(0)), each)
    return F.when(functools.reduce(Column.__or__, hints), found).otherwise(none) if hints else found


def _parts(text: Column) -> Column:
    """All parts of a text, strong and weak, as structs of start, rank and end."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    note = {"assign": value, "opaque": mixed}
    found = bound(F.lower(text), lambda low: F.concat(*(_found(text, low, k, note.get(k, lambda m: F.lit(1))) for k in REGEXES)))
    # a kind's matches lie one after another; the next kind's begin at the text's start again
    before = lambda s, x: F.when(s["kind"] == x["kind"], s["end"]).otherwise(F.lit(0).cast("long")) + x["gap"]
    step = lambda s, x: F.struct(x["kind"].alias("kind"), (before(s, x) + x["len"]).alias("end"))
    ranks = F.array(*[F.lit(KINDS.index(k)) for k in REGEXES])
    rank = lambda x: F.when((x["kind"] == 0) & (x["note"] < 12), F.lit(KINDS.index("short"))).otherwise(F.get(ranks, x["kind"]))
    out = lambda s, x: F.struct(before(s, x).alias("start"), F.when(x["note"] >= F.when(x["kind"] == 0, 6).otherwise(1), rank(x)).alias("rank"), (before(s, x) + x["len"]).alias("end"))
    none = F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("end"))
    located = lambda found: F.filter(scan(found, _PART, none, step, out), lambda x: x["rank"].isNotNull())
    return bound(found, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(F.array().cast(f"array<{_PART}>")))


def _linked(parts: Column, edge: Callable[[Column], Column], begin: Callable[[Column], Column]) -> Column:
    """The parts x for which a complementary part y has edge(y) <= begin(x) <= edge(y) + SCOPE."""
    event = lambda pos, asks: lambda x: F.struct(pos(x).alias("pos"), F.lit(asks).alias("asks"), x.alias("x"))
    events = F.sort_array(F.concat(F.transform(parts, event(edge, 0)), F.transform(parts, event(begin, 1))))
    role = lambda x: F.element_at(F.array(*[F.lit(ROLES.index(ROLE[k])) for k in KINDS]), x["rank"] + 1)
    last = F.struct(*[F.lit(None).cast("long").alias(r) for r in ROLES])
    step = lambda s, e: F.struct(*[F.when((e["asks"] == 0) & (role(e["x"]) == i), e["pos"]).otherwise(s[r]).alias(r) for i, r in enumerate(ROLES)])

    def meets(s: Column, e: Column) -> Column:
        near = {r: F.coalesce(e["pos"] - s[r] <= SCOPE, F.lit(False)) for r in ROLES}
        tied = F.when(role(e["x"]) == ROLES.index("secret"), near["ident"] | near["endpoint"]).otherwise(near["secret"])
        return F.struct(e["x"].alias("x"), ((e["asks"] == 1) & tied).alias("tied"))

    return F.transform(F.filter(scan(events, f"struct<x:{_PART},tied:boolean>", last, step, meets), lambda r: r["tied"]), lambda r: r["x"])


def find_spans(text: Column) -> Column:
    """A text's reported spans: array<struct<start, rank, end>> in order of start and rank; rank indexes KINDS.

    Null and empty texts have no spans."""
    strong = lambda parts: F.filter(parts, lambda x: x["rank"] < len(STRONG))
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))  # noqa: E731  of sorted parts

    def told(parts: Column) -> Column:
        before = _linked(parts, lambda x: x["end"], lambda x: x["start"])
        after = _linked(parts, lambda x: -x["start"], lambda x: -x["end"])
        return F.when(F.exists(parts, lambda x: x["rank"] >= len(STRONG)), bound(F.sort_array(F.concat(strong(parts), before, after)), once)).otherwise(F.sort_array(parts))

    return bound(_parts(F.coalesce(text, F.lit(""))), told)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists all reported spans, base_sha256 digests the strong ones (of an
    empty list where there are none). Offsets are code points, ends exclusive. Null
    and empty texts have no spans, very long ones are read whole. A null id is carried, repeated rows each give a row.
    Extra columns are not read. Empty tables give no rows.
    """
    found = docs.select(F.col(id_col).alias("id"), find_spans(F.col(text_col)).alias("spans"))
    strong = F.filter("spans", lambda s: s["rank"] < len(STRONG))
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        *(count(r).alias(f"n_{k}") for r, k in enumerate(STRONG)),
        F.sha2(listed(strong), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text, each span replaced by mark (spans that overlap or touch: by one).

    The text is cut once into blocks of CUT code points; each piece between spans is taken from its own blocks."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CUT)
        own = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor(b / CUT) - first + 1).cast("int")), "")
        return F.substr(own, (a - first * CUT + 1).cast("int"), (b - a).cast("int"))

    def rebuilt(blocks: Column) -> Column:
        reach = lambda pos, s: F.greatest(pos, s["end"])
        gaps = scan(spans, "struct<a:bigint,b:bigint,new:boolean>", F.lit(-1).cast("long"), reach, lambda pos, s: F.struct(F.greatest(pos, F.lit(0)).alias("a"), s["start"].alias("b"), (s["start"] > pos).alias("new")))
        kept = F.transform(F.filter(gaps, lambda g: g["new"]), lambda g: piece(blocks, g["a"], g["b"]))
        rest = piece(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("long"))
        return F.array_join(F.concat(kept, F.array(rest)), mark)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), rebuilt)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, each reported span of the text replaced by mark (spans that overlap or touch: by one).

    Texts without spans, null and empty ones included, stay as they are; very long ones are rebuilt whole. All rows
    and columns stay, whatever their names. Empty tables give no rows.
    """
    found = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), find_spans(F.col(text_col)).alias("spans"))
    text = F.col("row")[text_col]
    new = F.when(F.size("spans") > 0, masked(text, F.col("spans"), mark)).otherwise(text)
    return found.select(*((new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
