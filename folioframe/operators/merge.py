"""Merging a document's partial extractions, in page order.

The fold depends on order: an entity is matched against what has been merged so
far, so it runs as one sequential function per document; documents run in parallel.
An index of keys finds each entity's place, so time grows with the entities, not
with their square.
Records are dicts of the extraction schema.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.laws import CLAUSE
from folioframe.functions.text import PLACEHOLDERS, QUOTES, date_key, firsts, generic_key, id_key, is_null_like, name_key
from folioframe.schema import EMPTY_LISTS, ENTITY, EXTRACTION, HEADER

_FOLD = str.maketrans(dict.fromkeys(QUOTES, "'"))
_CLAUSE = re.compile(CLAUSE.replace("(?iu)", ""), re.I)
# The code's names and short form.
_CODE = re.compile(r"\bblhs\b|bộ\s+luật\s+hình\s+sự", re.I)
_CODE_LONG = re.compile(r"\bbộ\s+luật\s+hình\s+sự\b", re.I)
_DATE = re.compile(r"\b(\d{1,2})\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{2,4})\b")
LAWS = "dieu_khoan_luat_ap_dung"


def null_like(v: Any) -> bool:
    return v is None or (isinstance(v, str) and v.strip().lower() in PLACEHOLDERS)


def empty(v: Any) -> bool:
    """Nothing but nulls, placeholders, blanks and empty lists, at any depth; a list of nulls is something."""
    if isinstance(v, dict):
        return all(map(empty, v.values()))
    if isinstance(v, list):
        return not v
    return null_like(v) or (isinstance(v, str) and not v.strip())


def _folded(s: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", s.translate(_FOLD)).casefold().split())


def item_key(v: Any) -> str:
    return _folded(v) if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True, default=str)


def entity_key(e: dict) -> tuple[str | None, str | None, str | None]:
    """(name, birth date, paper number), each null if unknown. A placeholder name hides the other person's."""
    own, foreign = e.get("bi_cao_vn") or {}, e.get("bi_cao_nuoc_ngoai") or {}
    name = own.get("ho_va_ten") or foreign.get("ho_ten")
    born = own.get("ngay_sinh") or foreign.get("ngay_sinh")
    paper = (own.get("giay_to_dinh_danh") or {}).get("so_giay_to") or foreign.get("so_giay_to")
    name = None if null_like(name) else " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", name.translate(_FOLD))).casefold().split())
    if null_like(born):
        born = None
    else:
        born = unicodedata.normalize("NFKC", str(born))
        if m := _DATE.search(born):
            born = f"{int(m[1]):02d}/{int(m[2]):02d}/{'19' * (len(m[3]) == 2)}{m[3]}"
        else:
            born = " ".join(born.casefold().split())
    paper = None if null_like(paper) else re.sub(r"\W+", "", unicodedata.normalize("NFKC", str(paper)).casefold()) or None
    return name, born, paper


def compatible(a: tuple, b: tuple) -> bool:
    """No birth date or paper number that both have differs."""
    return all(not (x and y) or x == y for x, y in zip(a[1:], b[1:], strict=True))


@functools.lru_cache(maxsize=1 << 14)
def _clauses(item: str) -> tuple[tuple, ...]:
    """(key, article or None, specific, display) of an item's clauses."""
    text = _CODE_LONG.sub("BLHS", unicodedata.normalize("NFKC", item.translate(_FOLD)))
    text = " ".join(text.strip(" .;,").split())
    code = "BLHS" if _CODE.search(text) else None
    found = []
    for point, clause, article in (m.groups() for m in _CLAUSE.finditer(text)):
        parts_shown = (point and clause and f"điểm {point.casefold()}", clause and f"khoản {clause}", f"Điều {article}", code)
        key = (code, article.casefold(), clause and clause.casefold(), point and point.casefold())
        found.append((key, key[:2], bool(clause or point), " ".join(x for x in parts_shown if x)))
    return tuple(found) or ((("raw", _folded(text)), None, False, text),)


def merge_laws(items: list) -> list[str]:
    """Displays of the clauses in order; general ones go where their article has a specific one, and repeats go."""
    found = [x for item in items if not null_like(item) for x in _clauses(str(item))]
    exact = {article for _, article, specific, _ in found if specific}
    out: dict[tuple, str] = {}
    for key, article, specific, shown in found:
        if specific or article not in exact:
            out.setdefault(key, shown)
    return list(out.values())


def merge_lists(name: str, old: list, new: list, seen: set | None = None) -> list:
    """Old items stay, repeats among them too; new ones follow if their key is new and they aren't null-like. seen: the old items' keys, where known; old and seen are then extended."""
    if name == LAWS:
        return merge_laws(old + new)
    seen, out = ({item_key(x) for x in old if not null_like(x)}, list(old)) if seen is None else (seen, old)
    for x in new:
        if not null_like(x) and (k := item_key(x)) not in seen:
            seen.add(k)
            out.append(x)
    return out


def fill(base: dict, new: dict, seen: dict | None = None, at: tuple = ()) -> dict:
    """base with its null-like values taken from new; structs are filled field by field, lists extended, other values stay.

    seen: for each list of base that has been extended before, by its path, its items' keys."""
    out = dict(base)
    for name, had in base.items():
        got = new.get(name)
        if null_like(got):
            continue
        if null_like(had):
            out[name] = got
        elif isinstance(had, dict) and isinstance(got, dict):
            out[name] = fill(had, got, seen, (*at, name))
        elif isinstance(had, list) and isinstance(got, list):
            keys = None
            if seen is not None and name != LAWS:
                keys = seen.get((*at, name))
                if keys is None:
                    keys, had = {item_key(x) for x in had if not null_like(x)}, list(had)
                    seen[(*at, name)] = keys
            out[name] = merge_lists(name, had, got, keys)
    return out


ANY = object()


def _held_under(key: tuple) -> list[tuple]:
    """Where an entity of this key is found: by its name with each of its other keys, or any."""
    name, born, paper = key
    return [(name, b, p) for b in (born or None, ANY) for p in (paper or None, ANY)]


def _asked_under(key: tuple) -> list[tuple]:
    """Where the entities stand that no key of this one rules out."""
    name, born, paper = key
    return [(name, b, p) for b in ((born, None) if born else (ANY,)) for p in ((paper, None) if paper else (ANY,))]


class Entities:
    """Entities in order, indexed by what they can be asked for, so that each new one finds its place without a look at all.

    For every combination of name, birth date and paper number (each known, unknown or any) a heap holds the places of
    the entities; entries whose entity has changed its key since go when they come up."""

    def __init__(self, items: list[dict] | None = None):
        self.items: list[dict] = []
        self._keys: list[tuple] = []
        self._heaps: dict[tuple, list[int]] = {}
        self._blank: list[int] = []
        self._seen: dict[int, dict] = {}
        for e in items or []:
            self._append(e)

    def _append(self, e: dict) -> None:
        if empty(e):
            heapq.heappush(self._blank, len(self.items))
        self.items.append(e)
        self._keys.append((None, None, None))
        self._file(len(self.items) - 1)

    def _file(self, i: int) -> None:
        key = entity_key(self.items[i])
        if key != self._keys[i]:
            self._keys[i] = key
            if key[0] is not None:
                for b in _held_under(key):
                    heapq.heappush(self._heaps.setdefault(b, []), i)

    def place_of(self, key: tuple) -> int | None:
        """Where an entity of this key belongs: the first of its name with no conflicting key, else the first empty one; without a name, the last."""
        if key[0] is None:
            return len(self.items) - 1 if self.items else None
        found = []
        for b in _asked_under(key):
            heap = self._heaps.get(b, [])
            while heap and b not in _held_under(self._keys[heap[0]]):
                heapq.heappop(heap)
            found += heap[:1]
        while not found and self._blank and not empty(self.items[self._blank[0]]):
            heapq.heappop(self._blank)
        return min(found) if found else self._blank[0] if self._blank else None

    def absorb(self, new: dict) -> None:
        key = entity_key(new)
        at = self.place_of(key)
        if at is not None:
            self.items[at] = fill(self.items[at], new, self._seen.setdefault(at, {}))
            self._file(at)
        elif key[0] is not None:
            self._append(new)


class Fold:
    """The merge of a document's parts in their order. The first part is taken as it is."""

    def __init__(self, merged: dict | None = None):
        self._base = merged
        self._entities = Entities((merged or {}).get("danh_sach_doi_tuong"))

    @property
    def merged(self) -> dict | None:
        """What has been merged so far, for a later Fold to go on from."""
        return self._base and {**self._base, "danh_sach_doi_tuong": self._entities.items}

    def add(self, part: dict) -> None:
        if self._base is None:
            self._base, self._entities = part, Entities(part["danh_sach_doi_tuong"])
            return
        for new in part.get("danh_sach_doi_tuong") or []:
            if not empty(new):
                self._entities.absorb(new)
        self._base = {**self._base, "thong_tin_chung": fill(self._base.get("thong_tin_chung") or {}, part.get("thong_tin_chung") or {})}

    def result(self) -> dict:
        return cleanup(self.merged) if self._base else empty_result()


def sanitize(v: Any) -> Any:
    """Placeholders as null, at any depth; in lists they stay as nulls in place."""
    if isinstance(v, dict):
        return {k: sanitize(x) for k, x in v.items()}
    if isinstance(v, list):
        return [sanitize(x) for x in v]
    return None if null_like(v) else v


def cleanup(result: dict) -> dict:
    """Placeholders to null, empty entities out, entities matched once more from scratch, law lists normalised."""
    result = sanitize(result)
    matched = Entities()
    for e in result.get("danh_sach_doi_tuong") or []:
        if not empty(e):
            matched.absorb(e)
    entities = matched.items
    for i, e in enumerate(entities):
        verdict = e.get("thong_tin_ket_an") or {}
        if isinstance(verdict.get(LAWS), list):
            entities[i] = {**e, "thong_tin_ket_an": {**verdict, LAWS: merge_laws(verdict[LAWS])}}
    return {**result, "danh_sach_doi_tuong": entities}


def empty_result() -> dict:
    return {"thong_tin_chung": {n: None for n in HEADER.names}, "danh_sach_doi_tuong": []}


def complete(v: Any, kind: T.DataType, name: str = "") -> Any:
    """v with every field of its type; the lists that are read as empty where null are."""
    if isinstance(kind, T.StructType):
        return None if v is None else {f.name: complete(v.get(f.name), f.dataType, f.name) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return ([] if name in EMPTY_LISTS or isinstance(kind.elementType, T.StructType) else None) if v is None else [complete(x, kind.elementType) for x in v]
    return v


def fold(parts: list[dict]) -> dict:
    merged = Fold()
    for p in parts:
        merged.add(complete(p, EXTRACTION))
    return merged.result()


def merge_partials(partials: DataFrame) -> DataFrame:
    """(doc_id, result) as JSON from (doc_id, page, partial JSON), in page order. Partials that don't parse are skipped;
    a document without any gives the empty result. One document's partials meet in one task."""
    kind = dict(partials.dtypes)["doc_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for raw in pdf.sort_values("page", kind="stable")["partial"]:
            try:
                part = json.loads(raw)
            except (TypeError, ValueError):
                continue
            if isinstance(part, dict):
                parts.append(part)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "result": [json.dumps(fold(parts), ensure_ascii=False)]})

    return partials.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, result string")


def read_extraction(raw: Column) -> Column:
    """JSON as the extraction struct, null lists read as empty."""
    s = F.from_json(raw, EXTRACTION)
    lists = lambda e: e.withField("thong_tin_ket_an", _with_lists(e["thong_tin_ket_an"]))
    return F.when(s.isNotNull(), s.withField("danh_sach_doi_tuong", F.coalesce(F.transform(s["danh_sach_doi_tuong"], lists), F.array().cast(T.ArrayType(ENTITY)))))


def _with_lists(verdict: Column) -> Column:
    for name in EMPTY_LISTS:
        verdict = F.when(verdict.isNotNull(), verdict.withField(name, F.coalesce(verdict[name], F.array().cast("array<string>"))))
    return verdict


def ordered_distinct(old: Column, new: Column) -> Column:
    """merge_lists as an expression: old items and then the new ones whose key isn't there yet. Each key is made once."""
    known = lambda items: F.filter(items, lambda x: ~is_null_like(x))
    keyed = lambda x, at: F.struct(generic_key(x).alias("key"), at.cast("int").alias("at"), x.alias("item"))
    had = F.transform(known(old), lambda x: keyed(x, F.lit(-1)))
    fresh = F.filter(firsts(F.array_sort(F.concat(had, F.transform(known(new), keyed)))), lambda x: x["at"] >= 0)
    return F.concat(old, F.transform(F.array_sort(F.transform(fresh, lambda x: F.struct(x["at"], x["item"]))), lambda x: x["item"]))


def keys_compatible(dob_a: Column, id_a: Column, dob_b: Column, id_b: Column) -> Column:
    same = lambda a, b: F.coalesce(F.nullif(a, F.lit("")) == F.nullif(b, F.lit("")), F.lit(True))
    return same(dob_a, dob_b) & same(id_a, id_b)


def least_compatible(df: DataFrame, scope: list[str], person: str) -> DataFrame:
    """(person, matched): for each row of df(scope, person, dob_key, id_key) the least other person of its scope, if less
    than it, whose keys are compatible. Null and empty keys are unknown and fit any; rows with a null in scope match nothing.

    Answered from the minima of each combination of keys, so no pairs are formed: a row looks up at most four minima."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.nullif(F.col(c), F.lit(""))), F.lit("?"))  # noqa: E731  "=" known, "?" unknown, "*" either
    keys = df.select(*scope, F.col(person).alias("_person"), mark("dob_key").alias("_dob"), mark("id_key").alias("_id"))
    least = keys.groupBy(*scope, "_dob", "_id").agg(F.min("_person").alias("_least"))
    for c in ("_dob", "_id"):
        least = least.withColumn(c, F.explode(F.array(c, F.lit("*"))))
        keys = keys.withColumn(c, F.explode(F.when(F.col(c) == "?", F.array(F.lit("*"))).otherwise(F.array(F.col(c), F.lit("?")))))
    least = least.groupBy(*scope, "_dob", "_id").agg(F.min("_least").alias("_least"))
    found = keys.join(least, [*scope, "_dob", "_id"]).where("_least < _person")
    return found.groupBy(F.col("_person").alias(person)).agg(F.min("_least").alias("matched"))


def person_keys(df: DataFrame, name: Column, dob: Column, paper: Column) -> DataFrame:
    return df.withColumns({"name_key": F.when(~is_null_like(name), name_key(name)), "dob_key": date_key(dob), "id_key": id_key(paper)})


def first_known(df: DataFrame, keys: list[str], order: str, *names: str) -> DataFrame:
    """For each group the first value, by `order`, of each column that is not null-like."""
    known = lambda c: F.min_by(F.col(c), F.when(~is_null_like(F.col(c)), F.col(order)))
    return df.groupBy(*keys).agg(*(known(c).alias(c) for c in names))
