"""Operator 6: quality classifier by co-training.

Two views of a document: its content (which selected words and symbol runs
occur) and its page metadata (language, source, size and layout figures). For each
target, low quality and toxicity, a classifier of each view starts from the
labelled rows; over ROUNDS rounds each hands its most confident pseudo-labels on
unlabelled rows to the other. Each is then calibrated for itself on labelled rows kept
aside (a scale and a shift of its log odds), and the calibrated log odds are combined, by
weights from the same rows since the views aren't independent, into one score for every document.

Training uses a bounded sample of labelled rows, LABELLED chosen by a hash of the id. Pseudo-labels are looked for
among all unlabelled documents: their features are kept in the checkpoint folder, each round
scores them all on the executors, and only the rows handed over (at most HANDED a side, view and target) reach the driver.
The final scores come from the same features. Very long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk
from folioframe.llm.shared import cut, few

LABELLED = 12_000
ROUNDS = 3
#: Pseudo-labels of a side that one view gives the other in a round, at most, and how sure it must be.
HANDED = 400
SURE = 0.99
#: A word enters the content view if its chi-square against the target is at least this.
CHI2 = 15.0
#: Parts in which a round's most confident rows are first looked for.
PARTS = 64
#: One labelled row of so many, by a hash, only calibrates.
ASIDE = 4
TARGETS = ("bad", "toxic")

_SOURCES = 32
_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 letters and bytes of other scripts, 2 digits, 3 symbols
_CLASS[33:127] = 3
_CLASS[128:] = 1
for _a, _b, _c in ((65, 91, 1), (97, 123, 1), (48, 58, 2)):
    _CLASS[_a:_b] = _c
_CLASS[[c for c in range(33) if c not in (9, 10, 11, 12, 13, 32)] + [127]] = 3


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of letters, digits or symbols; A-Z lower-cased, but a run
    of capitals also counts as itself."""
    n = len(raw)
    kind = _CLASS[raw]
    data = np.zeros(n + 8, np.uint8)
    np.take(tk._LOWER, raw, out=data[:n])
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    starts = np.flatnonzero(edge[:-1] & (kind > 0))
    ends = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    return tk._hash(data, starts, ends - starts), np.searchsorted(starts, off)


#: Numeric figures of the metadata view, before the hashed source and language.
FIGURES = ("length", "declared", "words", "word_length", "capitals", "digits", "symbols", "spaces", "lines", "line_length", "distinct_lines", "distinct_words")


def layout(raw: np.ndarray, off: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, declared: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / size
    capitals = per((raw >= 65) & (raw <= 90))
    digits, symbols, spaces = per(_CLASS[raw] == 2), per(_CLASS[raw] == 3), per(_CLASS[raw] == 0)
    lines = per(raw == 10) * size + 1
    words = np.diff(bounds)
    distinct_lines, distinct_words = np.ones(n), np.ones(n)
    for i in range(n):
        h = hashes[bounds[i] : bounds[i + 1]]
        if len(h):
            distinct_words[i] = len(np.unique(h)) / len(h)
        if lines[i] > 1:
            parts = raw[off[i] : off[i + 1]].tobytes().split(b"\n")
            distinct_lines[i] = len(set(parts)) / len(parts)
    return np.stack(
        [np.log1p(size), np.log1p(np.maximum(declared, 0)), np.log1p(words), size / np.maximum(words, 1), capitals, digits, symbols, spaces, np.log(lines), np.log(size / lines), distinct_lines, distinct_words],
        axis=1,
    )


def _named(column: pa.Array, buckets: int) -> np.ndarray:
    """One-hot hashed names; null is a name of its own."""
    out = np.zeros((len(column), buckets))
    for i, x in enumerate(column.to_pylist()):
        h = 0
        for c in ("\0" if x is None else str(x)).encode():
            h = (h * 131 + c) % 1_000_003
        out[i, h % buckets] = 1
    return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, bounds, metadata matrix) of a batch with text, lang, source and n_chars."""
    raw, off = tk.text_bytes(batch.column("text"))
    h, b = tokens(raw, off)
    declared = batch.column("n_chars").cast(pa.float64()).fill_null(0.0).to_numpy()
    meta = np.hstack([layout(raw, off, h, b, declared), _named(batch.column("lang"), 16), _named(batch.column("source"), _SOURCES)])
    return h, b, meta


def _features(batches):
    """(id, words, meta): the distinct token hashes and the metadata figures."""
    for batch in tk.slices(batches, "text"):
        h, b, meta = _views(batch)
        words = [np.unique(h[b[i] : b[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.list_(pa.int64())), pa.array(list(meta), pa.list_(pa.float64()))], ["id", "words", "meta"])


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept and is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    shrink[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + shrink * w
        h = np.diag(shrink)
        for a in range(0, len(x), 1000):  # by parts, to keep the driver small
            part = x[a : a + 1000].astype(float)
            h += (part * (p * (1 - p) + 1e-9)[a : a + 1000, None]).T @ part
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Found:
    """The words that rows contain: row[i] has word[i] of `size` words, each pair once; rows in order."""

    row: np.ndarray
    word: np.ndarray
    shape: tuple[int, int]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.word], self.shape[0])

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, v[self.row], self.shape[1])

    def __getitem__(self, rows: np.ndarray) -> Found:
        start, end = np.searchsorted(self.row, rows), np.searchsorted(self.row, rows, side="right")
        n = end - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Found(np.repeat(np.arange(len(rows)), n), self.word[at], (len(rows), self.shape[1]))


def _fit_words(x: Found, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """_fit over words, without a dense matrix: conjugate gradients, scaled by the diagonal, solve each Newton step."""
    w, shrink = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, l2)
    shrink[-1] = 1e-6
    back = lambda v: np.append(x.transposed(v), v.sum())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(_odds(x, w), -30, 30)))
        q = p * (1 - p) + 1e-9
        left, diagonal = back(p - y) + shrink * w, back(q) + shrink
        step, way, goal = np.zeros(len(w)), left / diagonal, 1e-6 * np.sqrt(left @ (left / diagonal))
        size = left @ way
        for _ in range(200):
            if np.sqrt(size) <= max(goal, 1e-12):
                break
            h = back(q * _odds(x, way)) + shrink * way
            a = size / (way @ h)
            step, left = step + a * way, left - a * h
            size, last = left @ (left / diagonal), size
            way = left / diagonal + size / last * way
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-5:
            break
    return w


def _odds(x: np.ndarray | Found, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _found(vocabulary: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> Found:
    """The vocabulary's words among each row's hashes."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.zeros(0, np.int64)
    if len(vocabulary):
        word = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = vocabulary[word] == hashes
        at = np.unique(row[hit] * len(vocabulary) + word[hit])
    return Found(*np.divmod(at, max(1, len(vocabulary))), (len(bounds) - 1, len(vocabulary)))


@dataclass
class Model:
    """vocabulary: sorted token hashes of the content view; for each target the views' weights, and how they are combined:
    each view's scale and shift, and the weights of the calibrated views."""

    vocabulary: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    content: dict[str, np.ndarray]
    meta: dict[str, np.ndarray]
    combine: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def log_odds(self, found: Found, meta: np.ndarray, target: str) -> np.ndarray:
        views = _odds(found, self.content[target]), _odds((meta - self.mean) / self.scale, self.meta[target])
        *scales, weights = self.combine[target]
        return _odds(np.stack([_scaled(v, w) for v, w in zip(views, scales, strict=True)], axis=1), weights)


def _scaled(odds: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip(_odds(np.clip(odds, -12, 12)[:, None], scale), -12, 12)


def _calibrated(odds: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """(scale, shift) that make a view's odds those of the labels; a view that says nothing, or the opposite, counts as the target's own odds."""
    w = _fit(np.clip(odds, -12, 12)[:, None], y, 0.1)
    return w if w[0] > 0 else np.array([0.0, prior])


@dataclass
class Rows:
    """Features of rows: the vocabulary's words in them, and their metadata figures."""

    found: Found
    meta: np.ndarray

    @staticmethod
    def of(words: pa.Array, meta: pa.Array, size: int) -> Rows:
        words, meta = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (words, meta))
        at = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        return Rows(Found(at, words.flatten().to_numpy().astype(np.int64), (len(words), size)), meta.flatten().to_numpy().reshape(len(words), len(FIGURES) + 16 + _SOURCES))

    def views(self, own: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[Found, np.ndarray]:
        """The content view over the target's own words, and the metadata view."""
        mine = own[self.found.word]
        return Found(self.found.row[mine], self.found.word[mine], self.found.shape), (self.meta - mean) / scale


def _joined(a, b):
    if isinstance(a, Found):
        return Found(np.concatenate([a.row, b.row + a.shape[0]]), np.concatenate([a.word, b.word]), (a.shape[0] + b.shape[0], a.shape[1]))
    return np.concatenate([a, b])


def train(rows: Rows, labels: dict[str, np.ndarray], aside: np.ndarray, vocabulary: np.ndarray, picks: dict[str, np.ndarray], hand) -> Model:
    """rows: the labelled ones; those that are aside only calibrate. picks: which words of the vocabulary are each
    target's content words. hand(weights, mean, scale) gives for each (target, receiving view) new unlabelled Rows and their guesses."""
    seeds, kept = np.flatnonzero(~aside), np.flatnonzero(aside)
    some = len(rows.meta) > 0
    mean = rows.meta.mean(axis=0) if some else np.zeros(rows.meta.shape[1])
    scale = rows.meta.std(axis=0) if some else np.ones(rows.meta.shape[1])
    scale = np.where(scale > 1e-6, scale, 1.0)
    views = {t: rows.views(picks[t], mean, scale) for t in TARGETS}
    sets = {(t, v): (views[t][v][seeds], labels[t][seeds].astype(float)) for t in TARGETS for v in (0, 1)}
    for r in range(ROUNDS + 1):
        w = {at: (_fit_words, _fit)[at[1]](*sets[at]) for at in sets}
        if r == ROUNDS or not len(seeds):
            break
        handed = hand(w, mean, scale)
        for (t, v), (new, guess) in handed.items():
            x, y = sets[t, v]
            sets[t, v] = (_joined(x, new.views(picks[t], mean, scale)[v]), np.concatenate([y, guess]))
        if not handed:
            break
    combine = {}
    for t in TARGETS:
        y = labels[t][kept].astype(float)
        prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        odds = [_odds(views[t][v], w[t, v])[kept] for v in (0, 1)]
        scales = [_calibrated(o, y, prior) for o in odds]
        combine[t] = (*scales, _fit(np.stack([_scaled(o, s) for o, s in zip(odds, scales, strict=True)], axis=1), y, 0.1))
    return Model(vocabulary, mean, scale, {t: w[t, 0] for t in TARGETS}, {t: w[t, 1] for t in TARGETS}, combine)


def _placed(vocabulary: np.ndarray):
    """(id, words, meta): the places of each text's words in the vocabulary, and the metadata figures."""

    def run(batches):
        for batch in tk.slices(batches, "text"):
            h, b, meta = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(_found(vocabulary, h.view(np.int64), b)), pa.array(list(meta), pa.list_(pa.float64()))], ["id", "words", "meta"])

    return run


def _confident(w: dict, mean: np.ndarray, scale: np.ndarray, picks: dict[str, np.ndarray]):
    """(doc_id, key, kind, sure): where a view is sure of a row; kind is the target (4), the other view (2) and the side (1)."""
    least = np.log(SURE / (1 - SURE))

    def run(batches):
        for b in batches:
            rows = Rows.of(b.column("words"), b.column("meta"), len(picks[TARGETS[0]]))
            for i, t in enumerate(TARGETS):
                for v, x in enumerate(rows.views(picks[t], mean, scale)):
                    odds = _odds(x, w[t, v])
                    at = np.flatnonzero(np.abs(odds) >= least)
                    kind = 4 * i + 2 * (1 - v) + (odds[at] > 0)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("key").take(at), pa.array(kind.astype(np.int32)), pa.array(np.abs(odds[at]))], ["doc_id", "key", "kind", "sure"])

    return run


def _hand(free: DataFrame, known: DataFrame, picks: dict[str, np.ndarray]):
    """The hand of train: over free(doc_id, key, words, meta) without the known doc_ids; no row is handed to a view twice."""
    spark, kind = free.sparkSession, dict(free.dtypes)["doc_id"]
    free = free.where("doc_id is not null")
    known = few(known.select("doc_id"), known.count())
    given: set[tuple[int, int]] = set()

    def hand(w, mean, scale):
        sure = free.select("doc_id", "key", "words", "meta").mapInArrow(_confident(w, mean, scale, picks), f"doc_id {kind}, key long, kind int, sure double")
        sure = sure.join(known, "doc_id", "left_anti")
        if given:
            old = spark.createDataFrame(sorted(given), "key long, to int")
            sure = sure.withColumn("to", F.expr("kind div 2").cast("int")).join(F.broadcast(old), ["key", "to"], "left_anti")
        sure = sure.groupBy("kind", "key").agg(F.max("sure").alias("sure"))
        for part in (["kind", F.pmod(F.xxhash64("key"), F.lit(PARTS))], ["kind"]):  # so that no task meets more than PARTS * HANDED rows of a kind
            sure = sure.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("sure"), "key"))).where(F.col("place") <= HANDED).drop("place")
        best = sorted((r.kind // 2, -(r.kind % 2), -r.sure, r.key) for r in sure.collect())
        if not best:
            return {}
        given.update((key, to) for to, _, _, key in best)
        keys = spark.createDataFrame(sorted({(key,) for *_, key in best}), "key long")
        # equal keys are equal rows
        t = free.join(F.broadcast(keys), "key").dropDuplicates(["key"]).select("key", "words", "meta").orderBy("key").toArrow()
        rows, place = Rows.of(t.column("words"), t.column("meta"), len(picks[TARGETS[0]])), t.column("key").to_numpy()
        out = {}
        for to in sorted({to for to, *_ in best}):
            at = np.searchsorted(place, np.array([key for x, _, _, key in best if x == to]))
            out[TARGETS[to // 2], to % 2] = Rows(rows.found[at], rows.meta[at]), np.array([-float(side) for x, side, _, _ in best if x == to])
        return out

    return hand


def _score(model: Model):
    def run(batches):
        for batch in tk.slices(batches, "text"):
            h, b, meta = _views(batch)
            found = _found(model.vocabulary, h.view(np.int64), b)
            p = [1 / (1 + np.exp(-np.clip(model.log_odds(found, meta, t), -30, 30))) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in _READ), *map(pa.array, p)], [c for c in batch.schema.names if c not in _READ] + ["p_bad", "p_toxic"])

    return run


_READ = ("lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """Train on a bounded sample of labels(doc_id, quality, toxic) and all of docs(doc_id, text, lang, source, n_chars).
    Returns the model, and (doc_id, key, words, meta) of all docs: what it scores."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    seeds = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = docs.join(F.broadcast(seeds), "doc_id")
    features = rows.select(F.struct(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "quality", "toxic"))).alias("id"), "text", "lang", "source", "n_chars").mapInArrow(
        _features, "id struct<doc_id:long,quality:long,toxic:long>, words array<long>, meta array<double>"
    )
    rows = cut(features.select("id.*", "words", "meta")).withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(ASIDE)) == 0)
    vocabulary, picks = _content_words(rows.where("not aside"))
    t = rows.select(F.struct("doc_id", "quality", "toxic", "aside", "meta").alias("id"), "words").mapInArrow(
        _only(vocabulary), "id struct<doc_id:long,quality:long,toxic:long,aside:boolean,meta:array<double>>, words array<int>"
    )
    t = t.select("id.*", "words").orderBy("doc_id").toArrow()
    sample = Rows.of(t.column("words"), t.column("meta"), len(vocabulary))
    quality, toxic = t.column("quality").to_numpy(), t.column("toxic").to_numpy()
    every = docs.select(F.struct("doc_id", F.xxhash64(*docs.columns).alias("key")).alias("id"), "text", "lang", "source", "n_chars")
    every = every.mapInArrow(_placed(vocabulary), f"id struct<doc_id:{dict(docs.dtypes)['doc_id']},key:long>, words array<int>, meta array<double>")
    every = cut(every.select("id.*", "words", "meta"))
    hand = _hand(every, known, picks) if t.num_rows else None
    return train(sample, {"bad": (quality == 0).astype(int), "toxic": toxic}, t.column("aside").to_numpy(), vocabulary, picks, hand), every


def _lists(x: Found) -> pa.Array:
    """Each row's words."""
    at = np.searchsorted(x.row, np.arange(x.shape[0] + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(x.word.astype(np.int32)))


def _only(vocabulary: np.ndarray):
    """Each row's words by their places in the vocabulary."""

    def run(batches):
        for b in batches:
            words = b.column("words")
            bounds = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(_found(vocabulary, words.flatten().to_numpy(), bounds))], ["id", "words"])

    return run


def _content_words(seeds: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(vocabulary, picks): all words that go with a target or against it, by chi-square over the seeds, sorted; and for each target which they are."""
    marks = {"bad": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    count = lambda c: F.sum(c.cast("double"))
    total, *positive = seeds.agg(F.count("*").cast("double"), *(count(marks[t]) for t in TARGETS)).first()
    words = seeds.select(F.explode("words").alias("word"), *(marks[t].alias(t) for t in TARGETS))
    words = cut(words.groupBy("word").agg(F.count("*").cast("double").alias("n"), *(count(F.col(t)).alias(t) for t in TARGETS)).where("n >= 3"))
    picks = {}
    for t, pos in zip(TARGETS, positive, strict=True):
        a = F.col(t)  # positive rows with the word, then other rows with it, positive ones without, others without
        b, c = F.col("n") - a, F.lit(pos or 0.0) - a
        d = F.lit(total) - F.lit(pos or 0.0) - b
        chi2 = F.lit(total) * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1e-9))
        best = words.select("word", chi2.alias("chi2")).where(F.col("chi2") >= CHI2).select("word").toArrow()
        picks[t] = best.column("word").to_numpy()
    vocabulary = np.unique(np.concatenate([picks[t] for t in TARGETS]).astype(np.int64))
    return vocabulary, {t: np.isin(vocabulary, picks[t]) for t in TARGETS}


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, p_bad, p_toxic, rejected (either reaches one half).

    Null texts are empty, null metadata is a value of its own. Repeated rows each
    give a row and equal scores. A doc_id labelled more than once counts as its worst label. Without
    labels every score is one half or what the intercepts give, and nothing is
    rejected. Extra columns are not read; an empty table gives no rows.
    """
    model, features = fit(docs, labels)
    kind = dict(docs.dtypes)["doc_id"]
    scored = features.select("doc_id", "words", "meta").mapInArrow(_score_features(model), f"doc_id {kind}, p_bad double, p_toxic double")
    return scored.select("doc_id", "p_bad", "p_toxic", (F.greatest("p_bad", "p_toxic") > 0.5).alias("rejected"))


def _score_features(model: Model):
    def run(batches):
        for b in batches:
            rows = Rows.of(b.column("words"), b.column("meta"), len(model.vocabulary))
            p = [1 / (1 + np.exp(-np.clip(model.log_odds(rows.found, rows.meta, t), -30, 30))) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, p)], ["doc_id", "p_bad", "p_toxic"])

    return run


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects. Rows carry their texts, so each is scored where it is read, instead of meeting its stored features in a shuffle."""
    model, _ = fit(docs, labels)
    names = docs.columns
    read = {"text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}
    rows = docs.select(F.struct(*names).alias("row"), *(F.col(c) if c != "n_chars" else F.col(c).cast("long").alias(c) for c in read))
    kept = rows.mapInArrow(_keep(_score(model)), rows.select("row").schema)
    return kept.select("row.*")


def _keep(score):
    def run(batches):
        for b in score(batches):
            p = np.maximum(b.column("p_bad").to_numpy(), b.column("p_toxic").to_numpy())
            yield b.select(["row"]).filter(pa.array(p <= 0.5))

    return run
