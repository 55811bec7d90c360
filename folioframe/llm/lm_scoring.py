"""Operator 10: language-model scoring by context-tree weighting.

Bytes are decomposed into eight binary decisions. Every decision in every context of 0 to DEPTH
preceding bytes has Krichevsky-Trofimov counts; the weighting mixes, at each
context, its own estimate with that of its longer contexts, half and half a
priori, so all depths are mixed by how well they code the training texts. Counts
come from all training texts. The trained tree is then fixed: scoring a text
multiplies its mixtures' predictions. A context that training never saw is left
to the deepest one seen.

The tree holds every gram of DEPTH + 1 bytes. It is built where the grams lie: all that share a
context of LOCAL bytes meet in one task, which weights their contexts of LOCAL and more bytes; the shorter contexts,
at most 256 ** LOCAL binary nodes, are weighted on the driver from the tasks' sums. The tasks then
give each gram its log probability. One more pass scores the texts: the most
frequent grams, at most HEAD_GRAMS, are looked up in each task, and all others of a text are
written beside its sums and meet theirs in a shuffled join. The base's words go the same way.

The base is an add-0.1 unigram model over all training tokens. Its most frequent words, at most HEAD,
are looked up; of the others each is at most a share 1/HEAD of the tokens, or about so, as counts are told apart by sixteenths of powers of two.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk
from folioframe.llm.shared import cut

DEPTH = 5
HEAD = 1 << 18
#: Grams that are looked up in each task, at most: 16 bytes each. The others are joined.
HEAD_GRAMS = 1 << 20
#: Keys that are looked up at once, to keep the worker small.
AT_ONCE = 1 << 18
#: Contexts of so many bytes, and all that are longer, are weighted in tasks.
LOCAL = 3
#: Grams of such contexts that are weighted at once; those of a single context always are.
CHUNK = 1 << 18
#: The end token's place among the word hashes.
END = 1
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 10, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def byte_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, bounds): each text's bytes and a closing 0, each after the DEPTH bytes before it (0 before the text)."""
    n, lens = len(off) - 1, np.diff(off)
    flat = np.zeros(len(data) + n * (DEPTH + 1), np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, lens)] = data
    bounds = np.concatenate([[0], np.cumsum(lens + 1)])
    at = np.arange(bounds[-1]) + np.repeat(np.arange(n) * DEPTH, lens + 1)  # where the gram's context begins
    gram = np.zeros(len(at), np.int64)
    for j in range(DEPTH + 1):
        gram = (gram << 8) | flat[at + j]
    return gram, bounds


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _count(batches):
    """(kind, key, n): word counts (kind 0) and byte-gram counts (kind 1), summed within the task; texts held out only name their grams, with 0."""
    held: list[list] = [[], []]

    def batch(kind: int) -> pa.RecordBatch:
        key, n = _merged(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), tk.long(key.astype(np.uint64)), pa.array(n)], ["kind", "key", "n"])

    for b in tk.slices(batches, "text"):
        out = b.column("out")
        for part, times in ((b.filter(pc.invert(out)), 1), (b.filter(out), 0)):
            if not part.num_rows:
                continue
            w = tk.words(part.column("text"))
            for kind, x in ((0, w.hashes), (1, byte_grams(w.data, w.text_bounds)[0])):
                if kind or times:
                    key, n = np.unique(x, return_counts=True)
                    held[kind].append((key, n.astype(np.int64) * times))
            if times:
                held[0].append((np.array([END], np.uint64), np.array([part.num_rows], np.int64)))
        for kind in (0, 1):
            if sum(len(k) for k, _ in held[kind]) > 1 << 20:
                held[kind] = [_merged(held[kind])]
                if len(held[kind][0][0]) > 1 << 19:
                    yield batch(kind)
    for kind in (0, 1):
        if held[kind]:
            yield batch(kind)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function of numbers of at least 0.5, by Stirling's series after a shift to at least 10."""
    shift = np.ones(len(x))
    low = np.flatnonzero(x < 10)
    y = x.astype(float)
    for _ in range(10):
        low = low[y[low] < 10]
        if not len(low):
            break
        shift[low] *= y[low]
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _level(by_depth: list[tuple[np.ndarray, np.ndarray]], level: int, depths: range, longer=None):
    """(nodes, longer): the binary nodes of one bit level (context, then a 1 and the byte's first `level` bits; sorted) at each
    of the depths, shortest first, with their estimate of a one and its weight against the longer contexts';
    and the nodes' weighted log probabilities, under the names they have one byte shorter. `longer` is that of the depth beyond."""
    out = []
    for d in reversed(depths):
        key, n = by_depth[d]
        node, bit = (key >> 8 << 8) | (1 << level) | ((key & 255) >> (8 - level)), (key >> (7 - level)) & 1
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))  # sorted, as the keys are
        own, n0, n1 = node[first], np.add.reduceat(n * (1 - bit), first), np.add.reduceat(n * bit, first)
        total = kt = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - 2 * math.lgamma(0.5)
        weight = np.ones(len(own))
        if longer is not None:
            total = np.logaddexp(kt, np.bincount(np.searchsorted(own, longer[0]), longer[1], len(own))) + math.log(0.5)
            weight = np.exp(math.log(0.5) + kt - total)
        out.append((own, (n1 + 0.5) / (n0 + n1 + 1), weight))
        longer = (_shorter(own, d - 1), total)
    return out[::-1], longer


def _shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """A node or gram with the last `depth` bytes of its context alone."""
    return ((key >> 8) & ((1 << (8 * max(depth, 0))) - 1)) << 8 | (key & 255)


def _descend(nodes: list, start: int, level: int, gram: np.ndarray, state: tuple) -> None:
    """Mix the depths from `start` on into state (spent, rest, one); `rest` is the weight not yet settled, and goes to the deepest node seen."""
    spent, rest, one = state
    at_level = (1 << level) | ((gram & 255) >> (8 - level))
    for d, (own, p1, weight) in enumerate(nodes, start):
        want = _shorter(gram, d) >> 8 << 8 | at_level
        at = np.minimum(np.searchsorted(own, want), len(own) - 1)
        live = np.flatnonzero(own[at] == want)
        if not len(live):
            break  # nor is any longer context seen
        at = at[live]
        one[live] = spent[live] + rest[live] * p1[at]
        spent[live] += rest[live] * weight[at] * p1[at]
        rest[live] *= 1 - weight[at]


class Branch:
    """All contexts of LOCAL and more bytes of the given grams (distinct, with counts; those of count 0 are not of the tree)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        key, n = grams[seen], counts[seen]
        self.by_depth = [_merged([(_shorter(key, d), n)]) if len(key) and d >= LOCAL - 1 else None for d in range(DEPTH + 1)]
        self.empty = not len(key)

    def level(self, level: int):
        return _level(self.by_depth, level, range(LOCAL, DEPTH + 1))

    def sums(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The counts of the grams of LOCAL bytes, and for each node of LOCAL - 1 bytes the sum of its longer contexts' log probabilities."""
        return self.by_depth[LOCAL - 1], _merged([self.level(level)[1] for level in range(8)])


class Top:
    """The contexts of less than LOCAL bytes, from the sums of all branches."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, nodes: np.ndarray, values: np.ndarray):
        by_depth = [_merged([(_shorter(grams, d), counts)]) for d in range(LOCAL)]
        name = nodes & 255
        self.nodes = []
        for level in range(8):
            mine = (name >> level) == 1
            self.nodes.append(_level(by_depth, level, range(LOCAL), (nodes[mine], values[mine]))[0])

    def log_probability(self, gram: np.ndarray, branch: Branch) -> np.ndarray:
        """Natural log of the probability of each gram's last byte after its other bytes; the branch must hold all that share its context."""
        out = np.zeros(len(gram))
        short, back = np.unique(_shorter(gram, LOCAL - 1), return_inverse=True)
        for level in range(8):
            state = (np.zeros(len(short)), np.ones(len(short)), np.full(len(short), 0.5))
            _descend(self.nodes[level], 0, level, short, state)
            state = tuple(x[back] for x in state)
            if not branch.empty:
                _descend(branch.level(level)[0], LOCAL, level, gram, state)
            one = np.clip(state[2], 1e-12, 1 - 1e-12)
            out += np.log(np.where((gram >> (7 - level)) & 1 == 1, one, 1 - one))
        return out


class Tree:
    """The whole tree in one place; log_probability gives that (natural) of a gram's last byte after its other bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.branch = Branch(grams, counts)
        short, nodes = self.branch.sums()
        self.top = Top(*short, *nodes)

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        return self.top.log_probability(gram, self.branch)


def _chunks(batches):
    """The grams and counts, which come by their contexts of LOCAL bytes, about CHUNK at once, those of a context together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        held.append((b.column("key").to_numpy(), b.column("n").to_numpy()))
        while sum(len(k) for k, _ in held) >= CHUNK:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            context = _shorter(key, LOCAL) >> 8
            edges = np.flatnonzero(context[1:] != context[:-1]) + 1
            if not len(edges):
                held = [(key, n)]
                break  # one context so far
            to = int(edges[max(np.searchsorted(edges, CHUNK, side="right") - 1, 0)])
            yield key[:to], n[:to]
            held = [(key[to:], n[to:])]
    if held:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(key):
            yield key, n


def _sums(batches):
    """(kind, key, n, value): counts of short grams (kind 0) and sums for the nodes above the branches (kind 1), of each task."""
    held: tuple[list, list] = ([], [])
    for key, n in _chunks(batches):
        branch = Branch(key, n)
        if not branch.empty:
            for kind, x in enumerate(branch.sums()):
                held[kind].append(x)
                held[kind][:] = [_merged(held[kind])]
    for kind in (0, 1):
        if held[kind]:
            key, x = held[kind][0]
            n, value = (x, np.zeros(len(key))) if kind == 0 else (np.zeros(len(key), np.int64), x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n), pa.array(value)], ["kind", "key", "n", "value"])


def _logs(top):
    """(key, n, v): the natural log probability of each gram."""

    def run(batches):
        for key, n in _chunks(batches):
            v = top.value.log_probability(key, Branch(key, n))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(v)], ["key", "n", "v"])

    return run


class Lookup:
    """The values of keys, by open addressing over whole arrays; keys are distinct."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(1, 2 * len(keys) - 1).bit_length()) - 1
        self.keys, self.values, self.used = np.zeros(self.mask + 1, keys.dtype), np.zeros(self.mask + 1), np.zeros(self.mask + 1, bool)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = ~self.used[at]
            self.keys[at[free]] = keys[left[free]]  # of those that meet, one stays
            self.used[at[free]] = True
            own = free & (self.keys[at] == keys[left])
            self.values[at[own]] = values[left[own]]
            left, at = left[~own], (at[~own] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix(keys.view(np.uint64)) & _U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, 0 without one, and whether it has one."""
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for a in range(0, len(keys), AT_ONCE):
            self._some(keys[a : a + AT_ONCE], out[a : a + AT_ONCE], hit[a : a + AT_ONCE])
        return out, hit

    def _some(self, keys: np.ndarray, out: np.ndarray, hit: np.ndarray) -> None:
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            own = self.keys[at] == keys[left]
            own &= self.used[at]
            out[left[own]] = self.values[at[own]]
            hit[left[own]] = True
            on = np.flatnonzero(~own & self.used[at])
            left, at = left[on], (at[on] + 1) & self.mask


def _counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct keys, in order of the texts, with their counts."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(doc)))


def _score(grams, words):
    """Per text: tokens, known tokens and base log sum over the frequent words, natural log probability over the frequent grams, bytes,
    and the other words (kind 0) and grams (kind 1), which a task can't look up."""

    def run(batches):
        by_word, by_gram = Lookup(*words.value), None if grams is None else Lookup(*grams.value)
        for b in tk.slices(batches, "text"):
            n = b.num_rows
            w = tk.words(b.column("text"))
            doc = np.repeat(np.arange(n), np.diff(w.bounds))
            v, hit = by_word.find(w.hashes)
            known, base = np.bincount(doc[hit], minlength=n), np.bincount(doc, v, n)
            rare = [_counted(doc[~hit], w.hashes[~hit].view(np.int64))]
            if by_gram is None:
                score = (np.diff(w.text_bounds) + 1) * math.log(1 / 256)
            else:
                gram, bounds = byte_grams(w.data, w.text_bounds)
                v, hit = by_gram.find(gram)
                score = np.add.reduceat(v, bounds[:-1])
                miss = np.flatnonzero(~hit)
                rare.append(_counted(np.searchsorted(bounds, miss, side="right") - 1, gram[miss]))
            kind = np.repeat(np.arange(len(rare), dtype=np.int8), [len(x[0]) for x in rare])
            doc, key, times = (np.concatenate(x) for x in zip(*rare, strict=True))
            order = np.argsort(doc, kind="stable")
            at = pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (kind, key, times.astype(np.int32))]
            columns = [(np.diff(w.bounds) + 1).astype(np.int64), known.astype(np.int64), base.astype(float), score, np.diff(w.text_bounds).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, columns), *lists], ["id", "n_tokens", "known", "base", "score", "n_bytes", "kinds", "words", "times"])

    return run


_SCORED = "n_tokens long, known long, base double, score double, n_bytes long, kinds array<byte>, words array<long>, times array<int>"


def _gram_logs(grams: DataFrame) -> DataFrame | None:
    """(key, n, v): the log probability of every gram of grams(key, n), n its training count; None without training."""
    context = F.expr(f"shiftright(key, 8) & {(1 << (8 * LOCAL)) - 1}")
    dealt = cut(grams.repartition(context).sortWithinPartitions(context, "key"))  # dealt and sorted once, read as a stream twice
    sums = cut(dealt.mapInArrow(_sums, "kind byte, key long, n long, value double").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("value").alias("value")))
    short = sums.where("kind = 0").orderBy("key").toArrow()
    if not short.num_rows:
        return None
    nodes = sums.where("kind = 1").orderBy("key").toArrow()
    column = lambda t, c: t.column(c).to_numpy()
    top = grams.sparkSession.sparkContext.broadcast(Top(column(short, "key"), column(short, "n"), column(nodes, "key"), column(nodes, "value")))
    return cut(dealt.mapInArrow(_logs(top), "key long, n long, v double"))


def _frequent(counts: DataFrame, n: str, most: int) -> Column:
    """A condition that at most so many of the rows meet: a count n from some sixteenth of a power of two on."""
    step = F.floor(F.log2(F.col(n) + 1) * 16)
    least, left = None, most
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    return F.lit(False) if least is None else step >= least


def _sent(rows: DataFrame, key: str, value: str, dtype: type):
    """A broadcast of the rows' keys and values."""
    t = rows.select(key, value).toArrow()
    return rows.sparkSession.sparkContext.broadcast((t.column(key).to_numpy().view(dtype), t.column(value).to_numpy()))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens (its end included), n_known,
    train_tokens, base_score, score (the model's log10 probability of the lower-cased bytes
    and the end), bits_per_byte (null for an empty text).

    Learns from the rows that are not held out. Null texts are empty: they
    still have an end. Repeated rows each give a row, and each counts in training.
    Very long texts are read whole. Without training rows the model gives every byte 1/256 and every token the
    same share. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = base.select("text", held_out(F.col("id")).alias("out")).mapInArrow(_count, "kind byte, key long, n long")
    counted = cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counted.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = words.where(F.col("word") == END).agg(F.max("c")).first()[0] or 0
    words = words.where(F.col("word") != END).withColumn("v", F.log10(F.col("c") + 0.1))
    head = _frequent(words, "c", HEAD)
    logs, grams = _gram_logs(counted.where("kind = 1").select("key", "n")), None
    rest = words.where(~head).select(F.lit(0).cast("byte").alias("kind"), "word", "v")
    if logs is not None:
        frequent = _frequent(logs, "n", HEAD_GRAMS)
        grams = _sent(logs.where(frequent), "key", "v", np.int64)
        rest = rest.unionByName(logs.where(~frequent).select(F.lit(1).cast("byte").alias("kind"), F.col("key").alias("word"), "v"))

    scored = base.mapInArrow(_score(grams, _sent(words.where(head), "word", "v", np.uint64)), f"id {kind}, {_SCORED}")
    scored = cut(scored.withColumn("key", F.monotonically_increasing_id()))  # written once, so the keys stay
    tail = scored.select("key", F.explode(F.arrays_zip("kinds", "words", "times")).alias("x"))
    tail = tail.select("key", F.col("x.kinds").alias("kind"), F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    word = F.col("kind") == 0
    tail = tail.join(rest, ["kind", "word"], "left").groupBy("key").agg(
        F.sum(F.when(word & F.col("v").isNotNull(), F.col("n"))).alias("more"),
        F.sum(F.when(word, F.col("n") * F.coalesce("v", F.lit(-1.0)))).alias("logs"),
        F.sum(F.when(~word, F.col("n") * F.col("v"))).alias("rest"),
    )
    out = scored.drop("kinds", "words", "times").join(tail, "key", "left").withColumn("score", (F.col("score") + F.coalesce("rest", F.lit(0.0))) / F.lit(math.log(10)))
    each = math.log10(total + 0.1 * (distinct + 1))
    end_log = math.log10(ends + 0.1)
    return out.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
