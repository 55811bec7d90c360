"""Operator 2: license scans.

Texts are cut into overlapping windows, sized to the templates: templates of at
most s shingles (s a power of GROWTH) are sought in windows of 2 s shingles, one
beginning every s, so an occurrence lies whole in some window. A window retrieves a template
if any of its one-row MinHash bands agree. A window of 2 s shingles that contains a share t of
a template of n has a Jaccard similarity of at least t n / (2 s + (1 - t) n); there are as many bands
as it takes for such a window to miss its template with a probability below MISS, whatever t and
the templates are. Retrieved templates are verified by exact shingle containment.
A window that holds a template several times gives several places: one ends where a
shingle comes more often than the template has it. Of places of a template that overlap,
as those of neighbouring windows do, the fullest stays.

Two MinHash values agree only on a shingle of the template, so windows without
any template's shingle are not signed.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import textkit as tk

GROWTH = 1.3
MISS = 1e-6
WORDS = 5
# License notices and headers, as their publishers word them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
_U = np.uint64


def library() -> dict[str, str]:
    """TEMPLATES, and the texts and notices of licenses.txt."""
    found, name = dict(TEMPLATES), None
    for line in resources.files("folioframe.llm").joinpath("licenses.txt").read_text().splitlines():
        if line.startswith("== "):
            name = line[3:]
            found[name] = ""
        elif name:
            found[name] += line + "\n"
    return found


def plain(texts: pa.Array) -> pa.Array:
    """ASCII punctuation becomes space, byte for byte."""
    raw, off = tk.text_bytes(texts)
    table = np.arange(256, dtype=np.uint8)
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        table[a:b] = 32
    # the bytes stay valid UTF-8, as only ASCII ones change
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(table[raw].tobytes()))


def bands(t: float, n: int, size: int) -> int:
    """Bands for templates of n shingles in windows of 2 size, by the bound above."""
    least = min(t * n / (2 * size + (1 - t) * n), 0.999)
    return math.ceil(math.log(MISS) / math.log(1 - least))


class Library:
    def __init__(self, templates: dict[str, str], k: int, num: int, den: int):
        self.num, self.den = num, den
        self.names = list(templates)
        h, b = tk.shingles(tk.words(plain(pa.array(templates.values(), pa.string()))), k)
        self.sets = [np.unique(h[b[i] : b[i + 1]]) for i in range(len(self.names))]
        self.counts = [Counter(h[b[i] : b[i + 1]].tolist()) for i in range(len(self.names))]
        self.universe = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                top = math.ceil(GROWTH ** math.ceil(math.log(b[i + 1] - b[i]) / math.log(GROWTH) - 1e-9))
                self.classes.setdefault(max(1, top), []).append(i)
        count = max((bands(num / den, len(self.sets[i]), size) for size, members in self.classes.items() for i in members), default=1)
        self.seeds = tk.mix(np.arange(1, count + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        self.signs = [self.sign(s) if len(s) else None for s in self.sets]

    def sign(self, h: np.ndarray) -> np.ndarray:
        return tk.mix(h[None, :] ^ self.seeds[:, None]).min(axis=1)

    def places(self, window: np.ndarray, t: int) -> list[tuple[int, int, int]]:
        """(shared, first, last) of each place of a window where the template stands; the whole window where none does by itself, but all together."""
        need = self.num * len(self.sets[t])
        at = np.flatnonzero(np.isin(window, self.sets[t]))
        if len(np.unique(window[at])) * self.den < need:
            return []
        found, seen, first = [], Counter(), 0
        for i, h in enumerate([*window[at].tolist(), None]):
            if h is None or seen[h] == self.counts[t][h]:
                if len(seen) * self.den >= need:
                    found.append((len(seen), int(at[first]), int(at[i - 1])))
                seen, first = Counter(), i
            if h is not None:
                seen[h] += 1
        return found or [(len(np.unique(window[at])), int(at[0]), int(at[-1]))]

    def find(self, h: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, int]]:
        """For a text's shingles and the positions of those in the universe: (template, shared, first, last) of all places, none of which overlaps another of its template."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for size, members in self.classes.items():
            for start in np.unique(np.concatenate([hits // size, np.maximum(hits // size - 1, 0)])) * size:
                window = h[start : start + 2 * size]
                sign = self.sign(window)
                for t in members:
                    if (sign == self.signs[t]).any():
                        found.setdefault(t, set()).update((-n, int(start) + a, int(start) + b) for n, a, b in self.places(window, t))
        out = []
        for t, places in found.items():
            taken: list[tuple[int, int]] = []  # by their beginnings
            for n, a, b in sorted(places):
                i = bisect_left(taken, (a, b))
                if (i == 0 or taken[i - 1][1] < a) and (i == len(taken) or b < taken[i][0]):
                    taken.insert(i, (a, b))
                    out.append((t, -n, a, b))
        return out


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, k: int = WORDS, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per text, template (library() where none are given) and place where the text holds num / den of it or more, within one window:
    id_col, license, n_shared and n_template (distinct k-word shingles), start_word and
    end_word (exclusive; words as split at white space and ASCII punctuation).

    Case and ASCII punctuation are ignored. A template of fewer than k words is one shingle and matches
    only texts that consist of it. Null and empty texts match nothing. Repeated
    rows each give their rows; of equally full places that overlap the first counts. Very long texts are read whole, their time grows with the windows that hold a template's shingle. Templates
    travel to the tasks: they are a parameter, not data. Extra columns are not read. num / den lies above 0 and at most at 1.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must lie above 0 and at most at 1")
    known = library() if templates is None else templates
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        lib = Library(known, k, num, den)
        for b in tk.slices(batches, "text"):
            w = tk.words(plain(b.column("text")))
            h, bounds = tk.shingles(w, k)
            at = np.minimum(np.searchsorted(lib.universe, h), max(0, len(lib.universe) - 1))
            where = np.flatnonzero(lib.universe[at] == h) if len(lib.universe) else np.zeros(0, np.int64)
            rows, out = [], []
            ends = np.searchsorted(where, bounds)
            for i in np.flatnonzero(np.diff(ends)):
                found = lib.find(h[bounds[i] : bounds[i + 1]], where[ends[i] : ends[i + 1]] - bounds[i])
                words = int(w.bounds[i + 1] - w.bounds[i])
                for t, n, first, last in sorted(found, key=lambda x: (x[0], x[2])):
                    rows.append(i)
                    out.append((lib.names[t], n, len(lib.sets[t]), first, min(last + k, words)))
            if out:
                cols = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), *cols], ["id", "license", "n_shared", "n_template", "start_word", "end_word"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, license string, n_shared long, n_template long, start_word long, end_word long"
    )
    return found.withColumnRenamed("id", id_col)
