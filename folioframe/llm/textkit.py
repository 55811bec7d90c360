"""Vectorised words and word shingles for Arrow batches of texts.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are
lower-cased, so every other code point keeps its bytes. Words and shingles are
carried as 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer single text is handled whole.
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


@dataclass
class Words:
    """Words of a slice of texts; document i owns words bounds[i]:bounds[i + 1]."""

    data: np.ndarray  # lower-cased bytes of all texts
    text_bounds: np.ndarray  # byte offsets of the texts
    starts: np.ndarray  # byte offsets of the words
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string array; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(texts: pa.Array) -> Words:
    raw, off = text_bytes(texts)
    n = len(raw)
    data = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, raw, out=data[:n])
    space = _SPACE[raw]
    before = np.ones(n + 1, bool)
    before[1:] = space
    before[off] = True  # a text begins after each offset ...
    after = np.ones(n + 1, bool)
    after[:-1] = space
    after[off] = True  # ... and ends before it
    solid = ~space
    starts = np.flatnonzero(solid & before[:-1])
    ends = np.flatnonzero(solid & after[1:]) + 1
    return Words(data[:n], off, starts, ends, np.searchsorted(starts, off), _hash(data, starts, ends - starts))


def _hash(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """data must have 8 spare bytes at its end."""
    view = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:8].view("<u8"), (max(len(data) - 7, 1),), (1,))
    h = lens.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    live, at, left = None, starts, lens
    while len(at):
        x = mix((view[at] & _KEEP[np.minimum(left, 8)]) + (h if live is None else h[live]) * _U(0xD6E8FEB86659FD93))
        if live is None:
            h = x
        else:
            h[live] = x
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the k-word shingles in text order.

    A text with fewer than k words, but some, has its whole sequence as one."""
    nw = np.diff(w.bounds)
    count = np.where(nw >= k, nw - k + 1, np.minimum(nw, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    h, total = w.hashes, len(w.hashes)
    full = np.full(total, k, dtype=_U)
    for j in range(min(k, total)):
        full[: total - j] += mix(h[j:] + _U(j + 1))
    first = np.repeat(w.bounds[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    out = mix(full[first])
    for i in np.flatnonzero((nw > 0) & (nw < k)):
        a, b = w.bounds[i], w.bounds[i + 1]
        s = np.arange(1, b - a + 1, dtype=_U)
        out[bounds[i]] = mix(np.array([mix(h[a:b] + s).sum(dtype=_U) + _U(b - a)], dtype=_U))[0]
    return out, bounds


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give back to the system what a task has freed; the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def long(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
