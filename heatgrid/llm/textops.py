"""Vectorised word hashing over Arrow string columns, shared by the operators of this subpackage.

Words are maximal runs of bytes outside a separator set, so whole texts are handled as UTF-8 bytes without
decoding. A word's identity is a 64-bit hash (a random-table polynomial modulo 2**64, then mixed with its length).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

#: `[\x20\x09-\x0D]`
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: everything but ASCII letters, digits and bytes of other scripts
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x80:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NON_ALNUM[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["p"]) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[key] = np.multiply.accumulate(x)
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words(NamedTuple):
    """first: index of the chunk's first row; rows: its number of rows; doc: row of each word, from 0; start, end: its bytes in data."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix(((prefix[end] - prefix[start]) * inv[start]) ^ ((end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def word_chunks(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Iterator[Words]:
    data, offsets = string_parts(column)
    for i, j in chunks(offsets):
        base, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            base = LOWER[base]
        inside = np.zeros(len(base) + 1, bool)
        inside[:-1] = ~separators[base]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = off[:-1][off[:-1] < len(base)]
        begins[cut] = inside[cut]
        start = np.flatnonzero(begins)
        stops = ~inside
        stops[cut] = True
        stop = np.flatnonzero(stops)
        end = stop[np.searchsorted(stop, start, "right")] if len(start) else start
        doc = np.searchsorted(off, start, "right") - 1
        yield Words(i, j - i, base, off, doc, start, end, span_hash(byte_prefix(base), start, end))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each n-word run; a text of 1 to n-1 words has one run, all its words."""
    m = len(w.hash)
    if not m:
        return w.doc, w.hash
    with np.errstate(over="ignore"):
        k = max(0, m - n + 1)
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h = h * U(0x9FB21C651E98DF25) + w.hash[i : i + k]
        full = w.doc[:k] == w.doc[n - 1 :]
        doc, h = w.doc[:k][full], mix(h[full])
        firsts = np.flatnonzero(np.r_[True, w.doc[1:] != w.doc[:-1]])
        counts = np.diff(np.r_[firsts, m])
        short = counts < n
        if short.any():
            extra = np.zeros(short.sum(), np.uint64)
            for i in range(n - 1):
                at = firsts[short] + i
                ok = i < counts[short]
                extra = np.where(ok, extra * U(0x9FB21C651E98DF25) + w.hash[np.minimum(at, m - 1)], extra)
            doc = np.r_[doc, w.doc[firsts[short]]]
            h = np.r_[h, mix(extra ^ counts[short].astype(np.uint64))]
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
    return doc, h


def seeded(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | U(1)
