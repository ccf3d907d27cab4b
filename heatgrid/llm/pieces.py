"""Texts cut into pieces that byte-level BPE encodes independently, each different piece of a slice encoded once."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from heatgrid.llm.textops import string_parts

#: Unicode white space in UTF-8, by its last byte after the first ones; a cut before a run of it, after something else,
#: never splits a match of the pattern
WHITE1 = np.zeros(256, bool)
WHITE1[[9, 10, 11, 12, 13, 32]] = True
WHITE2 = {0xC2: (0x85, 0xA0)}
WHITE3 = {(0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
#: a run of these after a letter or number, at a piece's end, is one match of the pattern
MARKS = ".,;:!?*&%$#|"
LEARN_PIECES = 20_000


def white(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to white space."""
    out = WHITE1[data]
    for lead, last in WHITE2.items():
        at = np.flatnonzero(data[:-1] == lead)
        at = at[np.isin(data[at + 1], last)]
        out[at] = out[at + 1] = True
    for (lead, second), last in WHITE3.items():
        at = np.flatnonzero(data[:-2] == lead)
        at = at[(data[at + 1] == second)]
        at = at[np.isin(data[at + 2], last)]
        out[at] = out[at + 1] = out[at + 2] = True
    return out


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a string column, and how many each row has."""
    data, offsets = string_parts(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        blank = white(data)
        begins[1:-1] = blank[1:] & ~blank[:-1]
        begins[offsets] = True
    begins[len(data)] = True
    starts = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.diff(np.searchsorted(starts, offsets))


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class PieceEncoder:
    """``encode`` cuts texts into pieces, gives ``learn`` those that are new and joins the ids of each text's pieces.

    Marks at the end of a piece are encoded apart from it. The pieces of earlier slices are remembered up to ``known_bytes``;
    beyond that only those of the last slice stay, so memory is bounded by that number and a slice.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], known_bytes: int):
        """learn: all ids (unsigned 32-bit) of pieces, one after another, and how many each has."""
        self.learn, self.known_bytes = learn, known_bytes
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of different pieces in ``known``; new ones are learned."""
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            learned = pieces.take(pa.array(new))
            parts = [self.learn(learned.slice(i, LEARN_PIECES).to_pylist()) for i in range(0, len(new), LEARN_PIECES)]
            self.known = pa.concat_arrays([self.known, learned])
            self.ids = np.concatenate([self.ids, *[x for x, _ in parts]])
            self.counts = np.concatenate([self.counts, *[n for _, n in parts]])
        return at

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different pieces, and how many each has."""
        base = pc.utf8_rtrim(pieces, MARKS)
        data, offsets = string_parts(pieces)
        short = offsets[1:] - offsets[:-1] - pc.binary_length(base).to_numpy()
        marked = (short > 0) & pc.utf8_is_alnum(pc.utf8_slice_codeunits(base, -1)).to_numpy(zero_copy_only=False)
        short = short[marked]
        ends = pa.py_buffer(np.ascontiguousarray(data[ranges(offsets[1:][marked] - short, short)]))
        marks = pa.Array.from_buffers(pa.large_string(), len(short), [None, pa.py_buffer(np.r_[0, np.cumsum(short)].astype(np.int64)), ends])
        coded = pa.concat_arrays([pc.if_else(pa.array(marked), base, pieces), marks]).dictionary_encode()
        at = self._places(coded.dictionary)
        if self.known.nbytes + self.ids.nbytes + self.counts.nbytes > self.known_bytes:
            first = np.cumsum(self.counts) - self.counts
            self.known, self.ids, self.counts = self.known.take(pa.array(at)), self.ids[ranges(first[at], self.counts[at])], self.counts[at]
            at = np.arange(len(at))
        at = at[coded.indices.to_numpy()]
        two = np.full((len(pieces), 2), -1)
        two[:, 0], two[marked, 1] = at[: len(pieces)], at[len(pieces) :]
        first = np.cumsum(self.counts) - self.counts
        n = np.where(two < 0, 0, self.counts[two])
        return self.ids[ranges(first[two].ravel(), n.ravel())], n.sum(1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order (unsigned 32-bit), and the number of ids of each row; null counts as empty."""
        pieces, n_pieces = cut(column)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        coded = pieces.dictionary_encode()
        flat, counts = self._encoded(coded.dictionary)
        index = coded.indices.to_numpy()
        n = counts[index]
        out = flat[ranges((np.cumsum(counts) - counts)[index], n)]
        return out, np.diff(np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(n_pieces)]])


def text_slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with ``release`` at the end of each partition."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give memory that a finished partition used back to the system; the Python worker may serve other stages next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
