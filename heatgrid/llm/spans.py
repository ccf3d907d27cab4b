"""Substring dedup by sliding spans of sentences.

A sentence ends at a word that ends in one of `.!?` (with closing quotes or brackets) or at a line break. From every
sentence starts one span: the shortest run of sentences that has ``sentences`` of them and ``min_words`` words, or else
``long_words`` words. Equal spans meet by hash over the whole corpus; the first by (document, position) stays, and each
sentence that any other one covers is removed. Kept sentences keep their bytes, with the white space before them.

Cases: null and empty texts have no sentence and stay as they are; a text that never fills a span loses nothing; rows
with a null id are left alone; rows with equal ids and texts count once; extra columns stay (names in _hg_ are
the operator's own); texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.firsts import first_seen
from heatgrid.llm.pieces import freeing
from heatgrid.llm.textops import U, Words, mix, string_parts, word_chunks

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]}"]] = True


class Sentences(NamedTuple):
    """doc: row of each sentence in the chunk; words: index of each one's first word, and the number of words at the end."""

    doc: np.ndarray
    words: np.ndarray


def sentences(w: Words) -> Sentences:
    m = len(w.hash)
    if not m:
        return Sentences(np.zeros(0, np.int64), np.zeros(1, np.int64))
    last = w.end - 1
    for _ in range(3):
        last = np.where(_CLOSE[w.data[last]] & (last > w.start), last - 1, last)
    breaks = np.r_[0, np.cumsum(w.data == 10)]
    ends = _STOP[w.data[last]]
    ends[:-1] |= (breaks[w.start[1:]] > breaks[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    ends[-1] = True
    words = np.r_[0, np.flatnonzero(ends) + 1]
    return Sentences(w.doc[words[:-1]], words)


def span_rows(w: Words, n: int, min_words: int, long_words: int) -> tuple[np.ndarray, ...]:
    """doc, first sentence within it, sentences, and two hashes of each span."""
    s = sentences(w)
    k = len(s.doc)
    first = np.searchsorted(s.doc, np.arange(w.rows))
    at = np.arange(k)
    begin = s.words[:-1]
    stop = np.minimum(np.maximum(at + n, np.searchsorted(s.words, begin + min_words)), np.searchsorted(s.words, begin + long_words))
    ok = stop <= k
    ok[ok] &= s.doc[stop[ok] - 1] == s.doc[ok]
    i, j = s.words[:-1][ok], s.words[stop[ok]]
    out = []
    with np.errstate(over="ignore"):
        for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            p = np.full(len(w.hash) + 1, base, np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
            q = np.full(len(w.hash) + 1, pow(base, -1, 1 << 64), np.uint64)
            q[0] = 1
            q = np.multiply.accumulate(q)
            sums = np.r_[U(0), np.cumsum(w.hash * p[:-1])]
            out.append(mix((sums[j] - sums[i]) * q[i] + (j - i).astype(np.uint64)))
    return s.doc[ok], (at - first[s.doc])[ok], (stop - at)[ok], *out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3, min_words: int = 8, long_words: int = 25) -> DataFrame:
    """(_id, _text_hash, _spans array<long>) of each document with repeated spans that aren't the first; a span is 256 * first sentence + sentences."""
    kind = docs.schema[id_col].dataType.simpleString()

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_chunks(b.column(2)):
                doc, at, n, h1, h2 = span_rows(w, sentences, min_words, long_words)
                rows = pa.array(doc + w.first)
                yield pa.RecordBatch.from_pydict({"_id": b.column(0).take(rows), "_text_hash": b.column(1).take(rows), "span": pa.array(at * 256 + n), "h1": pa.array(h1.view(np.int64)), "h2": pa.array((h2 >> U(32)).astype(np.uint32).view(np.int32))})

    if min_words > 255 or sentences > 255:
        raise ValueError("a span has at most 255 sentences")
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))
    spans = source.mapInArrow(run, f"_id {kind}, _text_hash bigint, span bigint, h1 bigint, h2 int")
    seen = first_seen(spans, ["h1", "h2"], ["_id", "_text_hash", "span"], ranged=False)
    later = seen.where((F.col("_id") != F.col("_first._id")) | (F.col("_text_hash") != F.col("_first._text_hash")) | (F.col("span") != F.col("_first.span")))
    return later.groupBy("_id", "_text_hash").agg(F.collect_set("span").alias("_spans"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(all columns, ``_hg_sentences``, ``_hg_removed``) with ``text_col`` less the sentences that spans cover, or its sha256 if ``digest``."""
    found = spans.select(F.col("_id").alias("_hg_id"), F.col("_text_hash").alias("_hg_hash"), F.col("_spans").alias("_hg_spans"))
    joined = docs.withColumn("_hg_text", F.xxhash64(text_col)).join(found.hint("merge"), (F.col(id_col) == F.col("_hg_id")) & (F.col("_hg_text") == F.col("_hg_hash")), "left")
    joined = joined.select(*docs.columns, "_hg_spans")
    at, at_spans = docs.columns.index(text_col), len(docs.columns)
    out = docs.columns + ["_hg_sentences", "_hg_removed"]

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, spans_of = b.column(at), b.column(at_spans)
            data, offsets = string_parts(text)
            kept: list[bytes | None] = []
            total, removed = [], []
            for w in word_chunks(text):
                s = sentences_of(w)
                bounds = np.searchsorted(s.doc, np.arange(w.rows + 1))
                for r in range(w.rows):
                    row = w.first + r
                    n = int(bounds[r + 1] - bounds[r])
                    whole = data[offsets[row] : offsets[row + 1]]
                    out_row, gone = whole.tobytes(), 0
                    if spans_of[row].is_valid:
                        cover = np.zeros(n + 1, np.int64)
                        x = np.array(spans_of[row].as_py())
                        np.add.at(cover, x >> 8, 1)
                        np.add.at(cover, np.minimum(n, (x >> 8) + (x & 255)), -1)
                        drop = np.cumsum(cover[:n]) > 0
                        gone = int(drop.sum())
                        words = s.words[bounds[r] : bounds[r + 1] + 1]
                        cuts = np.r_[0, w.end[words[1:] - 1] - w.offsets[r]]
                        cuts[-1] = len(whole)
                        out_row = b"".join(out_row[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(~drop))
                    kept.append(out_row if text[row].is_valid else None)
                    total.append(n)
                    removed.append(gone)
            new = pa.array([hashlib.sha256(x or b"").hexdigest() for x in kept] if digest else [None if x is None else x.decode("utf-8", "replace") for x in kept], pa.string())
            cols = [new if i == at else b.column(i) for i in range(at_spans)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{schema}, _hg_sentences bigint, _hg_removed bigint")


sentences_of = sentences


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3, min_words: int = 8, long_words: int = 25) -> DataFrame:
    """The documents without sentences that a repeated span, not its first place, covers."""
    return remove_spans(docs, repeated_spans(docs, id_col, text_col, sentences, min_words, long_words), id_col, text_col).select(*docs.columns)
