"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Each text's set of n-word shingles gives band hashes (``banding`` chooses bands and rows for the target recall at the
   threshold), a set digest and its size. Texts of equal sets are one class; its smallest id stands for it.
2. Band hashes are dealt out; buckets with one class go. Larger ones become pairs of bounded blocks. A pair of classes
   counts in the first band that they share, so a class goes on only to the blocks where it has such a partner.
3. The texts of these classes join, and each pair of blocks compares full shingle sets exactly. It returns, for each
   class, the documents linked to it, and star edges that keep components; never the pairs, so a large group of near
   copies costs rows in proportion to its blocks.

Words are runs outside `[\\x20\\x09-\\x0D]`, as they stand; a shingle's identity is a 64-bit hash, a set's 128 bits.
Cases: null and empty texts have no shingle and no link; a text of fewer than n words has one shingle, all its words;
equal texts are linked; rows with a null id are left out; rows with equal ids are one document, which has the text of
the smallest set digest among theirs, and each of these rows gets its result; extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.blocks import block_pairs, groups, matrix, once, spanning
from heatgrid.llm.components import components
from heatgrid.llm.pieces import freeing
from heatgrid.llm.store import remove, repeated, written
from heatgrid.llm.textops import U, mix, ngrams, seeded, word_chunks

BLOCK_ROWS = 256
COLUMNS = 4096


def banding(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, as many as the recall at the threshold takes, stay within ``max_hashes``."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return doc[keep], h[keep]


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, size, s1, s2, bands array<long>) of each row whose text has a shingle; th: a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    xor, mul = seeded(bands * rows, 71), seeded(bands * rows, 72)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_chunks(b.column(1)):
                doc, h = _distinct(*ngrams(w, n))
                if not len(h):
                    continue
                at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                with np.errstate(over="ignore"):
                    band = np.zeros((len(at), bands), np.uint64)
                    for k in range(bands * rows):
                        low = np.minimum.reduceat((h ^ xor[k]) * mul[k], at)
                        band[:, k // rows] = mix(band[:, k // rows] * U(31) + low)
                    band = mix(band + np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
                    s1, s2 = np.add.reduceat(mix(h ^ U(0x1F83D9ABFB41BD6B)), at), np.add.reduceat(mix(h ^ U(0x5BE0CD19137E2179)), at)
                yield pa.RecordBatch.from_pydict({
                    "id": b.column(0).take(rows_at := pa.array(doc[at] + w.first)), "th": b.column(2).take(rows_at), "size": pa.array(np.diff(np.r_[at, len(h)])), "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(band.ravel().view(np.int64))),
                })

    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {kind}, th bigint, size bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _first_shared(bands: np.ndarray, band: int) -> np.ndarray:
    """Pairs of rows whose first shared band is ``band`` (they share it)."""
    out = np.ones((len(bands), len(bands)), bool)
    for k in range(band):
        out &= bands[:, k][:, None] != bands[:, k][None, :]
    np.fill_diagonal(out, False)
    return out


def _counted(own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs of rows that this pair of blocks counts: all of a block with itself, or one of each block."""
    return np.ones((len(own), len(own)), bool) if i == j else own[:, None] != own[None, :]


@freeing
def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, own, band, rep, th, bands, copies) that have a partner to be verified here."""
    for g in groups(batches, 3):
        if g.num_rows < 2:
            continue
        own, band = g.column("_own").to_numpy(), int(g.column("band")[0].as_py())
        bands = matrix(g.column("bands"))
        pairs = _first_shared(bands, band) & _counted(own, g.column("_i")[0].as_py(), g.column("_j")[0].as_py())
        keep = pairs.any(1)
        if keep.any():
            yield from g.select(["bucket", "_i", "_j", "_own", "band", "rep", "th", "bands", "copies"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _common(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Numbers of shingles that each two of n sets share."""
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    doc, col = doc[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [at, at + COLUMNS])
        x = np.zeros((n, min(COLUMNS, int(col[-1]) + 1 - at)), np.float32)
        x[doc[i:j], col[i:j] - at] = 1
        out += x @ x.T
    return out


def jaccard_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, rep, copies) of each document with shingles, and (a, b, linked) of classes: ``b`` null and
    the number of documents of other classes linked to ``a``, or an edge that components need and ``linked`` 0."""
    bands, rows = banding(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    signed = written(signatures(docs, n, bands, rows, id_col, text_col), "signatures")
    if repeated(signed.select("id")):
        signed = signed.groupBy("id").agg(F.min(F.struct("s1", "s2", "size", "th", "bands")).alias("_one")).select("id", "_one.*")
    classes = signed.groupBy("s1", "s2", "size").agg(F.min(F.struct("id", "th")).alias("_rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes.select("s1", "s2", "size", F.col("_rep.id").alias("rep"), F.col("_rep.th").alias("th"), "copies", "bands"), "classes")
    members = signed.select("id", "s1", "s2", "size").join(classes.select("s1", "s2", "size", "rep", "copies").hint("merge"), ["s1", "s2", "size"]).select("id", "rep", "copies")

    dealt = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    candidates = written(dealt.join(full.hint("merge"), "bucket"), "candidates")  # bands come back only for these
    whole = candidates.join(classes.select("rep", "th", "copies", "bands").hint("merge"), "rep")
    paired = block_pairs(whole, "bucket", F.col("n"), F.col("rep"), BLOCK_ROWS).select("bucket", "_i", "_j", "_own", "band", "rep", "th", "copies", "bands")
    by = ["bucket", "_i", "_j"]
    shape = f"bucket bigint, _i int, _j int, _own int, band int, rep {kind}, th bigint, bands array<bigint>, copies bigint"
    needed = written(paired.repartition(*by).sortWithinPartitions(*by).mapInArrow(_needed, shape), "needed")
    remove(candidates)

    @freeing
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            g = once(g, "rep")
            own, band = g.column("_own").to_numpy(), int(g.column("band")[0].as_py())
            pairs = _first_shared(matrix(g.column("bands")), band) & _counted(own, g.column("_i")[0].as_py(), g.column("_j")[0].as_py())
            parts = [(w.first, *ngrams(w, n)) for w in word_chunks(g.column("text"))]
            doc, h = _distinct(np.concatenate([d + f for f, d, _ in parts]), np.concatenate([x for *_, x in parts]))
            size = np.bincount(doc, minlength=g.num_rows)
            both = _common(doc, h, g.num_rows)
            union = size[:, None] + size[None, :] - both
            linked = pairs & (both >= threshold * union - 1e-6 * union) & (both > 0)
            if not linked.any():
                continue
            rep, copies = g.column("rep").combine_chunks(), g.column("copies").to_numpy()
            counts = linked @ copies
            at = np.flatnonzero(counts)
            star = spanning(*np.nonzero(np.triu(linked)), g.num_rows)
            a, b = np.array([x for x, _ in star], np.int64), np.array([y for _, y in star], np.int64)
            yield pa.RecordBatch.from_pydict({
                "a": pa.concat_arrays([rep.take(pa.array(at)), rep.take(pa.array(a))]), "b": pa.concat_arrays([pa.nulls(len(at), rep.type), rep.take(pa.array(b))]),
                "linked": pa.array(np.r_[counts[at], np.zeros(len(a), np.int64)].astype(np.int64)),
            })

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rep"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    with_text = texts.join(needed.hint("merge"), ["rep", "th"]).select(*by, "_own", "band", "rep", "copies", "bands", "text")
    links = written(with_text.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify, f"a {kind}, b {kind}, linked bigint"), "class-links")
    remove(needed)
    return members, links


def ngram_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, n_links) of every row with an id: the smallest id that links reach, and the number of other documents linked directly."""
    members, links = jaccard_links(docs, n, threshold, recall, id_col, text_col)
    labels = components(links.where("b IS NOT NULL"))
    counts = links.groupBy("a").agg(F.sum("linked").alias("linked"))
    reps = members.join(labels, F.col("rep") == F.col("v"), "left").join(counts, F.col("rep") == F.col("a"), "left")
    found = reps.select(F.col("id").alias("_id"), F.coalesce("c", "rep").alias("_class"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    out = docs.where(F.col(id_col).isNotNull()).select(id_col).join(found, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, F.coalesce("_class", F.col(id_col)).alias("class_id"), F.coalesce("_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, the one of smallest id, of each group that links connect."""
    groups_of = ngram_groups(docs, n, threshold, recall, id_col, text_col).where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("_hg_gone"))
    return docs.join(groups_of.hint("merge"), F.col(id_col) == F.col("_hg_gone"), "left_anti")
