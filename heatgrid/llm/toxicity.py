"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, through a block-max inverted index.

Terms are lower-cased words and their first 4, 5 and 6 bytes. ``fit`` takes about ``max_examples`` labelled texts at most (by
hash of their id, equal texts once) and about ``max_bytes`` of their texts, so what the driver and each task hold is bounded
by these two. A term's idf, over all documents, is scaled by its gain: how far the rarer label's
share of the term's texts, with ``prior_texts`` texts of the base rate added, lies above the base rate, 0 where it doesn't.
Every term of the examples is in the index but those of gain 0, which add 0 to every product, so cosines are exact over
all terms. The index holds, for each term, the examples that have it with their weights, in blocks of BLOCK examples with
the largest weight of each block. A query visits the blocks of highest bound and then those that can still reach its k-th
cosine, so neighbours are exact. Votes weigh by distance and a step function, fitted on the examples with each one's own
vote left out, calibrates them.

Cases: null and empty texts and texts without a term of the index take the calibrated score of such examples; equal
cosines rank by example; rows with null labels or ids are no examples; with no example every score is 0; extra columns stay
(those named score or evidence are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.pieces import freeing, ranges
from heatgrid.llm.store import remove, written
from heatgrid.llm.textops import NON_ALNUM, U, byte_prefix, mix, span_hash, word_chunks

BLOCK = 64
COMMON = 1 / 48
BATCH = 256
PREFIXES = (4, 5, 6)
SIEVE = 1 << 22


def term_chunks(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, term, times) of each chunk; terms are hashes, or places in the sorted ``wanted`` and only those."""
    sieve = np.zeros(SIEVE, bool)
    if wanted is not None:
        sieve[(wanted & U(SIEVE - 1)).astype(np.int64)] = True
    for w in word_chunks(column, NON_ALNUM, lower=True):
        prefix = byte_prefix(w.data)
        docs, hashes = [], []
        for k, n in enumerate((None, *PREFIXES)):
            at = slice(None) if n is None else np.flatnonzero(w.end - w.start > n)
            h = w.hash if n is None else mix(span_hash(prefix, w.start[at], w.start[at] + n) + U(k))
            d = w.doc[at]
            if wanted is not None:
                hit = sieve[(h & U(SIEVE - 1)).astype(np.int64)]
                h, d = h[hit], d[hit]
            docs.append(d)
            hashes.append(h)
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        if wanted is not None:
            place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            hit = wanted[place] == h if len(wanted) else np.zeros(len(h), bool)
            doc, h = doc[hit], place[hit]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
        yield w.first, w.rows, doc[new], h[new], np.diff(np.r_[new, len(h)])


class Index:
    """Examples as postings by term, cut into cells of one term and one block of examples, with each cell's largest weight.
    Terms that a COMMON share of the examples has are whole rows of weights instead."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: list, terms: int, k: int):
        """example, term, weight: the non-zero weights of all examples."""
        self.source = (example.astype(np.int32), term.astype(np.int32), weight, labels, ids, terms, k)
        self.labels, self.ids, self.k = labels, ids, k
        self.blocks = -(-len(labels) // BLOCK)
        common = np.flatnonzero(np.bincount(term, minlength=terms) > max(BLOCK, COMMON * len(labels)))
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks, BLOCK))
        whole = self.row[term] >= 0
        self.rows[self.row[term[whole]], example[whole] // BLOCK, example[whole] % BLOCK] = weight[whole]
        self.rows_top = self.rows.max(2)
        example, term, weight = example[~whole], term[~whole], weight[~whole]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        term, block = term[order], self.example // BLOCK
        self.start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.length = np.diff(np.r_[self.start, len(term)])
        self.block = block[self.start]
        self.top = np.maximum.reduceat(self.weight, self.start) if len(term) else np.zeros(0)
        self.cells = np.searchsorted(term[self.start], np.arange(terms + 1))

    def __getstate__(self) -> tuple:
        return self.source  # tasks build the rest again, which is several times as large

    def __setstate__(self, source: tuple) -> None:
        self.__init__(*source)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k largest positive cosines and these, equal ones by example."""
        return next(self.search([(terms, weights)], [without]))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for each of many queries; the products of common terms are taken for BATCH queries together."""
        rows = self.rows.reshape(len(self.rows), self.blocks * BLOCK)
        for at in range(0, len(queries), BATCH):
            part = queries[at : at + BATCH]
            x = np.zeros((len(part), len(rows)))
            rest = []
            for q, (terms, weights) in enumerate(part):
                whole = self.row[terms] >= 0
                x[q, self.row[terms[whole]]] = weights[whole]
                rest.append((terms[~whole], weights[~whole]))
            base = x @ rows
            for q, (terms, weights) in enumerate(rest):
                yield self._nearest(terms, weights, base[q], without[at + q] if without else -1)

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, base: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """base: the products with all examples that common terms make."""
        n = self.cells[terms + 1] - self.cells[terms]
        cells, x = ranges(self.cells[terms], n), np.repeat(weights, n)
        block, base = self.block[cells], base.reshape(self.blocks, BLOCK)
        bound = np.bincount(block, x * self.top[cells], self.blocks) + base.max(1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_i, best = np.zeros(0, np.int64), np.zeros(0)
        place = np.empty(self.blocks, np.int64)
        for group in (order[:8], order[8:]):  # the second time, all blocks that can still reach
            if len(best) >= self.k:
                group = group[bound[group] >= best[-1] - 1e-9]
            if not len(group):
                break
            place[:] = -1
            place[group] = np.arange(len(group))
            here = np.flatnonzero(place[block] >= 0)
            own = cells[here]
            at_post = ranges(self.start[own], self.length[own])
            where = np.repeat(place[block[here]], self.length[own]) * BLOCK + self.example[at_post] % BLOCK
            got = base[group].ravel() + np.bincount(where, np.repeat(x[here], self.length[own]) * self.weight[at_post], len(group) * BLOCK)
            j = np.flatnonzero(got)
            if len(j) > 4 * self.k:  # few need to be sorted
                j = j[got[j] >= np.partition(got[j], -self.k - 1)[-self.k - 1] - 1e-8]
            i, c = group[j // BLOCK] * BLOCK + j % BLOCK, got[j]
            keep = i != without
            best_i, best = np.r_[best_i, i[keep]], np.r_[best, c[keep]]
            first = np.lexsort((best_i, -np.round(best, 9)))[: self.k]
            best_i, best = best_i[first], best[first]
        return best_i, best

    def vote(self, i: np.ndarray, cosine: np.ndarray, prior: float) -> float:
        """Labels weighed by closeness, with one vote of ``prior``."""
        w = cosine**2 / (0.05 + np.maximum(0, 1 - cosine))
        return float((w @ self.labels[i] + prior) / (w.sum() + 1))


def isotonic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends, halfway to the next step, and means of the rising step function nearest to y over x (pooled neighbours, each mean drawn to ``prior`` by one vote)."""
    ends: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
    for v, total, n in zip(x[at], np.add.reduceat(y, at) if len(x) else [], np.diff(np.r_[at, len(x)]), strict=True):
        ends.append([v, total, n, v])
        while len(ends) > 1 and ends[-2][1] * ends[-1][2] >= ends[-1][1] * ends[-2][2]:
            v, total, n, _ = ends.pop()
            ends[-1] = [v, ends[-1][1] + total, ends[-1][2] + n, ends[-1][3]]
    upper = [(e[0] + after[3]) / 2 for e, after in zip(ends, ends[1:], strict=False)] + [e[0] for e in ends[-1:]]
    return np.array(upper), np.array([(e[1] + prior) / (e[2] + 1) for e in ends])


def weigh(terms: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(times)) * idf[terms]
    return x / np.sqrt(x @ x)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int, max_bytes: int, prior_texts: int, weighted: bool, k: int, seed: int):
    """(wanted terms, their weights, index, calibration, base rate, score without terms), or None without examples."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    n = known.count()
    part = min(1.0, max_examples / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30))).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))  # about max_examples ids, by the hash filter
    sample = sample.groupBy(F.xxhash64(text_col).alias("_h")).agg(F.min(F.struct("_id", "_y", F.col(text_col).alias("_text"))).alias("_one"))
    table = sample = written(sample.select("_one.*"), "examples")
    size = sample.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if size > max_bytes:
        sample = sample.where(F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(1 << 30)) < int(max_bytes / size * (1 << 30)))
    kind = docs.schema[id_col].dataType.simpleString()

    @freeing
    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            for first, _, doc, h, _ in term_chunks(b.column(1)):
                yield pa.RecordBatch.from_pydict({"term": pa.array(h.view(np.int64)), "y": pa.array(y[first + doc])})

    sums = sample.agg(F.count("*").alias("n"), F.sum("_y").alias("p")).first()
    total, pos = sums["n"], sums["p"] or 0
    if not total or not 0 < pos < total:
        return None if not total else (np.zeros(0, np.uint64), np.zeros(0), None, None, pos / total, pos / total)
    rate = pos / total
    rare, base = ("a", rate) if rate <= 0.5 else ("d - a", 1 - rate)
    counted = sample.select("_y", "_text").mapInArrow(terms_of, "term bigint, y int").groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("d"))
    gain = F.expr(f"(({rare}) + {prior_texts * base}D) / (d + {prior_texts}) - {base}D") / F.lit(1 - base)
    found = counted.select("term", (gain if weighted else F.lit(1.0)).alias("gain")).where("gain > 1e-9").toArrow()
    wanted, gains = found.column("term").to_numpy().view(np.uint64), found.column("gain").to_numpy()
    order = np.argsort(wanted)
    wanted, gains = wanted[order], gains[order]

    @freeing
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(wanted), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, _, t, _ in term_chunks(b.column(0), wanted):
                np.add.at(sums, t, 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"t": pa.array(np.r_[-1, at].astype(np.int32)), "n": pa.array(np.r_[rows, sums[at]])})

    df = docs.select(text_col).mapInArrow(seen, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros(len(wanted) + 1)
    having[df.column("t").to_numpy()] = df.column("n").to_numpy()  # the number of documents is last, at -1
    idf = (np.log((having[-1] + 1) / (having[:-1] + 1)) + 1) * gains

    @freeing
    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, doc, t, times in term_chunks(b.column(2), wanted):
                off = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"_id": b.column(0).slice(first, n), "_y": b.column(1).slice(first, n), "terms": pa.ListArray.from_arrays(off, pa.array(t.astype(np.int32))), "times": pa.ListArray.from_arrays(off, pa.array(times.astype(np.int32)))})

    found = sample.mapInArrow(vectors_of, f"_id {kind}, _y int, terms array<int>, times array<int>").toArrow()
    ids, ys = found.column("_id").to_pylist(), found.column("_y").to_pylist()
    terms, times = (found.column(c).combine_chunks() for c in ("terms", "times"))
    off, terms, times = np.asarray(terms.offsets), terms.values.to_numpy(), times.values.to_numpy()
    bag = [(terms[i:j], times[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
    order = sorted(range(len(ids)), key=lambda r: (ys[r] != (rate <= 0.5), str(ids[r]), bag[r][0].tobytes(), bag[r][1].tobytes()))  # blocks of one label bound better
    full, empty = [r for r in order if len(bag[r][0])], [ys[r] for r in order if not len(bag[r][0])]
    remove(table)
    bare = (sum(empty) + rate) / (len(empty) + 1)
    if not full:
        return wanted, idf, None, None, rate, bare
    vectors = [(bag[r][0], weigh(*bag[r], idf)) for r in full]
    example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    index = Index(example, np.concatenate([t for t, _ in vectors]), np.concatenate([x for _, x in vectors]), np.array([ys[r] for r in full], float), [ids[r] for r in full], len(wanted), k)
    own = np.array([index.vote(*found, rate) for found in index.search(vectors, list(range(len(vectors))))])
    steps = isotonic(own, index.labels, rate)
    return wanted, idf, index, steps, rate, bare


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 2048, max_bytes: int = 64 << 20, prior_texts: int = 8, weighted: bool = True, k: int = 25, seed: int = 11) -> DataFrame:
    """All columns of the documents, score, and evidence array<struct<id, label, cosine>>; ``labels`` are those it may learn from.
    ``weighted``: terms count by their gain, else by plain idf."""
    fitted = fit(docs, labels, id_col, text_col, label_col, max_examples, max_bytes, prior_texts, weighted, k, seed)
    kind = docs.schema[id_col].dataType.simpleString()
    wanted, idf, index, steps, rate, bare = fitted or (np.zeros(0, np.uint64), np.zeros(0), None, None, 0.0, 0.0)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, evidence = np.full(b.num_rows, bare), [[] for _ in range(b.num_rows)]
            for first, _, doc, t, times in term_chunks(b.column(at_text), wanted) if index is not None else ():
                at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
                queries: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
                keys = []
                for i, j in zip(at, np.r_[at[1:], len(doc)], strict=True):
                    keys.append((t[i:j].tobytes(), times[i:j].tobytes()))
                    if keys[-1] not in queries:  # copies have equal terms
                        queries[keys[-1]] = (t[i:j], weigh(t[i:j], times[i:j], idf))
                results = {}
                for key, (near, cosine) in zip(queries, index.search(list(queries.values())), strict=True):
                    step = min(int(np.searchsorted(steps[0], index.vote(near, cosine, rate))), len(steps[1]) - 1)
                    results[key] = (float(steps[1][step]), [{"id": index.ids[n], "label": int(index.labels[n]), "cosine": float(c)} for n, c in zip(near[:3], cosine[:3], strict=True)])
                for row, key in zip((first + doc[at]).tolist(), keys, strict=True):
                    scores[row], evidence[row] = results[key]
            shown = pa.array(evidence, pa.list_(pa.struct([("id", b.column(at_id).type), ("label", pa.int32()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), shown], names=[*b.schema.names, "score", "evidence"])

    kept = docs.drop("score", "evidence")
    at_id, at_text = kept.columns.index(id_col), kept.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, score double, evidence array<struct<id:{kind},label:int,cosine:double>>")
