"""Importance resampling: the log ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Word unigrams and bigrams fall into ``buckets`` hashed features. The raw model counts them over all documents, the target
model over the labelled ones whose hashed id is below a cut that keeps ``max_target`` on average (their ids are broadcast). A document's log weight sums the log
ratios over all its n-grams; its key adds Gumbel noise drawn from its id and the seed. The k largest keys are found
exactly, by counts of the keys' 16-bit digits.

Cases: null and empty texts have log weight 0; a null id draws as one id; rows with equal keys at the cut are all kept;
without a labelled target row every weight is 0; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.pieces import freeing
from heatgrid.llm.store import written
from heatgrid.llm.textops import U, Words, mix, word_chunks


def features(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all unigrams and bigrams."""
    with np.errstate(over="ignore"):
        two = mix(w.hash[:-1] * U(0x9FB21C651E98DF25) + w.hash[1:])
    same = w.doc[:-1] == w.doc[1:]
    return np.r_[w.doc, w.doc[:-1][same]], (np.r_[w.hash, two[same]] % U(buckets)).astype(np.int64)


def _counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Feature counts over all rows; at most ``buckets`` sums reach the driver."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for w in word_chunks(b.column(0)):
                total += np.bincount(features(w, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        out[r.bucket] = r.n
    return out


def top_cut(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a bigint column, by counts of its digits (65536 at a time); None if there are fewer."""
    rest = df.select((F.shiftright(key, 48) + 32768).cast("int").alias("d3"), *[F.shiftright(key, 16 * i).bitwiseAND(65535).cast("int").alias(f"d{i}") for i in (2, 1, 0)])
    at = 0
    for d in ("d3", "d2", "d1", "d0"):
        counts = sorted(((r[0], r[1]) for r in rest.groupBy(d).count().collect()), reverse=True)
        for digit, n in counts:
            if k <= n:
                at = at * 65536 + digit
                rest = rest.where(F.col(d) == digit)
                break
            k -= n
        else:
            return None
    return at - (1 << 63)


def importance_sample(docs: DataFrame, target: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, max_target: int = 20_000, seed: int = 3) -> DataFrame:
    """(id_col, log_weight, key, kept): ``share`` of all rows is kept. ``target``: a column of ids of target documents."""
    n_target = target.count()
    part = min(1.0, max_target / max(1, n_target))
    ids = target.select(F.col(target.columns[0]).alias("_t")).where(F.pmod(F.xxhash64("_t", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30))).distinct()
    chosen = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("_t"), "left_semi")  # about max_target ids, as the hash filter bounds them
    p, q = _counts(chosen, text_col, buckets), _counts(docs, text_col, buckets)
    ratio = np.log((p + 1) / (p.sum() + buckets)) - np.log((q + 1) / (q.sum() + buckets)) if p.sum() else np.zeros(buckets)
    kind = docs.schema[id_col].dataType.simpleString()

    @freeing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = np.zeros(b.num_rows)
            for w in word_chunks(b.column(2)):
                row, bucket = features(w, buckets)
                weight[w.first : w.first + w.rows] = np.bincount(row, ratio[bucket], w.rows)
            u = ((mix(b.column(1).to_numpy().view(np.uint64)) >> U(11)).astype(float) + 0.5) / (1 << 53)
            key = weight - np.log(-np.log(u))
            bits = key.view(np.int64)
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "log_weight": pa.array(weight), "key": pa.array(key), "_order": pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))})

    scored = docs.select(id_col, F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"), text_col).mapInArrow(score, f"{id_col} {kind}, log_weight double, key double, _order bigint")
    scored = written(scored, "importance")
    k = round(share * scored.count())
    cut = top_cut(scored, "_order", k) if k else None
    kept = F.lit(k > 0) if cut is None else F.col("_order") >= cut
    return scored.select(id_col, "log_weight", "key", kept.alias("kept"))
