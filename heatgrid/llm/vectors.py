"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations, with multiprobe and exact checks.

Every different vector of a label is hashed in ``tables`` tables: ``depth`` pseudo-random rotations (three rounds of
random signs and a fast Hadamard transform) each give the closest signed axis, together one bucket; ``probes`` further
buckets replace the axis that is closest to a tie. A vector lies in its own bucket and asks at the probed ones. Buckets
without a possible pair go; the rest are pairs of bounded blocks, whose vectors are compared exactly, in double
precision. A pair counts in the first table and bucket where one's own bucket is the other's own or probed one.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows of a null label, link with
nothing and stay; equal vectors of a label are linked and hashed once; vectors of unequal lengths never link, nor do
those of unequal labels whose buckets clash; rows with a null id are left out; rows with equal ids are one item, which has
the smallest label and vector among theirs that can link, and each of these rows gets its result; extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.blocks import block_pairs, groups, matrix, spanning
from heatgrid.llm.components import components
from heatgrid.llm.pieces import freeing
from heatgrid.llm.store import remove, repeated, written
from heatgrid.llm.textops import U, mix

BLOCK_ROWS = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def hash_vectors(x: np.ndarray, tables: int, depth: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) buckets of unit vectors; the first is the vector's own."""
    size = 1 << max(1, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, size]).choice([-1.0, 1.0], (tables, depth, 3, size))
    out = np.empty((len(x), tables, 1 + probes), np.uint64)
    rows = np.arange(len(x))
    wide = min(size, probes + 1)
    for t in range(tables):
        axes, gaps = [], []
        for d in range(depth):
            y = padded
            for k in range(3):
                y = hadamard(y * signs[t, d, k])
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :wide]
            value = np.take_along_axis(y, near, 1)
            axes.append(near * 2 + (value < 0))
            gaps.append(np.abs(value[:, :1]) - np.abs(value))
        code = [a[:, 0] for a in axes]

        def bucket(parts: list[np.ndarray], t: int = t) -> np.ndarray:
            h = np.full(len(x), t + 1, np.uint64)
            with np.errstate(over="ignore"):
                for p in parts:
                    h = mix(h * U(0x9E3779B97F4A7C15) + p.astype(np.uint64) + U(1))
            return h

        out[:, t, 0] = bucket(code)
        cost = np.concatenate([g[:, 1:] for g in gaps], 1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            if p >= best.shape[1]:
                out[:, t, 1 + p] = out[:, t, 0]
                continue
            d, k = np.divmod(best[:, p], wide - 1)
            parts = [np.where(d == i, axes[i][rows, np.where(d == i, k + 1, 0)], code[i]) for i in range(depth)]
            out[:, t, 1 + p] = bucket(parts)
    return out


def _pairs_here(keys: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether (table, bucket) is the first place where each pair of rows meets; keys: (rows, tables, 1 + probes)."""
    ok = np.ones(len(a), bool)
    for t in range(table):
        ok &= ~((keys[a, t, :1] == keys[b, t]).any(1) | (keys[b, t, :1] == keys[a, t]).any(1))
    own_a, own_b = keys[a, table, 0], keys[b, table, 0]
    by_a, by_b = (own_a[:, None] == keys[b, table]).any(1), (own_b[:, None] == keys[a, table]).any(1)
    here = np.where(by_a & by_b, np.minimum(own_a, own_b), np.where(by_a, own_a, own_b))
    return ok & (by_a | by_b) & (here == np.uint64(bucket))


def vector_links(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str, tables: int, depth: int, probes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(members, links), as ``jaccard_links`` of the n-gram join has them."""
    kind = vectors.schema[id_col].dataType.simpleString()
    x = F.col("x")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x")).where(good)
    rows = rows.withColumn("x", F.transform(x, lambda v: v + F.lit(0.0)))  # one zero
    if repeated(vectors.select(id_col)):
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("_one")).select("id", "_one.*")
    classes = written(rows.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    members = rows.join(classes, ["label", "x"]).select("id", "rep", "copies")

    @freeing
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                lengths = pc.list_value_length(b.column(2)).to_numpy()
                for n in np.unique(lengths):
                    part = b.filter(pa.array(lengths == n))
                    v = part.column(2).flatten().to_numpy().reshape(-1, n)
                    v = v / np.abs(v).max(1, keepdims=True)
                    v /= np.sqrt((v * v).sum(1, keepdims=True))
                    keys = hash_vectors(v, tables, depth, probes, seed)
                    labels = np.array([hash_label(s) for s in part.column(1).to_pylist()], np.uint64) + U(int(n))
                    keys = mix(keys ^ mix(labels)[:, None, None])
                    flat = keys.reshape(len(v), -1).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"rep": part.column(0), "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))})

    keyed = written(classes.select("rep", "label", "x").mapInArrow(hashed, f"rep {kind}, keys array<bigint>"), "vector-keys")
    dealt = keyed.select("rep", F.posexplode("keys").alias("p", "bucket")).select("rep", "bucket", F.floor(F.col("p") / (1 + probes)).cast("int").alias("t"), (F.col("p") % (1 + probes) == 0).alias("own"))
    dealt = dealt.groupBy("rep", "bucket", "t").agg(F.max("own").alias("own"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 AND owners > 0")
    by = ["bucket", "_i", "_j"]
    paired = block_pairs(dealt.join(full, "bucket"), "bucket", F.col("n"), F.col("rep"), BLOCK_ROWS).select(*by, "_own", "t", "rep")
    given = vectors.schema[vector_col].dataType.simpleString()  # floats travel as floats
    with_x = paired.join(keyed, "rep").join(classes.select("rep", "label", "copies", F.col("x").cast(given).alias("x")), "rep").select(*by, "_own", "t", "rep", "label", "copies", "keys", "x")

    @freeing
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (part for whole in groups(batches, 3) for part in alike(whole)):
            own, t, bucket = g.column("_own").to_numpy(), int(g.column("t")[0].as_py()), g.column("bucket")[0].as_py()
            v = matrix(g.column("x")).astype(float)
            v = v / np.abs(v).max(1, keepdims=True)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            close = np.triu(v @ v.T >= threshold, 1)
            if g.column("_i")[0].as_py() != g.column("_j")[0].as_py():
                close &= own[:, None] != own[None, :]
            a, b = np.nonzero(close)
            if not len(a):
                continue
            keys = matrix(g.column("keys")).view(np.uint64).reshape(len(v), tables, 1 + probes)
            here = np.concatenate([_pairs_here(keys, a[i : i + 100_000], b[i : i + 100_000], t, bucket % (1 << 64)) for i in range(0, len(a), 100_000)])
            a, b = a[here], b[here]
            rep, copies = g.column("rep").combine_chunks(), g.column("copies").to_numpy()
            counts = np.bincount(a, copies[b], len(v)) + np.bincount(b, copies[a], len(v))
            at = np.flatnonzero(counts)
            star = spanning(a, b, len(v))
            p, q = np.array([s for s, _ in star], np.int64), np.array([s for _, s in star], np.int64)
            yield pa.RecordBatch.from_pydict({
                "a": pa.concat_arrays([rep.take(pa.array(at)), rep.take(pa.array(p))]), "b": pa.concat_arrays([pa.nulls(len(at), rep.type), rep.take(pa.array(q))]),
                "linked": pa.array(np.r_[counts[at], np.zeros(len(p))].astype(np.int64)),
            })

    links = written(with_x.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify, f"a {kind}, b {kind}, linked bigint"), "vector-links")
    remove(keyed)
    return members, links


def alike(g: pa.Table) -> Iterator[pa.Table]:
    """The rows of each label and length that has two or more; hashes of others may clash with theirs."""
    labels = g.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths = pc.list_value_length(g.column("x")).to_numpy()
    kinds, counts = np.unique(labels * (int(lengths.max()) + 1) + lengths, return_counts=True)
    if len(kinds) == 1:
        yield g
        return
    for kind in kinds[counts > 1]:
        yield g.filter(pa.array(labels * (int(lengths.max()) + 1) + lengths == kind))


def hash_label(label: str) -> int:
    import zlib

    return zlib.crc32(label.encode()) * 2654435761 % (1 << 63)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = 8, depth: int = 3, probes: int = 8, seed: int = 5) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row with an id."""
    members, links = vector_links(vectors, threshold, id_col, vector_col, label_col, tables, depth, probes, seed)
    labels = components(links.where("b IS NOT NULL"))
    counts = links.groupBy("a").agg(F.sum("linked").alias("linked"))
    reps = members.join(labels, F.col("rep") == F.col("v"), "left").join(counts, F.col("rep") == F.col("a"), "left")
    found = reps.select(F.col("id").alias("_id"), F.coalesce("c", "rep").alias("_c"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_n"))
    out = vectors.where(F.col(id_col).isNotNull()).select(id_col).join(found, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, F.coalesce("_n", F.lit(0)).alias("n_links"), F.coalesce("_c", F.col(id_col)).alias("component_id"), (F.coalesce("_c", F.col(id_col)) == F.col(id_col)).alias("kept"))
