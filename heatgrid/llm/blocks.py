"""Buckets of candidates as pairs of bounded blocks, and helpers for tasks that read sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, bucket: str, count: Column, salt: Column, size: int) -> DataFrame:
    """``rows`` with ``_i`` and ``_j``: a bucket of ``count`` rows is cut into blocks of about ``size``; a row goes to each
    pair of blocks (i <= j) that its own is in, so every two rows of a bucket meet in one pair of blocks, and no task holds
    more than two blocks."""
    n = F.greatest(F.lit(1), F.ceil(count / F.lit(size))).cast("int")
    own = F.pmod(F.xxhash64(salt, F.col(bucket)), n).cast("int")
    out = rows.withColumn("_n", n).withColumn("_own", own)
    return out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")).drop("_n", "_other")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` (integer) columns of sorted batches, joined across batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = np.r_[0, cut, b.num_rows]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = tuple(c[i] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def once(table: pa.Table, name: str) -> pa.Table:
    """The first row of each value of a column."""
    codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.unique(codes, return_index=True)[1]
    return table if len(first) == len(codes) else table.take(pa.array(np.sort(first)))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Star edges (smallest, other) of the components that pairs of 0..n-1 form."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(r, x) for x in range(n) if (r := root(x)) != x]
