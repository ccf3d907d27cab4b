"""Whitening of embeddings over their distinct fixed-point vectors.

Entries become whole numbers, floor(scale * entry). Rows with the same numbers are one vector with a multiplicity, and a fit
weighs each vector by that or by one. Tasks sum weighted entries (as high and low words, so sums are exact), then products
of vectors less the mean by one matrix product a batch; a d x d table, whatever the number of rows, gives the
components in one task. Each distinct vector is whitened once and joined back to its rows, those of vectors that hold
over a HEAVY-th of all rows dealt over SLICES tasks.

Cases: vectors that are null or hold null or non-finite entries have no result; vectors of another length are a space of
their own, with a fit and components of its own (one d x d table a length); an empty vector has no
component, so no row; a component without variance has null ``whitened``, ``explained`` is null where no component has
any; numbers beyond a long stop at its ends, and a ``deviation`` beyond it is null; equal and null ids are rows like
others; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.store import remove, written

HEAVY = 1000
SLICES = 256
LONG = 1 << 63


class Space(NamedTuple):
    """n: weight of all vectors; sums: exact weighted sums by dimension; values: eigenvalues of the covariance, falling; vectors: its first eigenvectors by column; trace: its sum of variances."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # whole numbers divide correctly rounded

    def usable(self, k: int) -> np.ndarray:
        """Whether the first k components have variance beyond rounding."""
        return self.values[:k] > max(0.0, self.values[0] if len(self.values) else 0.0) * len(self.values) * np.finfo(float).eps


def fixed_point(embedding: Column, scale: int = 256) -> Column:
    """Entries as longs; null unless all are finite numbers."""
    odd = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(embedding.isNotNull() & ~odd, F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("bigint")))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their x as a matrix) of column x."""
    x = batch.column(batch.schema.get_field_index("x"))
    lengths = x.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, x.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(d))


def fit(distinct: DataFrame, components: int) -> dict[int, Space]:
    """The space of each vector length of (x, weight), with its first ``components``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = b.column(b.schema.get_field_index("weight")).to_numpy()
            for d, rows, x in by_length(b):
                w = weight[rows] if int(weight[rows].sum()) < 1 << 31 else weight[rows].astype(object)  # products of 32-bit words stay exact
                at = np.arange(d + 1)
                high, low = np.r_[0, w @ (x >> 32)], np.r_[w.sum(), w @ (x & 0xFFFFFFFF)]  # place 0 has the weight
                yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(d + 1, d, np.int32)), "at": pa.array(at.astype(np.int32)), "high": pa.array([int(v) for v in high], pa.decimal128(38)), "low": pa.array([int(v) for v in low], pa.decimal128(38))})

    found = distinct.mapInArrow(sums, "d int, at int, high decimal(38,0), low decimal(38,0)").groupBy("d", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    totals: dict[int, dict[int, int]] = {}
    for r in found.collect():  # d + 1 rows
        totals.setdefault(r["d"], {})[r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    sizes = {d: (t[0], [t[i] for i in range(1, d + 1)]) for d, t in totals.items()}
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in sizes.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            weight = b.column(b.schema.get_field_index("weight")).to_numpy()
            for d, rows, x in by_length(b):
                c = x - means[d]
                held[d] = held.get(d, 0) + (c * weight[rows][:, None]).T @ c
        for d, m in held.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(i), d, np.int32)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(m[i, j])})

    def solve(table: pa.Table) -> pa.Table:
        k = table.column("d")[0].as_py()
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        m = np.zeros((k, k))
        m[i, j] = m[j, i] = v / sizes[k][0]
        values, vectors = np.linalg.eigh(m)
        first = np.ascontiguousarray(vectors[:, ::-1][:, :components].T)
        return pa.table({"d": pa.array([k], pa.int32()), "values": pa.array([values[::-1]], pa.list_(pa.float64())), "vectors": pa.array([first.ravel()], pa.list_(pa.float64())), "trace": pa.array([float(np.trace(m))])})

    summed = distinct.mapInArrow(products, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    solved = summed.groupBy("d").applyInArrow(solve, "d int, values array<double>, vectors array<double>, trace double").collect()  # d * d numbers meet in one task, components * d here
    out = {0: Space(sizes[0][0], [], np.zeros(0), np.zeros((0, 0)), 0.0)} if 0 in sizes else {}
    return out | {r["d"]: Space(*sizes[r["d"]], np.array(r["values"]), np.array(r["vectors"]).reshape(-1, r["d"]).T, r["trace"]) for r in solved}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)**2, exact; None beyond a long."""
    most = n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < LONG:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    return [s if s < LONG else None for s in (away * away).sum(1).tolist()]


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, multiplicity: bool = False) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of each row with a vector and each of its first components.

    ``multiplicity``: the fit weighs a vector by the rows that have it, else by one. ``identity_error`` is the largest
    difference from the identity in the covariance of all whitened components, by the weights of the fit.
    """
    rows = df.select(F.col(id_col).alias("_id"), fixed_point(F.col(vector_col), scale).alias("x")).where("x IS NOT NULL").withColumn("h", F.xxhash64("x"))
    distinct = written(rows.groupBy("h", "x").agg(F.count("*").alias("times")).withColumn("weight", F.col("times") if multiplicity else F.lit(1).cast("bigint")), "distinct-vectors")
    spaces = fit(distinct, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b):
                s, k = spaces[d], min(components, d)
                z = ((x - s.mean) @ s.vectors[:, :k]) / np.sqrt(np.where(s.usable(k), s.values[:k], np.nan))
                part = b.take(pa.array(at))
                flat = pa.array(z.ravel(), from_pandas=True)  # what isn't a number is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), d, np.int32)), pa.array(deviations(x, s.n, s.sums), pa.int64()), lists], names=[*part.schema.names, "d", "deviation", "z"])

    done = written(distinct.mapInArrow(project, "h bigint, x array<bigint>, times bigint, weight bigint, d int, deviation bigint, z array<double>"), "whitened-vectors")
    remove(distinct)
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    z = [F.get("z", F.lit(i)) for i in range(components)]
    means = done.groupBy("d").agg(F.sum("weight").alias("w"), *[(F.sum(F.col("weight") * z[i]) / F.sum("weight")).alias(f"m{i}") for i in range(components)])
    centre = F.broadcast(means)  # a row for each length
    cov = done.join(centre, "d").groupBy("d").agg(*[(F.sum(F.col("weight") * (z[i] - F.col(f"m{i}")) * (z[j] - F.col(f"m{j}"))) / F.sum("weight")).alias(f"c{i}_{j}") for i, j in pairs])
    errors = {r["d"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=None) for r in cov.collect()}
    facts = []
    for d, s in spaces.items():
        facts.append((d, s.n, [float(e) / s.trace if s.trace > 0 else None for e in s.values[:components]], errors.get(d)))
    fact = F.broadcast(df.sparkSession.createDataFrame(facts, "d int, n bigint, shares array<double>, identity_error double"))  # a row for each length
    total = done.agg(F.sum("times")).first()[0] or 0
    heavy = [r["h"] for r in done.where(F.col("times") * HEAVY > total).select("h").distinct().collect()]  # HEAVY at most
    slices = F.when(F.col("h").isin(heavy), F.lit(SLICES)).otherwise(F.lit(1)) if heavy else F.lit(1)
    one_each = done.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select(F.col("h").alias("_h"), F.col("x").alias("_x"), "slice", "d", "deviation", "z")
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("_id"), slices).cast("int"))
    both = dealt.join(one_each, (F.col("h") == F.col("_h")) & (F.col("x") == F.col("_x")) & (dealt["slice"] == one_each["slice"])).select("_id", "d", "deviation", "z")
    each = both.join(fact, "d").select("_id", "n", "deviation", "shares", "identity_error", F.posexplode("z").alias("at", "whitened"))
    return each.select(F.col("_id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("at")).alias("explained"), "identity_error")
