"""Deterministic samples and splits: rows are ordered by md5(id_seed), so results don't depend on partitioning.

Exact cuts of the whole table don't sort it in one task: counts by hash prefix find the one prefix that the cut falls in,
and only its rows are ranked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.checks import require_columns

PREFIX = 4


def hash_order(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(id_.cast("string"), F.lit(f"_{seed}")).cast("binary"))


def ranked(df: DataFrame, key: Column, tie: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and ``_rank`` from 0 in (key, tie) order, in each group of ``within``. ``key``: a hex string; its prefixes' counts
    (65,536 rows at most for a group) give each prefix its first rank, and a window ranks within a prefix."""
    keyed = df.withColumn("_key", key).withColumn("_prefix", F.coalesce(F.substring("_key", 1, PREFIX), F.lit("")))
    counts = keyed.groupBy(*within, "_prefix").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*within).orderBy("_prefix")) - F.col("_n"))
    before = before.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_prefix").alias("_p"), "_before")
    same = F.col("_prefix") == F.col("_p")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    place = F.row_number().over(W.partitionBy(*within, "_prefix").orderBy("_key", tie)) - 1
    return keyed.join(before if within else F.broadcast(before), same).withColumn("_rank", F.col("_before") + place).drop("_key", "_prefix", "_p", "_before", *[f"_w_{c}" for c in within])


def sample_random(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    if n < 1:
        raise ValueError("a sample has at least one row")
    return ranked(df, hash_order(F.col(id_col), seed), id_col).where(F.col("_rank") < n).drop("_rank")


def sample_stratified(df: DataFrame, n: int, seed: int, stratum: str, id_col: str = "id") -> DataFrame:
    """n rows of each stratum, all if it has fewer."""
    return ranked(df, hash_order(F.col(id_col), seed), id_col, (stratum,)).where(F.col("_rank") < n).drop("_rank")


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def sample_filtered(df: DataFrame, expression: str) -> DataFrame:
    return df.where(F.expr(expression))


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_semi")


def unmatched_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return ids.select(id_col).distinct().join(df, id_col, "left_anti")


def _check(test: float, val: float) -> None:
    if not 0 <= test + val < 1:
        raise ValueError("test and validation shares must sum to less than 1")


def _part(rank: Column, n: Column, test: float, val: float) -> Column:
    t, v = F.round(n * test), F.round(n * val)
    return F.when(rank < t, "test").when(rank < t + v, "val").otherwise("train")


def split_random(df: DataFrame, test: float, val: float, seed: int, id_col: str = "id") -> DataFrame:
    """``partition`` of exact sizes round(share * n); the rest trains."""
    _check(test, val)
    n = df.agg(F.count("*").alias("_n"))
    return ranked(df, hash_order(F.col(id_col), seed), id_col).crossJoin(F.broadcast(n)).withColumn("partition", _part(F.col("_rank"), F.col("_n"), test, val)).drop("_rank", "_n")


def split_stratified(df: DataFrame, test: float, val: float, seed: int, stratum: str, id_col: str = "id") -> DataFrame:
    """``split_random`` in each stratum."""
    _check(test, val)
    n = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    out = ranked(df, hash_order(F.col(id_col), seed), id_col, (stratum,)).join(n, F.col(stratum).eqNullSafe(F.col("_s")))
    return out.withColumn("partition", _part(F.col("_rank"), F.col("_n"), test, val)).drop("_rank", "_n", "_s")


def split_grouped(df: DataFrame, test: float, val: float, seed: int, group: str) -> DataFrame:
    """Whole groups to one side."""
    groups = split_random(df.select(group).distinct(), test, val, seed, group)
    return df.join(groups, group)


def split_spatial(df: DataFrame, test: float, val: float, seed: int, block: float, x: str = "x", y: str = "y") -> DataFrame:
    """Whole blocks of space to one side."""
    name = F.concat_ws("_", F.floor(F.col(x) / block).cast("string"), F.floor(F.col(y) / block).cast("string"))
    return split_grouped(df.withColumn("block", name), test, val, seed, "block")


def split_temporal(df: DataFrame, test: float, val: float, time: str, id_col: str = "id") -> DataFrame:
    """The latest rows test, those before validate. Ranks within days follow counts of days."""
    _check(test, val)
    require_columns(df, time, id_col)
    day = df.withColumn("_day", F.to_date(time))
    counts = day.groupBy("_day").agg(F.count("*").alias("_c"))
    before = counts.select("_day", (F.sum("_c").over(W.orderBy("_day")) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_n"))  # a row for each day
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_day").orderBy(time, id_col)) - 1
    out = day.join(F.broadcast(before), "_day").withColumn("_rank", rank)
    t, v = F.round(F.col("_n") * test), F.round(F.col("_n") * val)
    return out.withColumn("partition", F.when(F.col("_rank") >= F.col("_n") - t, "test").when(F.col("_rank") >= F.col("_n") - t - v, "val").otherwise("train")).drop("_day", "_before", "_n", "_rank")


def missing_classes(df: DataFrame, label: str) -> DataFrame:
    """Pairs of partition and class without rows."""
    parts = df.select("partition").distinct().crossJoin(df.select(label).distinct())  # partitions are three at most
    return parts.join(df.select("partition", label).distinct(), ["partition", label], "left_anti")


def split_audit(df: DataFrame, test: float, val: float) -> DataFrame:
    """Rows and share of each partition with a level: an empty training set is critical, an empty wanted one a warning."""
    wanted = df.sparkSession.createDataFrame([("train", 1 - test - val), ("val", val), ("test", test)], "partition string, wanted double")
    n = df.groupBy("partition").agg(F.count("*").alias("n"))
    out = wanted.join(n, "partition", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("actual", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))  # three rows
    return out.withColumn("level", F.when((F.col("n") == 0) & (F.col("wanted") > 0), F.when(F.col("partition") == "train", "critical").otherwise("warning")).otherwise("info")).drop("wanted")


def quota_per_scene(df: DataFrame, n: int, scene: str, ok: str, order: str) -> DataFrame:
    """Frames in order until a scene has n successes."""
    w = W.partitionBy(scene).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(F.col(ok).cast("int")).over(w), F.lit(0))).where(F.col("_before") < n).drop("_before")


#: chances that a Poisson(1) draw is at most 0, 1, 2, ...
POISSON = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def poisson(hashed: Column) -> Column:
    """A Poisson(1) draw from a 64-bit hash."""
    u = (F.pmod(hashed, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return sum((F.when(u > p, 1).otherwise(0) for p in POISSON[:11]), F.lit(0))


def bootstrap_correlations(df: DataFrame, response: str, predictors: list[str], n_boot: int, seed: int, id_col: str = "id") -> DataFrame:
    """(variable, b, r): correlation of each resample of the rows where both values are there.

    Resample b counts a row by a Poisson(1) draw from the row's hash and b. Rows aren't multiplied: a task keeps n_boot sums
    for each predictor, adds a batch of rows by one product of draws and moments, and gives the sums once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_boot, 6 * len(predictors)))
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)]
            for i in range(0, len(h), 1024):
                y, moments = values[0][i : i + 1024], []
                for x in (v[i : i + 1024] for v in values[1:]):
                    here = ~(np.isnan(x) | np.isnan(y))
                    a, b = np.where(here, x, 0), np.where(here, y, 0)
                    moments += [here, a, b, a * a, b * b, a * b]
                sums += draws(h[i : i + 1024], n_boot).T @ np.stack(moments, 1)
        for k, name in enumerate(predictors):
            part = sums[:, 6 * k : 6 * k + 6]
            yield pa.RecordBatch.from_pydict({"variable": pa.array([name] * n_boot), "b": pa.array(np.arange(1, n_boot + 1), pa.int32())} | {c: pa.array(part[:, j].copy()) for j, c in enumerate(("n", "x", "y", "xx", "yy", "xy"))})

    means = df.agg(*[F.avg(c).alias(c) for c in (response, *predictors)]).first()  # less their means, sums keep their digits
    less = lambda c: (F.col(c).cast("double") - F.lit(means[c] or 0.0)).alias(c)
    rows = df.where(F.col(response).isNotNull()).select(F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"), less(response), *[less(c) for c in predictors])
    found = rows.mapInArrow(run, "variable string, b int, n double, x double, y double, xx double, yy double, xy double").groupBy("variable", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = F.expr("(n * xx - x * x) * (n * yy - y * y)")
    return found.select("variable", "b", F.when(spread > 0, F.expr("n * xy - x * y") / F.sqrt(spread)).alias("r"))


def draws(hashes: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson(1) draws, a row for each hash and a column for each resample."""
    with np.errstate(over="ignore"):
        z = hashes[:, None] + np.arange(1, n_boot + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(np.array(POISSON), u).astype(float)


def bootstrap_sums(df: DataFrame, x: str, y: str, n_boot: int, seed: int, id_col: str = "id") -> DataFrame:
    """(b, r): ``bootstrap_correlations`` of one predictor."""
    return bootstrap_correlations(df, y, [x], n_boot, seed, id_col).select("b", "r")


def holdout(df: DataFrame, share: float, seed: int, id_col: str = "id") -> DataFrame:
    """floor(n * share) test rows."""
    n = df.agg(F.floor(F.count("*") * share).alias("_n"))
    return ranked(df, hash_order(F.col(id_col), seed), id_col).crossJoin(F.broadcast(n)).withColumn("partition", F.when(F.col("_rank") < F.col("_n"), "test").otherwise("train")).drop("_rank", "_n")
