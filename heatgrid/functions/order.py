"""Exact medians and ranks of large groups without a task that holds a whole group.

Values fall into buckets that keep their order; counts by bucket give each bucket its place, and only equal buckets are
sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: buckets for each doubling of a value
STEPS = 4096


def bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises (NaN counts as the largest, as in Spark's order)."""
    v = value.cast("double")
    sign = F.when(F.isnan(v), 1.0).otherwise(F.signum(v))
    return (sign * F.floor(F.least(F.lit(1100.0), F.log2(1 + F.abs(v))) * STEPS)).cast("bigint")


def _same(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(prefix + c))
    return same


def medians(df: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, median) of the values that aren't null, one row for each group that has any (without keys one row, null if there are none).
    ``weight``: whole numbers, how often each value counts."""
    times = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(times.alias("_n")).withColumn("_b", bucket(F.col("_v")))
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    w = W.partitionBy(*keys)  # a row for each bucket
    placed = sums.withColumn("_upto", F.sum("_n").over(w.orderBy("_b"))).withColumn("_all", F.sum("_n").over(w)).withColumn("_before", F.col("_upto") - F.col("_n"))
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    middle = placed.where((F.col("_before") < high) & (F.col("_upto") >= low)).select(*[F.col(c).alias(f"_m_{c}") for c in keys], F.col("_b").alias("_mb"), "_before", "_all")
    inside = counts.join(middle, _same(keys, "_m_") & F.col("_b").eqNullSafe(F.col("_mb")))  # null-safe, so that no filter is inferred and both sides share one shuffle
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    ends = inside.withColumn("_u", upto).groupBy(*keys).agg(F.min(F.when(F.col("_u") >= low, F.col("_v"))).alias("_low"), F.min(F.when(F.col("_u") >= high, F.col("_v"))).alias("_high"))
    return ends.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def rank_descending(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``df`` and each row's rank from the largest value, equal ones alike, nulls last."""
    keyed = df.withColumn("_b", bucket(F.col(value)))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    after = counts.select(F.col("_b").alias("_k"), (F.sum("_n").over(W.orderBy(F.desc("_b"))) - F.col("_n")).alias("_more"))  # a row for each bucket
    within = F.rank().over(W.partitionBy("_b").orderBy(F.desc(value)))
    return keyed.join(after, F.col("_b").eqNullSafe(F.col("_k"))).withColumn(name, (F.col("_more") + within).cast("int")).drop("_b", "_k", "_more")
