"""The first holder of each key, streamed from rows in key order, with keys that hold many rows dealt over slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLICES = 256
MAX_HEAVY = 1000


def first_seen(rows: DataFrame, keys: list[str], order: list[str], ranged: bool) -> DataFrame:
    """``rows`` and ``_first``, the smallest ``order`` struct among the rows of equal ``keys``.

    Rows are dealt by key (in ranges, or by hash) and sorted by key and order; a window takes the first on that same deal.
    A key that holds more than a thousandth of all rows, as a frequent-items sketch of fixed size says, is dealt over SLICES
    slices by ``order[0]``, and its first comes from one row for each such key (at most MAX_HEAVY). The sketch decides how
    rows are dealt, never the result.
    """
    sketch = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k({keys[0]}, {MAX_HEAVY}, {10 * MAX_HEAVY})").alias("top")).first()
    heavy = [r["item"] for r in sketch["top"] or [] if r["count"] * MAX_HEAVY > sketch["n"]]
    by, dealt = keys, rows
    if heavy:
        is_heavy = F.col(keys[0]).isin(heavy)
        by, dealt = [*keys, "_slice"], rows.withColumn("_slice", F.when(is_heavy, F.pmod(F.xxhash64(order[0]), F.lit(SLICES))).otherwise(0).cast("int"))
    if ranged:
        dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by, *order)
    seen = dealt.withColumn("_first", F.first(F.struct(*order)).over(W.partitionBy(*by).orderBy(*order)))
    if not heavy:
        return seen
    over = rows.where(is_heavy).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_over"))
    return seen.join(F.broadcast(over), keys, "left").withColumn("_first", F.coalesce("_over", "_first")).drop("_over", "_slice")
