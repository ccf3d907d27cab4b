"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.store import remove, written


def components(links: DataFrame) -> DataFrame:
    """(v, c) of every vertex of ``links`` (a, b): c is the smallest vertex of its component.

    Each round takes the smallest label among a vertex and its neighbours, then that label's own label, so a chain
    shrinks by more than half; every round is a written table, which replaces the last one. Sums meet by partial aggregation,
    so a vertex with many links isn't one task's work. Labels only fall, so the rounds end. An empty table gives an empty one.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m"))
        low = label.join(near, F.col("v") == F.col("a"), "left").select("v", "c", F.least("c", "m").alias("m"))
        up = label.select(F.col("v").alias("u"), F.col("c").alias("cu"))
        new = written(low.join(up, F.col("m") == F.col("u"), "left").select("v", F.least("m", "cu").alias("c"), F.col("c").alias("old")), "labels")
        changed = new.where("c <> old").limit(1).count()
        remove(label)
        label = new.select("v", "c")
        if not changed:
            remove(both)
            return label
