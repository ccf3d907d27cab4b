"""Exact shares of cells that polygons cover, by signed areas along their edges.

Inside a row, an edge sweeps an area to its right: a trapezoid in each cell that it crosses and its whole height in every
cell after those. Each edge therefore adds to the cells it crosses and to the next one, and a running sum along the row
gives all shares. Work grows with the cells that edges cross, not with those inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: shares are whole billionths, so that their sums and halves are exact
UNIT = 1_000_000_000


def edge_areas(edges: DataFrame) -> DataFrame:
    """(feature_id, row, col, area): what edges add at a cell to the running sum of its row. Rings may turn either way; ring 1 is
    the outer one, others are holes."""
    ring = ["feature_id", "part", "ring"]
    turn = edges.groupBy(*ring).agg(F.signum(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))).alias("_turn"))
    e = edges.where("y1 <> y2").join(turn, ring).withColumn("_s", F.when(F.col("ring") == 1, -1).otherwise(1) * F.col("_turn") * F.signum(F.col("y2") - F.col("y1")))
    e = e.withColumns({"_lo": F.least("y1", "y2"), "_hi": F.greatest("y1", "y2")}).withColumn("row", F.explode(F.sequence(F.floor("_lo"), F.ceil("_hi") - 1)))
    e = e.withColumns({"_ya": F.greatest("_lo", "row"), "_yb": F.least("_hi", F.col("row") + 1)})
    at = lambda y: F.least(F.greatest("x1", "x2"), F.greatest(F.least("x1", "x2"), F.col("x1") + (F.col(y) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))))
    e = e.withColumns({"_xa": at("_ya"), "_xb": at("_yb"), "_h": F.col("_yb") - F.col("_ya")})
    e = e.select("feature_id", "row", "_s", "_h", F.least("_xa", "_xb").alias("_xl"), F.greatest("_xa", "_xb").alias("_xr"))
    e = e.withColumn("col", F.explode(F.sequence(F.floor("_xl"), F.floor("_xr"))))
    a, b = F.greatest("_xl", "col"), F.least("_xr", F.col("col") + 1)
    height = F.when(F.col("_xr") > F.col("_xl"), F.col("_h") * (b - a) / (F.col("_xr") - F.col("_xl"))).otherwise(F.col("_h"))
    e = e.select("feature_id", "row", "col", (F.col("_s") * height).alias("_a"), ((a + b) / 2 - F.col("col")).alias("_m")).where("_a <> 0")
    both = F.array(F.struct(F.col("col").alias("col"), (F.col("_a") * (1 - F.col("_m"))).alias("area")), F.struct((F.col("col") + 1).alias("col"), (F.col("_a") * F.col("_m")).alias("area")))
    return e.select("feature_id", "row", F.explode(both).alias("p")).groupBy("feature_id", "row", "p.col").agg(F.sum("p.area").alias("area"))


def coverage_spans(edges: DataFrame) -> DataFrame:
    """(feature_id, row, from, to, units): runs of cells of one covered share, in billionths."""
    w = W.partitionBy("feature_id", "row").orderBy("col")
    sums = edge_areas(edges).select("feature_id", "row", F.col("col").alias("from"), (F.lead("col").over(w) - 1).alias("to"), F.round(F.sum("area").over(w) * UNIT).cast("bigint").alias("units"))
    return sums.where("units > 0")


def covered_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells that a feature covers in part or whole: (feature_id, row, col, units) with the cells' columns; ``units`` are billionths of a cell."""
    each = coverage_spans(edges).select("feature_id", F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("from").cast("int"), F.col("to").cast("int"))).alias("col"), F.least("units", F.lit(UNIT)).alias("units"))
    return each.join(cells, ["row", "col"])
