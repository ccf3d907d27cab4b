"""Regridding of cells between coordinate systems."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.vectors import reproject


class Grid(NamedTuple):
    """Origin of cell (0, 0), steps along columns and rows, and size."""

    crs: int
    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int


def reproject_cells(cells: DataFrame, src: Grid, dst: Grid, method: str = "bilinear") -> DataFrame:
    """Cells of ``dst``: each centre is carried back to ``src`` and reads the nearest cell, or weighs the four around it (those with data)."""
    if src == dst:
        return cells
    at = cells.sparkSession.range(dst.rows * dst.cols).select((F.col("id") / dst.cols).cast("int").alias("row"), (F.col("id") % dst.cols).cast("int").alias("col"))
    centre = at.withColumn("_x", dst.x0 + (F.col("col") + 0.5) * dst.dx).withColumn("_y", dst.y0 + (F.col("row") + 0.5) * dst.dy)
    back = reproject(centre, dst.crs, src.crs, "_x", "_y").select("row", "col", ((F.col("_x") - src.x0) / src.dx).alias("c"), ((F.col("_y") - src.y0) / src.dy).alias("r"))
    source = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    if method == "nearest":
        near = back.select("row", "col", F.floor("r").cast("int").alias("_r"), F.floor("c").cast("int").alias("_c"))
        return near.join(source, ["_r", "_c"]).select("row", "col", "value")
    fr, fc = F.floor(F.col("r") - 0.5), F.floor(F.col("c") - 0.5)
    wr, wc = F.col("r") - 0.5 - fr, F.col("c") - 0.5 - fc
    four = F.array(*[F.struct((fr + a).cast("int").alias("_r"), (fc + b).cast("int").alias("_c"), ((wr if a else 1 - wr) * (wc if b else 1 - wc)).alias("w")) for a in (0, 1) for b in (0, 1)])
    parts = back.select("row", "col", F.explode(four).alias("p")).select("row", "col", "p._r", "p._c", "p.w").where("w > 0").join(source.where("value IS NOT NULL"), ["_r", "_c"])
    return parts.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
