"""Cell tables bucketed by cell: rasters of one grid that are joined again and again meet without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from heatgrid.operators.checks import require_columns
from heatgrid.sources.shared import new_folder


def write_bucketed(cells: DataFrame, buckets: int = 64, name: str | None = None) -> DataFrame:
    """``cells`` written once, one file for each of ``buckets`` buckets of (row, col), sorted within, so that a range of rows
    skips row groups. Tables of equal ``buckets`` are co-partitioned: ``align``, ``mask_by_class``, ``valid_mask`` and all
    other joins and groupings by cell need no exchange of them (joins by a tile's number alone wouldn't: Spark asks for all
    keys of a join). The table is known to the session's catalog as ``name``; its files lie in the shared folder."""
    spark = cells.sparkSession
    name = name or f"cells_{uuid.uuid4().hex}"
    out = require_columns(cells, "row", "col").repartition(buckets, "row", "col")
    out.write.bucketBy(buckets, "row", "col").sortBy("row", "col").option("path", new_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Drop the table; its files stay until the shared folder is cleared."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
