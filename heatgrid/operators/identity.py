"""Declared identity of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.checks import require_columns


def assign_feature_id(df: DataFrame, source: str) -> DataFrame:
    """``feature_id`` from a column that must be there, without nulls and unique."""
    require_columns(df, source)
    found = df.agg(F.count("*").alias("n"), F.count(source).alias("some"), F.count_distinct(source).alias("different")).first()
    if found["n"] != found["some"]:
        raise ValueError(f"{source} has {found['n'] - found['some']} nulls")
    if found["different"] != found["n"]:
        raise ValueError(f"{source} repeats {found['n'] - found['different']} values")
    return df.withColumn("feature_id", F.col(source).cast("string"))
