"""Checks that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """``df``; an error names the columns it lacks."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
