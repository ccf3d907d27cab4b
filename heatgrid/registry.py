"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heatgrid.sources.standins import duck, standin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, inputs: str, sql: str | None = None) -> Callable:
    """Register fn(*inputs): ``inputs`` names stand-ins; ``sql``, where {table} and {stand-in} may stand, is the same query in DuckDB."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(standin(spark, sf_dir, x) for x in inputs.split()))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from heatgrid.plans import analyses, bucketed, catalog, cells, chains, cooling, extension, models, sampling, scores, spatial, statistics, vectors, wide  # noqa: F401

    ORACLES.update({k: duck(v) for k, v in ORACLES.items()})


load()
