"""Results with their metadata and warnings, measured while the result is written: no second pass over the data.

A step looks at its inputs and its output with ``DataFrame.observe``; writing the output runs the plan once, fills the
measures and hands them to the rules, which give warnings as rows (level, step, message).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from heatgrid.operators.cooling import cooling_differential
from heatgrid.operators.sampling import sample_filtered, split_audit
from heatgrid.operators.spatial import zonal_statistics

#: (level, message that may name measures, condition on the measures)
Rule = tuple[str, str, Callable[[dict[str, Any]], bool]]


class Outcome(NamedTuple):
    data: DataFrame
    metadata: dict[str, Any]
    warnings: DataFrame

    def report(self) -> DataFrame:
        """(step, part, name, value) of each measure and each warning; its rows are those of the step's rules and measures."""
        step, skip = self.metadata["step"], ("step", "path", "columns")
        measured = [(step, "metadata", k, None if v is None else str(v)) for k, v in self.metadata.items() if k not in skip]
        rows = self.data.sparkSession.createDataFrame(measured, "step string, part string, name string, value string")
        return rows.unionByName(self.warnings.select("step", F.lit("warning").alias("part"), F.col("level").alias("name"), F.col("message").alias("value")))


class Step:
    """One run of an operator: ``look`` at what goes in and comes out, then ``write``."""

    def __init__(self, name: str):
        self.name, self.looks = name, []

    def look(self, df: DataFrame, **measures: Column) -> DataFrame:
        own = Observation(f"{self.name}-{len(self.looks)}")
        named = [c.alias(k) for k, c in measures.items()]
        self.looks.append((own, df, named))
        return df.observe(own, *named)

    @staticmethod
    def measured(own: Observation, df: DataFrame, named: list[Column]) -> dict[str, Any]:
        """What was observed; where the optimizer saw that rows are none and dropped the observation, the measures of ``df`` itself."""
        try:
            seen = own.get
        except Py4JJavaError:
            seen = {}
        return seen or df.agg(*named).first().asDict()

    def write(self, df: DataFrame, path: str, rules: list[Rule]) -> Outcome:
        df.write.parquet(path)
        metadata: dict[str, Any] = {"step": self.name, "path": path, "columns": df.columns}
        for look in self.looks:
            metadata |= self.measured(*look)
        spark = df.sparkSession
        said = [(level, self.name, message.format(**metadata)) for level, message, when in rules if when(metadata)]
        return Outcome(spark.read.schema(df.schema).parquet(path), metadata, spark.createDataFrame(said, "level string, step string, message string"))


def _share(part: str, whole: str) -> Callable[[dict[str, Any]], float]:
    return lambda m: m[part] / m[whole] if m[whole] else 0.0


def zonal_outcome(cells: DataFrame, edges: DataFrame, path: str, exact: bool = False) -> Outcome:
    """A1 with counts of cells, nulls and zones; zones without cells are a warning, mostly null cells are critical."""
    step, v = Step("zonal_statistics"), F.col("value")
    cells = step.look(cells, n_cells=F.count("*"), n_null=F.count_if(v.isNull()), lowest=F.min(v), highest=F.max(v))
    out = step.look(zonal_statistics(cells, edges, exact=exact), n_zones=F.count("*"), n_empty=F.count_if(F.col("count") == 0))
    nulls = _share("n_null", "n_cells")
    return step.write(out, path, [("warning", "{n_empty} of {n_zones} zones have no cells", lambda m: m["n_empty"] > 0), ("critical", "{n_null} of {n_cells} cells are null", lambda m: nulls(m) > 0.5), ("info", "{n_zones} zones", lambda m: True)])


def cooling_outcome(cells: DataFrame, forest: list[int], open_: list[int], path: str, min_pixels: int = 20) -> Outcome:
    """A5 with the valid share of the cells; few pixels of a group or few valid cells are warnings."""
    step = Step("cooling_differential")
    cells = step.look(cells, n_cells=F.count("*"), n_valid=F.count("value"))
    out = step.look(cooling_differential(cells, forest, open_, min_pixels=min_pixels), forest_n=F.max("forest_n"), open_n=F.max("open_n"))
    valid = _share("n_valid", "n_cells")
    return step.write(out, path, [("warning", f"fewer than {min_pixels} cells: {{forest_n}} of forest, {{open_n}} open", lambda m: min(m["forest_n"], m["open_n"]) < min_pixels), ("warning", "{n_valid} of {n_cells} cells are valid", lambda m: valid(m) < 0.5)])


def split_outcome(df: DataFrame, test: float, val: float, path: str) -> Outcome:
    """M11 with the rows of each partition; an empty training set is critical, an empty wanted one a warning."""
    step = Step("split_audit")
    df = step.look(df, n_rows=F.count("*"), n_without=F.count_if(F.col("partition").isNull()))
    out = step.look(split_audit(df, test, val), n_critical=F.count_if(F.col("level") == "critical"), n_warning=F.count_if(F.col("level") == "warning"), partitions=F.count("*"))
    return step.write(out, path, [("critical", "no training rows", lambda m: m["n_critical"] > 0), ("warning", "{n_warning} wanted partitions are empty", lambda m: m["n_warning"] > 0), ("warning", "{n_without} rows have no partition", lambda m: m["n_without"] > 0)])


def run_step(op: Callable[..., DataFrame], inputs: Mapping[str, DataFrame], params: Mapping[str, Any], path: str, rules: list[Rule] | None = None, measures: Mapping[str, Column] | None = None) -> Outcome:
    """Any operator as a step: named inputs and parameters in; result, metadata and warnings out, in one pass.

    Each input's rows are counted as ``n_<input>``, the result's as ``n_out``; ``measures`` are further aggregates of the
    result. Without ``rules`` an empty result is a warning. Names that ``op`` doesn't take, and names that it needs and
    that aren't given (or are None where it has no default), raise a ValueError before any job runs.
    """
    takes = inspect.signature(op).parameters
    given = {**inputs, **{k: v for k, v in params.items() if v is not None}}
    if unknown := sorted({*inputs, *params} - takes.keys()):
        raise ValueError(f"{op.__name__} takes no {unknown}; it takes {list(takes)}")
    if missing := [k for k, p in takes.items() if p.default is p.empty and p.kind is not p.VAR_KEYWORD and k not in given]:
        raise ValueError(f"{op.__name__} needs {missing}")
    step = Step(op.__name__)
    seen = {k: step.look(df, **{f"n_{k}": F.count("*")}) for k, df in inputs.items()}
    out = step.look(op(**{**given, **seen}), n_out=F.count("*"), **(measures or {}))
    return step.write(out, path, [("warning", "the result has no rows", lambda m: m["n_out"] == 0)] if rules is None else rules)


def filtered_outcome(df: DataFrame, expression: str, path: str) -> Outcome:
    """M4 with a user's SQL predicate: one that doesn't parse, names no column or isn't a condition raises a ValueError that
    quotes it, before any job; one that keeps nothing is a warning. Only SQL is evaluated, never code."""
    try:
        kept = sample_filtered(df, expression)
        kept.schema  # resolves the names
    except AnalysisException as e:
        raise ValueError(f"filter expression {expression!r}: {e}") from e
    step = Step("sample_filtered")
    return step.write(step.look(sample_filtered(step.look(df, n_before=F.count("*")), expression), n_after=F.count("*")), path, [("warning", "the filter kept none of {n_before} rows", lambda m: m["n_after"] == 0)])
