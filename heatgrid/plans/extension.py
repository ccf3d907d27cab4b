"""Queries of the extension points: steps with metadata and warnings, user predicates, estimators by name, moves and weights as data."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.operators import cooling, models, outcome, scores
from heatgrid.registry import query
from heatgrid.sources import standins
from heatgrid.sources.shared import new_folder

standins.SQL |= {
    # moves of each space; shares follow the number of its customers
    "moves": """SELECT space, ord, source, target, CAST((n + 3 * ord) % 8 AS DOUBLE) / 7.0E0 AS share FROM (SELECT c_nationkey % 3 AS space, count(*) AS n FROM {customer} GROUP BY 1) t
      CROSS JOIN (VALUES (1, 'impervious', 'grass'), (2, 'grass', 'canopy'), (3, 'absent', 'canopy'), (4, 'soil', 'no_such')) AS m(ord, source, target)""",
    "class_weights": "SELECT * FROM (VALUES ('canopy', 0.997E0), ('grass', 0.531E0), ('impervious', -0.473E0), ('water', 0.811E0), ('soil', 0.127E0)) AS t(cls, weight)",
}
MIN_PIXELS, RIDGE = 50, 2.5


def _path(df: DataFrame) -> str:
    return new_folder(df.sparkSession, "outcome")


def _rows(step: str, from_: str, measures: dict[str, str], rules: list[tuple[str, str, str]]) -> str:
    """SQL of ``Outcome.report``: measures of ``from_`` and (level, message, condition) over them."""
    head = f"WITH m AS (SELECT {', '.join(f'{x} AS {k}' for k, x in measures.items())} FROM {from_})"
    rows = [f"SELECT '{step}' AS step, 'metadata' AS part, '{k}' AS name, CAST({k} AS VARCHAR) AS value FROM m" for k in measures]
    rows += [f"SELECT '{step}', 'warning', '{level}', {message} FROM m WHERE {when}" for level, message, when in rules]
    return f"{head} {' UNION ALL '.join(rows)}"


query("e1_step_outcome", "lst_lc", _rows("cooling_differential", "{lst_lc} t", {"n_cells": "count(*)", "n_valid": "count(value)", "forest_n": "count(value) FILTER (code = 10)", "open_n": "count(value) FILTER (code = 30)"},
    [("warning", f"concat('fewer than {MIN_PIXELS} cells: ', forest_n, ' of forest, ', open_n, ' open')", f"least(forest_n, open_n) < {MIN_PIXELS}"), ("warning", "concat(n_valid, ' of ', n_cells, ' cells are valid')", "n_valid < n_cells * 0.5")]))(
    lambda c: outcome.cooling_outcome(c, [10], [30], _path(c), MIN_PIXELS).report())
query("e1_any_operator", "readings", _rows("scene_rollup", "(SELECT count(*) AS n FROM {readings} r) a, (SELECT count(*) AS groups, count(*) FILTER (k < 3) AS few FROM (SELECT count(green) AS k FROM {readings} r GROUP BY scene, model)) b", {"n_rows": "max(n)", "n_out": "max(groups)", "n_small": "max(few)"},
    [("warning", "concat(n_small, ' of ', n_out, ' groups are small')", "n_small > 0")]))(
    lambda r: outcome.run_step(cooling.scene_rollup, {"rows": r}, {"by": ["scene", "model"], "value": "green"}, _path(r), [("warning", "{n_small} of {n_out} groups are small", lambda m: m["n_small"] > 0)], {"n_small": F.count_if(F.col("n") < 3)}).report())
_FILTERS = ("value > 50 AND stratum LIKE '%e%'", "value < 0 AND value > 0")
query("e2_user_filter", "samples", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_rows("sample_filtered", "{samples} s", {"n_before": "count(*)", "n_after": f"count(*) FILTER ({f})"}, [("warning", "concat('the filter kept none of ', n_before, ' rows')", "n_after = 0")]) for f in _FILTERS) + ")")(
    lambda s: reduce(DataFrame.unionByName, [outcome.filtered_outcome(s, f, _path(s)).report() for f in _FILTERS]))


def by_name(df: DataFrame) -> DataFrame:
    """Scores of a regressor that the library has and of one that a user adds."""
    models.register_estimator("ridge", lambda trees: LinearRegression(regParam=RIDGE, solver="normal"), regression=True)
    done = [models.apply_regressor(models.train_regressor(df, "y", ["x1"], name), df).select(F.lit(name).alias("model"), "y", "pred") for name in ("linear", "ridge")]
    return reduce(DataFrame.unionByName, [scores.score_regression(d, "y", "pred").select(F.lit(n).alias("model"), "n", "rmse", "r2") for n, d in zip(("linear", "ridge"), done, strict=True)])


# a ridge on standardised columns divides the slope by 1 + penalty / deviation of y
query("e3_estimators_by_name", "regress", f"""WITH f AS (SELECT regr_slope(y, x1) AS b, avg(x1) AS mx, avg(y) AS my, stddev_pop(y) AS s FROM {{regress}} t),
e AS (SELECT model, y, my, my + b / (1 + CASE model WHEN 'ridge' THEN {RIDGE} ELSE 0 END::DOUBLE / s) * (x1 - mx) AS pred FROM {{regress}} t, f, (VALUES ('linear'), ('ridge')) k(model))
SELECT model, count(*) AS n, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse, round(1 - sum((y - pred) ** 2) / sum((y - my) ** 2), 4) AS r2 FROM e GROUP BY model""")(by_name)  # fmt: skip
query("e4_moves_and_weights", "coarse_composition class_weights moves", """WITH c AS (SELECT space, cls, round(fraction, 5) AS f FROM {coarse_composition} c), s AS (SELECT space, max(share) FILTER (ord = 1) AS s1, max(share) FILTER (ord = 2) AS s2 FROM {moves} m GROUP BY space),
a AS (SELECT *, round(max(CASE WHEN cls = 'impervious' THEN f END) OVER (PARTITION BY space) * s1, 5) AS p1, max(CASE WHEN cls = 'grass' THEN f END) OVER (PARTITION BY space) AS gf FROM c JOIN s USING (space)),
b AS (SELECT *, round(round(gf + p1, 5) * s2, 5) AS p2 FROM a),
d AS (SELECT space, weight * f AS x, weight * CASE cls WHEN 'impervious' THEN round(f - p1, 5) WHEN 'grass' THEN round(round(gf + p1, 5) - p2, 5) WHEN 'canopy' THEN round(f + p2, 5) ELSE f END AS z FROM b JOIN {class_weights} w USING (cls))
SELECT space, round(sum(x), 4) AS index_before, round(sum(z), 4) AS index_after, round(round(sum(z), 4) - round(sum(x), 4), 4) AS delta FROM d GROUP BY space""")(cooling.counterfactual_from_tables)  # fmt: skip
