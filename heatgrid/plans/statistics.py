"""Queries of correlation and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import scores
from heatgrid.operators import statistics as op
from heatgrid.operators.sampling import holdout
from heatgrid.plans import gram_sql as ls
from heatgrid.registry import query

XS = ["x1", "x2", "x3"]
_CORR = " UNION ALL ".join(f"SELECT '{x}' AS variable, round(corr(y, {x}), 4) AS r FROM {{regress}} t WHERE x3 IS NOT NULL" for x in XS)
query("x3_correlation", "regress", _CORR)(lambda df: op.correlation(df, "y", XS).select("variable", "r"))
query("t1_strongest", "regress", f"SELECT variable, r FROM ({_CORR}) ORDER BY abs(r) DESC, variable LIMIT 2")(lambda df: op.correlation(df, "y", XS).select("variable", "r").orderBy(F.abs("r").desc(), "variable").limit(2))
_P = ls.t_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")
_EACH_R = " UNION ALL ".join(f"SELECT '{x}' AS variable, corr(y, {x}) AS r, count(*)::DOUBLE AS n FROM {{regress}} t WHERE x3 IS NOT NULL" for x in XS)
query("x3_correlation_p", "regress", f"SELECT variable, round(r, 4) AS r, round(p, 4) AS p_value, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, NULL::DOUBLE AS partial_r, NULL::DOUBLE AS partial_p, {ls.stars('p')} AS significance FROM (SELECT variable, r, {_P} AS p FROM ({_EACH_R}))")(lambda df: op.correlation(df, "y", XS))
query("x4_bootstrap_ci", "regress")(lambda df: op.correlation(df, "y", ["x1"], n_boot=200))
query("x5_partial_correlation", "regress", """SELECT variable, round((ryx - ryc * rxc) / sqrt((1 - ryc ** 2) * (1 - rxc ** 2)), 4) AS partial_r FROM (
  SELECT 'x1' AS variable, corr(y, x1) AS ryx, corr(y, x2) AS ryc, corr(x1, x2) AS rxc FROM {regress} t UNION ALL SELECT 'x3', corr(y, x3), corr(y, x2), corr(x3, x2) FROM {regress} u)""")(lambda df: op.correlation(df, "y", ["x1", "x3"], ["x2"]).select("variable", "partial_r"))  # fmt: skip
query("x8_ols_summary", "regress", """SELECT 'x1' AS variable, round(regr_slope(y, x1), 4) AS estimate, round(corr(y, x1), 4) AS std_beta FROM {regress} t UNION ALL SELECT '(Intercept)', round(regr_intercept(y, x1), 4), NULL FROM {regress} u""")(
    lambda df: op.ols_summary(df, "y", ["x1"]).select("variable", F.round("estimate", 4).alias("estimate"), F.round("std_beta", 4).alias("std_beta")))
_FIVE = {"estimate": 4, "std_error": 4, "t_value": 3, "p_value": 4, "std_beta": 4}
_GRAM = f"g AS MATERIALIZED ({ls.gram('{regress} t', ['y', *XS])}), fits AS MATERIALIZED ({ls.fits('y', XS)}), vifs AS MATERIALIZED ({ls.vifs(XS)})"
for _d in ("backward", "forward", "both"):
    _penalty = op.chi2_1_quantile(0.11 if _d == "backward" else 0.10)
    query(f"x6_stepwise_{_d}", "regress", f"""WITH RECURSIVE {_GRAM}, walk AS ({ls.walk(_d, len(XS), _penalty)}), pruned AS ({ls.pruned('SELECT arg_min(mask, aic) FROM walk')}), c AS ({ls.coefficients('y', XS)}),
 r AS (SELECT variable, estimate, std_error, estimate / std_error AS t_value, {ls.t_p('(estimate / std_error)', 'df')} AS p_value, std_beta FROM c WHERE mask = (SELECT arg_max(mask, step) FROM pruned))
 SELECT variable, {', '.join(f'round({k}, {v}) AS {k}' for k, v in _FIVE.items())}, {ls.stars('p_value')} AS significance FROM r""")(lambda df, d=_d: op.regression(df, "y", XS, d).withColumns({k: F.round(k, v) for k, v in _FIVE.items()}))  # fmt: skip
_FOUR = ["x1", "x2", "x3", "x4"]
query("x7_vif_prune", "regress", f"""WITH RECURSIVE g AS MATERIALIZED ({ls.gram('(SELECT *, x1 + x2 * 0.001::DOUBLE AS x4 FROM {regress} t)', _FOUR)}), vifs AS MATERIALIZED ({ls.vifs(_FOUR)}), pruned AS ({ls.pruned('SELECT 15')})
 SELECT 'x' || (i + 1) AS variable FROM range(4) t(i) WHERE (SELECT arg_max(mask, step) FROM pruned) & (1 << i) > 0""")(lambda df: df.sparkSession.createDataFrame([(x,) for x in op.vif_prune(op.Gram(df.withColumn("x4", F.col("x1") + F.col("x2") * 0.001), _FOUR), _FOUR)], "variable string"))
_R2 = "(1 - rss / s_y_y)"
_F = f"(({_R2} / 3) / ((1 - {_R2}) / (n - 4)))"
_E = f"y - (SELECT m_y{''.join(f' - m_{x} * ({ls._replaced("y", XS, x)})' for x in XS)} FROM g){''.join(f' - {x} * (SELECT {ls._replaced("y", XS, x)} FROM g)' for x in XS)}"
_NEWTON = f"WITH RECURSIVE {_GRAM}, {ls.newton(XS)}"
query("x9_diagnostics", "regress", f"""{_NEWTON}, e AS MATERIALIZED (SELECT x1, x2, x3, {_E} AS e FROM {{regress}} t WHERE x3 IS NOT NULL), h AS ({ls.gram('(SELECT x1, x2, x3, e * e AS z FROM e)', ['z', *XS])}),
 m AS (SELECT avg(e) AS m FROM e), shape AS (SELECT avg((e - m) ** 3) / avg((e - m) ** 2) ** 1.5 AS a, avg((e - m) ** 4) / avg((e - m) ** 2) ** 2 - 3 AS k FROM e, m),
 q AS (SELECT n, {_R2} AS r2, {_F} AS f, {ls.f_p(_F, 3, '(n - 4)')} AS fp FROM (SELECT g.*, rss FROM g JOIN fits ON mask = 7)), bp AS (SELECT n * (1 - {ls.det(['z', *XS], ['z', *XS])} / {ls.det(XS, XS)} / s_z_z) AS lm FROM h), bq AS (SELECT lm, {ls.chi2_p('lm', 3)} AS p FROM bp), jb AS (SELECT n / 6 * (a * a + k * k / 4) AS v FROM shape, q)
 SELECT metric, round(value, 3) AS value FROM (SELECT unnest([{{'metric': 'n', 'value': n}}, {{'metric': 'r_squared', 'value': r2}}, {{'metric': 'adj_r_squared', 'value': 1 - (1 - r2) * (n - 1) / (n - 4)}}, {{'metric': 'f_statistic', 'value': f}}, {{'metric': 'f_p_value', 'value': fp}}, {{'metric': 'bp_statistic', 'value': lm}}, {{'metric': 'bp_p_value', 'value': p}}, {{'metric': 'heteroscedastic', 'value': (p < 0.05)::INT::DOUBLE}},
   {{'metric': 'jb_statistic', 'value': v}}, {{'metric': 'jb_p_value', 'value': exp(-v / 2)}}, {{'metric': 'normal', 'value': (exp(-v / 2) >= 0.05)::INT::DOUBLE}}, {{'metric': 'condition_number', 'value': {ls.CONDITION}}}], recursive := true) FROM q, bq, jb UNION ALL SELECT 'vif_x' || (i + 1), vif FROM vifs WHERE mask = 7)""")(lambda df: op.diagnostics(df, "y", XS).withColumn("value", F.round("value", 3)))  # fmt: skip
query("x15_condition_number", "regress", f"{_NEWTON} SELECT 'condition_number' AS metric, round({ls.CONDITION}, 3) AS value")(lambda df: op.diagnostics(df, "y", XS).where("metric = 'condition_number'").withColumn("value", F.round("value", 3)))


def _scored(df):
    parts = holdout(df.dropna(subset=XS), 0.25, 7)
    return scores.score_regression(op.fitted(parts.where("partition = 'test'"), parts.where("partition = 'train'"), "y", XS), "y", "pred")


_C = {(a, b): f"covar_pop({a}, {b})" for i, a in enumerate(["y", *XS]) for b in ["y", *XS][i:]}
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def _cramer() -> str:
    """SQL: coefficients of y on XS by Cramer's rule over the covariances of table tr."""
    cols = ", ".join(f"{v} AS c_{a}_{b}" for (a, b), v in _C.items()) + "".join(f", avg({x}) AS m_{x}" for x in ["y", *XS])
    at = lambda a, b: f"c_{a}_{b}" if (a, b) in _C else f"c_{b}_{a}"
    det = lambda put: _DET.format(*[at("y", r) if c == put else at(r, c) for r in XS for c in XS])
    return f"SELECT *, {', '.join(f'{det(x)} / {det(None)} AS b_{x}' for x in XS)} FROM (SELECT {cols} FROM tr)"


query("x10_holdout_score", "regress", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '_7'), id) - 1 AS k, count(*) OVER () AS n FROM {{regress}} t WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
 tr AS (SELECT * FROM r WHERE k >= floor(n * 0.25)), f AS ({_cramer()}),
 p AS (SELECT y AS truth, m_y + {' + '.join(f'b_{x} * ({x} - m_{x})' for x in XS)} AS pred FROM r, f WHERE k < floor(n * 0.25))
 SELECT count(*) AS n, round(1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*)), 4) AS r2, round(sqrt(avg((truth - pred) ** 2)), 4) AS rmse, round(avg(abs(truth - pred)), 4) AS mae FROM p""")(_scored)  # fmt: skip
