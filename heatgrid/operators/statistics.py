"""Correlation and regression from one pass of sums: only p x p numbers reach the driver, whatever the rows are."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.sampling import bootstrap_correlations

#: share of a column's squares below which the others are said to explain it whole
ALIASED = 1e-7
#: least eigenvalue of correlations below which some column is said to follow exactly from the others
DEPENDENT = 1e-12


class Gram:
    """n, means and centred cross products of the columns, from rows where all are present."""

    def __init__(self, df: DataFrame, cols: list[str]):
        rows = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
        one = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.covar_pop(a, b).alias(f"s_{a}_{b}") for a, b in pairs]).first()
        self.cols, self.n = list(cols), one["n"]
        self.mean = np.array([one[f"m_{c}"] or 0.0 for c in cols])
        self.s = np.zeros((len(cols), len(cols)))
        for a, b in pairs:
            i, j = cols.index(a), cols.index(b)
            self.s[i, j] = self.s[j, i] = (one[f"s_{a}_{b}"] or 0.0) * self.n

    def part(self, names: list[str]) -> np.ndarray:
        at = [self.cols.index(c) for c in names]
        return self.s[np.ix_(at, at)]

    def correlation(self, *names: str) -> np.ndarray:
        s = self.part(list(names)) if names else self.s
        d = np.sqrt(np.diag(s))
        return s / np.outer(d, d)


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * f


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return _beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p(x: float, k: float) -> float:
    """Upper tail of chi-square: series below, continued fraction above the mean."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= y / (a + i)
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = y + 1 - a, 1e300, 1 / (y + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def chi2_1_quantile(p: float) -> float:
    """x with P(chi-square of one degree > x) = p."""
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return low


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def _p_of_r(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _partial(c: np.ndarray, v: int, controls: list[int]) -> float | None:
    """Correlation of the first column and ``v`` without what ``controls`` explain, which may depend on one another; None where
    they explain all of either."""
    if not np.isfinite(c[np.ix_([0, v, *controls], [0, v, *controls])]).all():
        return None
    left = c[np.ix_([0, v], [0, v])] - c[np.ix_([0, v], controls)] @ np.linalg.pinv(c[np.ix_(controls, controls)], rcond=ALIASED) @ c[np.ix_(controls, [0, v])]
    if min(left[0, 0], left[1, 1]) <= ALIASED:
        return None
    return float(np.clip(left[0, 1] / math.sqrt(left[0, 0] * left[1, 1]), -1, 1))


def correlation(df: DataFrame, response: str, predictors: list[str], controls: list[str] | None = None, n_boot: int = 0, level: float = 0.95, seed: int = 1, id_col: str = "id") -> DataFrame:
    """r, p and stars of each predictor, by falling |r|; with ``controls`` also partial r and p (n - 2 degrees); with ``n_boot`` percentile intervals."""
    g = Gram(df, [response, *predictors, *(controls or [])])
    c, out = g.correlation(), []
    a = (1 - level) / 2
    ends = {}
    if n_boot:
        resampled = bootstrap_correlations(df, response, predictors, n_boot, seed, id_col)
        ends = {r[0]: (r[1], r[2]) for r in resampled.groupBy("variable").agg(F.percentile("r", a), F.percentile("r", 1 - a)).collect()}  # a row for each predictor
    for v in predictors:
        r = float(c[0, g.cols.index(v)])
        p = _p_of_r(r, g.n)
        partial_r = partial_p = None
        low, high = ends.get(v, (None, None))
        if controls:
            partial_r = _partial(c, g.cols.index(v), [g.cols.index(x) for x in controls])
            partial_p = None if partial_r is None else _p_of_r(partial_r, g.n)
        four = lambda x: None if x is None else round(x, 4)
        out.append((v, four(r), four(p), four(low), four(high), four(partial_r), four(partial_p), stars(p)))
    out.sort(key=lambda x: (-abs(x[1]), x[0]))
    return df.sparkSession.createDataFrame(out, "variable string, r double, p_value double, ci_low double, ci_high double, partial_r double, partial_p double, significance string")


class Fit:
    """Ordinary least squares of ``y`` on ``xs`` with an intercept, from a Gram table."""

    def __init__(self, g: Gram, y: str, xs: list[str]):
        s = g.part([y, *xs])
        self.g, self.y, self.xs, self.n, self.k = g, y, xs, g.n, len(xs)
        self.inv = np.linalg.inv(s[1:, 1:]) if xs else np.zeros((0, 0))
        self.b = self.inv @ s[1:, 0]
        self.tot = s[0, 0]
        self.rss = max(float(s[0, 0] - self.b @ s[1:, 0]), 0.0)
        self.b0 = float(g.mean[g.cols.index(y)] - sum(b * g.mean[g.cols.index(x)] for b, x in zip(self.b, xs, strict=True)))

    def aic(self, penalty: float) -> float:
        return self.n * math.log(max(self.rss, 1e-300) / self.n) + penalty * (self.k + 1)

    def table(self) -> list[tuple]:
        df = self.n - self.k - 1
        s2 = self.rss / df
        means = np.array([self.g.mean[self.g.cols.index(x)] for x in self.xs])
        se0 = math.sqrt(s2 * (1 / self.n + means @ self.inv @ means))
        rows = [("(Intercept)", self.b0, se0, None)]
        sd_y = math.sqrt(self.tot)
        for i, x in enumerate(self.xs):
            rows.append((x, float(self.b[i]), math.sqrt(s2 * self.inv[i, i]), float(self.b[i]) * math.sqrt(self.g.part([x])[0, 0]) / sd_y))
        out = []
        for name, b, se, beta in rows:
            t = b / se if se else math.inf
            p = t_p(t, df) if se else 0.0
            out.append((name, b, se, t, p, beta, stars(p)))
        return out

    def r2(self) -> float:
        return 1 - self.rss / self.tot


def stepwise(g: Gram, y: str, xs: list[str], direction: str = "backward", p_remove: float = 0.11, p_enter: float = 0.10) -> Fit:
    """AIC-like steps with the penalty that the p-value stands for; every candidate is solved on the Gram table.
    Columns that depend on those before them take no part."""
    xs = unaliased(g, xs)
    penalty = chi2_1_quantile(p_remove if direction == "backward" else p_enter)
    used = list(xs) if direction == "backward" else []
    while True:
        best = Fit(g, y, used)
        options = [[x for x in used if x != d] for d in used] if direction in ("backward", "both") else []
        options += [[*used, x] for x in xs if x not in used] if direction in ("forward", "both") else []
        tried = [(Fit(g, y, o).aic(penalty), o) for o in options]
        if not tried or min(tried)[0] >= best.aic(penalty) - 1e-9:
            return best
        used = min(tried)[1]


def vif(g: Gram, xs: list[str]) -> dict[str, float]:
    """Variance factors; infinite for columns that the others explain whole, whose inverse would be rounding errors."""
    c = g.correlation(*xs)
    if not np.isfinite(c).all() or np.linalg.eigvalsh(c)[0] > DEPENDENT:
        return dict(zip(xs, np.diag(np.linalg.inv(c)).tolist(), strict=True))
    out = {}
    for i, x in enumerate(xs):
        rest = [j for j in range(len(xs)) if j != i]
        left = 1 - c[i, rest] @ np.linalg.pinv(c[np.ix_(rest, rest)], rcond=ALIASED) @ c[rest, i]
        out[x] = float(1 / left) if left > ALIASED else math.inf
    return out


def vif_prune(g: Gram, xs: list[str], threshold: float = 7.5) -> list[str]:
    xs = list(xs)
    while len(xs) > 1:
        v = vif(g, xs)
        worst = max(xs, key=lambda x: v[x])
        if v[worst] == math.inf:  # factors are det(the others) / det(all): the largest of them, whatever the rounding of det(all)
            worst = max((x for x in xs if v[x] == math.inf), key=lambda x: np.linalg.det(g.correlation(*[o for o in xs if o != x])))
        if v[worst] <= threshold:
            break
        xs.remove(worst)
    return xs


def unaliased(g: Gram, xs: list[str]) -> list[str]:
    """``xs`` without constants and without those that the ones before them explain but for a ten-millionth."""
    kept: list[str] = []
    for x in xs:
        s = g.part([x, *kept])
        left = s[0, 0] - (s[0, 1:] @ np.linalg.solve(s[1:, 1:], s[1:, 0]) if kept else 0.0)
        if s[0, 0] > 0 and left > ALIASED * s[0, 0]:
            kept.append(x)
    return kept


SUMMARY = "variable string, estimate double, std_error double, t_value double, p_value double, std_beta double, significance string"


def ols_summary(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(Fit(Gram(df, [y, *xs]), y, xs).table(), SUMMARY)


def regression(df: DataFrame, y: str, xs: list[str], direction: str = "backward", threshold: float = 7.5) -> DataFrame:
    """Stepwise choice, then VIF pruning, then the coefficient table."""
    g = Gram(df, [y, *xs])
    chosen = vif_prune(g, stepwise(g, y, xs, direction).xs, threshold)
    return df.sparkSession.createDataFrame(Fit(g, y, chosen).table(), SUMMARY)


def diagnostics(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(metric, value): fit, Breusch-Pagan, Jarque-Bera (in place of Shapiro-Wilk, a single-machine test) and condition number."""
    rows = df.dropna(subset=[y, *xs])
    g = Gram(rows, [y, *xs])
    fit = Fit(g, y, xs)
    residual = F.col(y) - fit.b0 - sum((F.col(x) * float(b) for x, b in zip(xs, fit.b, strict=True)), F.lit(0.0))
    with_e = rows.withColumn("_e2", residual * residual).withColumn("_e", residual)
    bp = Fit(Gram(with_e, ["_e2", *xs]), "_e2", xs)
    lm = g.n * bp.r2()
    shape = with_e.agg(F.skewness("_e").alias("s"), F.kurtosis("_e").alias("k")).first()
    jb = g.n / 6 * (shape["s"] ** 2 + shape["k"] ** 2 / 4)
    df2 = g.n - fit.k - 1
    f = (fit.r2() / fit.k) / ((1 - fit.r2()) / df2)
    values = {"n": float(g.n), "r_squared": fit.r2(), "adj_r_squared": 1 - (1 - fit.r2()) * (g.n - 1) / df2, "f_statistic": f, "f_p_value": f_p(f, fit.k, df2), "bp_statistic": lm, "bp_p_value": chi2_p(lm, fit.k), "heteroscedastic": float(chi2_p(lm, fit.k) < 0.05), "jb_statistic": jb, "jb_p_value": chi2_p(jb, 2), "normal": float(chi2_p(jb, 2) >= 0.05), "condition_number": condition_number(g, xs), **{f"vif_{k}": v for k, v in vif(g, xs).items()}}
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


def condition_number(g: Gram, xs: list[str]) -> float:
    """Of [X, 1]."""
    mean = np.array([g.mean[g.cols.index(x)] for x in xs])
    full = np.zeros((len(xs) + 1, len(xs) + 1))
    full[:-1, :-1] = g.part(xs) + g.n * np.outer(mean, mean)
    full[:-1, -1] = full[-1, :-1] = g.n * mean
    full[-1, -1] = g.n
    v = np.linalg.eigvalsh(full)
    return math.sqrt(v[-1] / v[0]) if v[0] > 0 else math.inf


def fitted(df: DataFrame, train: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``pred`` by the model fitted on ``train``."""
    fit = Fit(Gram(train, [y, *xs]), y, xs)
    return df.withColumn("pred", fit.b0 + sum((F.col(x) * float(b) for x, b in zip(xs, fit.b, strict=True)), F.lit(0.0)))
