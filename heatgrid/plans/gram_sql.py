"""DuckDB SQL of least squares by determinants: the check of what ``operators/statistics`` does with matrices and continued fractions."""

from __future__ import annotations

from itertools import combinations

#: Simpson steps of a probability
_STEPS = 2000


def s(a: str, b: str) -> str:
    return f"s_{min(a, b)}_{max(a, b)}"


def det(rows: list[str], cols: list[str]) -> str:
    """Determinant of the cross products of ``rows`` and ``cols``, by its first row."""
    if not rows:
        return "1"
    terms = [f"{'-' if i % 2 else '+'} {s(rows[0], c)} * {det(rows[1:], [x for x in cols if x != c])}" for i, c in enumerate(cols)]
    return f"({' '.join(terms).removeprefix('+ ')})"


def gram(source: str, cols: list[str]) -> str:
    """One row: n, means m_ and centred cross products s_ of complete rows."""
    pairs = [(a, b) for i, a in enumerate(sorted(cols)) for b in sorted(cols)[i:]]
    return f"SELECT count(*)::DOUBLE AS n, {', '.join(f'avg({c}) AS m_{c}' for c in cols)}, {', '.join(f'covar_pop({a}, {b}) * count(*) AS {s(a, b)}' for a, b in pairs)} FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}"


def subsets(xs: list[str]) -> list[tuple[int, list[str]]]:
    """(mask, columns) of every choice; bit i stands for column i."""
    return [(sum(1 << xs.index(x) for x in c), list(c)) for k in range(len(xs) + 1) for c in combinations(xs, k)]


def fits(y: str, xs: list[str]) -> str:
    """(mask, k, rss, n) of each choice of columns, from table g."""
    return " UNION ALL ".join(f"SELECT {m} AS mask, {len(c)} AS k, {det([y, *c], [y, *c])} / {det(c, c)} AS rss, n FROM g" for m, c in subsets(xs))


def vifs(xs: list[str]) -> str:
    """(mask, i, vif) of each column of each choice, from table g."""
    without = lambda c, v: [x for x in c if x != v]
    return " UNION ALL ".join(f"SELECT {m} AS mask, {xs.index(v)} AS i, {s(v, v)} * {det(without(c, v), without(c, v))} / {det(c, c)} AS vif FROM g" for m, c in subsets(xs) for v in c)


def pruned(start: str, threshold: float = 7.5) -> str:
    """Body of a recursive table (mask, step): the worst column goes while its factor is above ``threshold`` and others stay."""
    return f"SELECT ({start}) AS mask, 0 AS step UNION ALL SELECT arg_max(v.mask - (1 << v.i), v.vif)::INT, max(step)::INT + 1 FROM pruned p JOIN vifs v ON v.mask = p.mask WHERE bit_count(p.mask) > 1 HAVING max(v.vif) > {threshold}"


def walk(direction: str, width: int, penalty: float) -> str:
    """Body of a recursive table (mask, aic): from all columns or none to the best neighbour, while that is better."""
    aic = lambda t: f"({t}.n * ln({t}.rss / {t}.n) + {penalty!r} * ({t}.k + 1))"
    side = {"backward": "AND b.mask < p.mask", "forward": "AND b.mask > p.mask", "both": ""}[direction]
    first = (1 << width) - 1 if direction == "backward" else 0
    return f"SELECT mask, {aic('a')} AS aic FROM fits a WHERE mask = {first} UNION ALL SELECT arg_min(b.mask, {aic('b')})::INT, min({aic('b')}) FROM walk p JOIN fits b ON bit_count(xor(b.mask, p.mask)) = 1 {side} WHERE {aic('b')} < p.aic - 1e-9 HAVING count(*) > 0"


def coefficients(y: str, xs: list[str]) -> str:
    """(mask, variable, estimate, std_error, std_beta, df) of each choice, from tables g and fits."""
    out = []
    for m, c in subsets(xs):
        b = {v: _replaced(y, c, v) for v in c}
        inv = {(v, w): f"{'-' if (c.index(v) + c.index(w)) % 2 else ''}{det([x for x in c if x != v], [x for x in c if x != w])} / {det(c, c)}" for v in c for w in c}
        s2 = f"(rss / (n - {len(c) + 1}))"
        spread = " + ".join(["1 / n", *[f"m_{v} * m_{w} * ({inv[v, w]})" for v in c for w in c]])
        join = f"FROM g JOIN (SELECT mask, rss FROM fits WHERE mask = {m}) ON true"
        out.append(f"SELECT {m} AS mask, '(Intercept)' AS variable, m_{y}{''.join(f' - m_{v} * ({b[v]})' for v in c)} AS estimate, sqrt({s2} * ({spread})) AS std_error, NULL::DOUBLE AS std_beta, n - {len(c) + 1} AS df {join}")
        out += [f"SELECT {m}, '{v}', {b[v]}, sqrt({s2} * ({inv[v, v]})), ({b[v]}) * sqrt({s(v, v)} / {s(y, y)}), n - {len(c) + 1} {join}" for v in c]
    return " UNION ALL ".join(out)


def _replaced(y: str, c: list[str], v: str) -> str:
    """Coefficient of ``v`` by Cramer's rule: its column stands for ``y``."""
    return f"{det(c, [y if x == v else x for x in c])} / {det(c, c)}"


def simpson(f: str, end: str) -> str:
    """Integral of ``f`` (of w) from 0 to ``end``."""
    at = f"list_transform(range({_STEPS} + 1), lambda i: (CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('{w}', f'(({end}) * i / {_STEPS})')}))"
    return f"(list_sum({at}) * ({end}) / {3 * _STEPS})"


def t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t, 0 beyond 40."""
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * (1 + {{w}} * {{w}} / {df}) ** (-({df} + 1) / 2)"
    return f"CASE WHEN abs({t}) > 40 THEN 0 ELSE greatest(0, 1 - 2 * {simpson(density, f'abs({t})')}) END"


def chi2_p(x: str, k: int) -> str:
    """Upper tail for 2 or more degrees, by the square root of the value."""
    density = f"2 * {{w}} ** {k - 1} * exp(-{{w}} * {{w}} / 2 - {k / 2} * ln(2) - lgamma({k / 2}))"
    return f"greatest(0, 1 - {simpson(density, f'sqrt({x})')})"


def f_p(f: str, d1: int, d2: str) -> str:
    density = f"2 * {{w}} ** {d1 - 1} * exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1 / 2}) - lgamma({d2} / 2) + {d1 / 2} * ln({d1} / {d2}) - ({d1} + {d2}) / 2 * ln(1 + {d1} * {{w}} * {{w}} / {d2}))"
    return f"greatest(0, 1 - {simpson(density, f'sqrt({f})')})"


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"


def newton(xs: list[str]) -> str:
    """Tables poly, low and high: the characteristic polynomial of [X, 1]'[X, 1] by its principal minors, and Newton steps to
    its least root from 0 and to its largest from the trace."""
    names = [*xs, "one"]
    entries = [f"{s(a, b)} + n * m_{a} * m_{b} AS {s('q' + a, 'q' + b)}" for i, a in enumerate(sorted(xs)) for b in sorted(xs)[i:]] + [f"n * m_{a} AS {s('q' + a, 'qone')}" for a in xs] + [f"n AS {s('qone', 'qone')}"]
    e = [" + ".join(det([f"q{x}" for x in c], [f"q{x}" for x in c]) for c in combinations(names, k)) for k in range(1, len(names) + 1)]
    size = len(names)
    p = lambda at: " ".join(f"{'-' if k % 2 else '+'} e{k} * {at} ** {size - k}" for k in range(size + 1))
    d = lambda at: " ".join(f"{'-' if k % 2 else '+'} {size - k} * e{k} * {at} ** {size - k - 1}" for k in range(size))
    step = lambda name, first: f"{name} AS (SELECT {first} AS v, 0 AS i FROM poly UNION ALL SELECT v - ({p('v')}) / ({d('v')}), i + 1 FROM {name}, poly WHERE i < 60)"
    return f"poly AS (SELECT 1 AS e0, {', '.join(f'{x} AS e{k + 1}' for k, x in enumerate(e))} FROM (SELECT {', '.join(entries)} FROM g)), {step('low', '0::DOUBLE')}, {step('high', 'e1')}"


CONDITION = "(SELECT sqrt((SELECT arg_max(v, i) FROM high) / (SELECT arg_max(v, i) FROM low)))"
