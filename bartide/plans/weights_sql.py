"""The weight problems of small books in SQL: recursive solvers over lists, one row per book and round.

A source table has k (key of a book), c (covariance as a list of rows), t (tilt) and usable. Each solver table ends with
(k, w): the weights of usable books in order of their symbols."""

from __future__ import annotations

# covariance rows of books: cells (k, i, j, cov) to one list of lists; a book with a missing cell is not usable
MATRICES = """
SELECT k, list(line ORDER BY i) AS c, list(i ORDER BY i) AS symbols, bool_and(len(line) = n AND NOT list_contains(known, false)) AS usable, n FROM (
  SELECT k, i, list(cov ORDER BY j) AS line, list(cov IS NOT NULL ORDER BY j) AS known, any_value(n) AS n FROM (SELECT *, count(DISTINCT i) OVER (PARTITION BY k) AS n FROM {cells}) GROUP BY k, i) GROUP BY k, n"""


def pair_descent(name: str, source: str, low: float, high: float, rounds: int = 4000) -> dict[str, str]:
    """Minimum of w'Cw - t'w with sum 1 and bounds: weight moves between the most violating pair until their gap is closed."""
    state = f"""
SELECT k, w, g, step, list_position(rise, list_min(rise)) AS up, list_position(fall, list_max(fall)) AS down, list_max(list_transform(g, lambda x: abs(x))) AS size FROM (
  SELECT *, list_transform(w, lambda x, i: CASE WHEN x < {high!r} - 1e-15 THEN g[i] ELSE 1e300 END) AS rise,
            list_transform(w, lambda x, i: CASE WHEN x > {low!r} + 1e-15 THEN g[i] ELSE -1e300 END) AS fall FROM {name}_path)"""
    return {
        f"{name}_in": f"SELECT k, c, t, len(t) AS n FROM ({source}) WHERE usable AND len(t) * {low!r} <= 1 AND len(t) * {high!r} >= 1",
        f"{name}_path": f"""
SELECT k, list_transform(t, lambda x: 1.0::DOUBLE / n) AS w, list_transform(c, lambda r, i: 2 * list_sum(r) / n - t[i]) AS g, 0 AS step FROM {name}_in
UNION ALL
SELECT k, list_transform(w, lambda x, i: x + CASE WHEN i = up THEN s WHEN i = down THEN -s ELSE 0.0 END), list_transform(g, lambda x, i: x + 2 * s * (c[up][i] - c[down][i])), step + 1 FROM (
  SELECT q.*, c, CASE WHEN c[up][up] + c[down][down] - 2 * c[up][down] > 0
    THEN least(least({high!r} - w[up], w[down] - {low!r}), (g[down] - g[up]) / (2 * (c[up][up] + c[down][down] - 2 * c[up][down]))) ELSE least({high!r} - w[up], w[down] - {low!r}) END AS s
  FROM ({state}) q JOIN {name}_in USING (k) WHERE g[down] - g[up] > 1e-12 * (1 + size) AND step < {rounds})""",
        name: f"SELECT k, arg_max(w, step) AS w FROM {name}_path GROUP BY k"}


def _swept(start: str, update: str, sweeps: int) -> str:
    """`start` after sweeps over all members, member i being replaced by `update` of acc, c and i."""
    order = f"flatten(list_transform(range({sweeps}), lambda z: list_transform(range(1, n + 1), lambda m: [m::DOUBLE])))"
    return f"list_reduce(list_concat([{start}], {order}), lambda acc, m: list_transform(acc, lambda x, h: CASE WHEN h = m[1] THEN {update} ELSE x END))"


def level_contributions(name: str, source: str, low: float, high: float) -> dict[str, str]:
    """Equal contributions w_i (Cw)_i = b within bounds; b by halving on a log scale until the weights add up to 1."""
    i = "CAST(m[1] AS INTEGER)"
    pull = f"(list_dot_product(c[{i}], acc) - c[{i}][{i}] * x)"
    update = f"least(greatest((sqrt({pull} * {pull} + 4 * c[{i}][{i}] * exp((bottom + top) / 2)) - {pull}) / (2 * c[{i}][{i}]), {low!r}), {high!r})"
    return {
        f"{name}_in": f"SELECT k, c, n FROM (SELECT *, len(t) AS n FROM ({source})) WHERE usable AND n * {low!r} <= 1 AND n * {high!r} >= 1",
        f"{name}_path": f"""
SELECT k, list_transform(c, lambda r: 1.0::DOUBLE / n) AS w, top - 80.0 AS bottom, top, 0 AS step FROM (
  SELECT *, ln(list_max(list_transform(c, lambda r: list_sum(list_transform(r, lambda v: abs(v))))) * {high!r} * greatest({high!r}, 1.0 / n) * n) AS top FROM {name}_in)
UNION ALL
SELECT k, v, CASE WHEN list_sum(v) > 1 THEN bottom ELSE (bottom + top) / 2 END, CASE WHEN list_sum(v) > 1 THEN (bottom + top) / 2 ELSE top END, step + 1 FROM (
  SELECT p.k, bottom, top, step, {_swept("w", update, 30)} AS v FROM {name}_path p JOIN {name}_in USING (k) WHERE step < 60)""",
        name: f"SELECT k, arg_max(w, step) AS w FROM {name}_path GROUP BY k"}


def even_contributions(source: str, sweeps: int = 150) -> str:
    """Equal contributions without bounds: y_i (Cy)_i = 1 / n for every member, member by member, then scaled to a sum of 1."""
    i = "CAST(m[1] AS INTEGER)"
    pull = f"(list_dot_product(c[{i}], acc) - c[{i}][{i}] * x)"
    update = f"(sqrt({pull} * {pull} + 4 * c[{i}][{i}] / n) - {pull}) / (2 * c[{i}][{i}])"
    return f"""
SELECT k, list_transform(y, lambda v: v / list_sum(y)) AS w FROM (
  SELECT k, {_swept("list_transform(c, lambda r, h: 1 / sqrt(c[h][h] * n))", update, sweeps)} AS y FROM ({source}))"""


def best_ratio(name: str, source: str) -> dict[str, str]:
    """Long-only weights of the best ratio of t to volatility."""
    i = "CAST(m[1] AS INTEGER)"
    update = f"greatest(0.0, x + (t[{i}] - list_dot_product(c[{i}], acc)) / c[{i}][{i}])"
    ratios = "list_transform(t, lambda v, h: v / sqrt(c[h][h]))"
    return {
        f"{name}_in": f"SELECT k, c, t, len(t) AS n FROM ({source}) WHERE usable",
        f"{name}_path": f"""
SELECT k, list_transform(t, lambda v: 0.0::DOUBLE) AS y, 0 AS step FROM {name}_in
UNION ALL SELECT p.k, {_swept("y", update, 50)}, step + 1 FROM {name}_path p JOIN {name}_in USING (k) WHERE step < 40""",
        name: f"""
SELECT k, CASE WHEN list_max(t) <= 0 THEN list_transform(t, lambda v, h: CASE WHEN h = list_position({ratios}, list_max({ratios})) THEN 1.0 ELSE 0.0 END)
  ELSE list_transform(y, lambda v: v / list_sum(y)) END AS w FROM {name}_path JOIN {name}_in USING (k) WHERE step = 40"""}


STATISTICS = """
SELECT *, sqrt(list_sum(list_transform(w, lambda x, i: x * list_dot_product(c[i], w)))) AS sd FROM (SELECT *, list_dot_product(w, mu) AS mean FROM {rows})"""


def statistics(rows: str, keys: str) -> str:
    return f"""
SELECT {keys}, sd * 100 AS volatility_pct, mean * 100 AS mean_return_pct, (mean - rf) / sd AS sharpe, 1 / list_dot_product(w, w) AS effective_names,
  list_max(w) * 100 AS largest_weight_pct, len(list_filter(w, lambda x: x > 0.01)) AS names_above_1pct FROM ({STATISTICS.format(rows=rows)})"""
