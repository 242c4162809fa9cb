"""SQL of fitted operators: least squares by Cramer's rule, power transforms by a grid, quantile scores, folds.

Each function gives the text that the Spark query of the same operator must agree with.
"""

from __future__ import annotations

from statistics import NormalDist

X = ("area_m2", "quartos", "banheiros")


def unit(key: str, seed: int, at: int = 1) -> str:
    """32 bits of the hash that prep.fold_of() and prep.split() take."""
    return f"CAST('0x' || substr(md5('{seed}|' || coalesce(CAST({key} AS VARCHAR), '')), {at}, 8) AS UBIGINT)"


def priced(z: str) -> str:
    """p: the rows of the price models, medians for missing features."""
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM w)) AS {c}" for c in X)
    return f"{z}, w AS (SELECT * FROM z WHERE preco BETWEEN 20000 AND 20000000), p AS MATERIALIZED (SELECT DISTINCT id, scraped_at, preco, {fill} FROM w)"


def least_squares(rows: str, y: str, penalty: str = "0", by: str | None = None, x: tuple[str, ...] = X) -> str:
    """A query (by, b1, b2[, b3], a): coefficients and intercept, with penalty on the diagonal of the covariances."""
    n = len(x)
    cov = ", ".join(f"covar_pop({x[i]}, {x[j]})" + (f" + ({penalty})" if i == j else "") + f" AS c{i}{j}" for i in range(n) for j in range(n))
    base = f"SELECT {by + ', ' if by else ''}{cov}, " + ", ".join(f"covar_pop({x[i]}, {y}) AS d{i}, avg({x[i]}) AS m{i}" for i in range(n)) + f", avg({y}) AS my FROM {rows}" + (f" GROUP BY {by}" if by else "")

    def det(col: int | None) -> str:
        c = lambda i, j: f"d{i}" if j == col else f"c{i}{j}"
        if n == 2:
            return f"({c(0, 0)} * {c(1, 1)} - {c(0, 1)} * {c(1, 0)})"
        return "(" + " + ".join(f"{c(0, i)} * ({c(1, (i + 1) % 3)} * {c(2, (i + 2) % 3)} - {c(1, (i + 2) % 3)} * {c(2, (i + 1) % 3)})" for i in range(3)) + ")"

    coef = ", ".join(f"{det(i)} / {det(None)} AS b{i + 1}" for i in range(n))
    a = "my - " + " - ".join(f"b{i + 1} * m{i}" for i in range(n))
    return f"SELECT {by + ', ' if by else ''}{', '.join(f'b{i + 1}' for i in range(n))}, {a} AS a FROM (SELECT *, {coef} FROM ({base}))"


def predicted(x: tuple[str, ...] = X) -> str:
    return "a + " + " + ".join(f"b{i + 1} * {c}" for i, c in enumerate(x))


def best_lambda(rows: str, x: str, value: str, jacobian: str, steps: int = 3, points: int = 21) -> str:
    """CTEs l0 to l{steps}(low, high): the interval of the likeliest lambda; value: the transform of x with lambda g."""
    out = "l0 AS (SELECT CAST(-2 AS DOUBLE) AS low, CAST(3 AS DOUBLE) AS high)"
    for s in range(steps):
        grid = f"SELECT i, low + (high - low) * i / {points - 1} AS g FROM l{s}, range({points}) r(i)"
        score = f"SELECT i, -count({x}) / 2 * ln(var_pop({value})) + (any_value(g) - 1) * sum({jacobian}) AS s FROM g{s}, {rows} WHERE {x} IS NOT NULL GROUP BY i"
        out += f", g{s} AS MATERIALIZED ({grid}), b{s} AS (SELECT arg_max(i, s) AS i FROM ({score})), l{s + 1} AS (SELECT (SELECT g FROM g{s} WHERE g{s}.i = greatest(b{s}.i - 1, 0)) AS low, (SELECT g FROM g{s} WHERE g{s}.i = least(b{s}.i + 1, {points - 1})) AS high FROM b{s})"
    return out + f", lam AS (SELECT (low + high) / 2 AS g FROM l{steps})"


def knots(rows: str, x: str, n: int = 1000) -> str:
    """CTE k(i, v, s): the knots of prep.NormalQuantiles, n of them or one per row."""
    nd = NormalDist()
    scores = ", ".join(f"{nd.inv_cdf(min(max(i / (n - 1), 1e-7), 1 - 1e-7))!r}" for i in range(n))
    values = ", ".join(f"{i / (n - 1)!r}" for i in range(n))
    return f"k AS MATERIALIZED (SELECT unnest(range({n})) AS i, unnest(quantile_cont({x}, [{values}])) AS v, unnest([{scores}]) AS s FROM {rows})"


def interpolated(rows: str, x: str, a: str, b: str, name: str, keep: str) -> str:
    """A query (keep, name): x put from the knots' column a to their column b; x may lie outside."""
    at = "(SELECT max(i) FROM k WHERE k.{0} <= q.x)".format(a), "(SELECT min(i) FROM k WHERE k.{0} >= q.x)".format(a)
    return (
        f"SELECT {keep}, CASE WHEN l.i IS NULL THEN h.{b} WHEN h.i IS NULL THEN l.{b} WHEN l.{a} = q.x THEN (l.{b} + h.{b}) / 2 ELSE l.{b} + (q.x - l.{a}) / (h.{a} - l.{a}) * (h.{b} - l.{b}) END AS {name} "
        f"FROM (SELECT *, {at[0]} AS lo, {at[1]} AS hi FROM (SELECT *, {x} AS x FROM {rows}) q) q LEFT JOIN k l ON l.i = q.lo LEFT JOIN k h ON h.i = q.hi"
    )
