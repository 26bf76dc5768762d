"""SQL of the robust node fit for any basis: normal equations summed, eliminated and solved in common table expressions."""

from __future__ import annotations

from cryoframe.operators.rates import RateParams

TERMS = {"one": "1.0E0", "rate": "t", "accel": "t*t/2", "u": "u", "v": "v", "uv": "u*v", "uu": "u*u", "vv": "v*v"}


def neighbours_sql(radius: float, extra: str = "", source: str = "pts", height: str = "h", name: str = "pw", t_ref: float = 1998.5, nodes: str = "nodes") -> str:
    """Points around each node: keys, t (years from the reference), u, v (in radii), h and the weight."""
    return (
        f"{name} AS MATERIALIZED (SELECT node_x, node_y, {extra}t_year-{t_ref}E0 AS t, (x-node_x)/{radius}E0 AS u, (y-node_y)/{radius}E0 AS v, {height} AS h, 1/(s_elv*s_elv+1E-12) AS w "
        f"FROM {source} JOIN {nodes} ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= {radius}E0*{radius}E0)"
    )


def solved_sql(name: str, rows: str, keys: str, k: int, n_unit: int) -> list[str]:
    """CTEs up to ``name``: keys, n, sw, coefficients x0.., and the inverse's first ``n_unit`` columns i<row>_<column> from row to column's foot.

    Sums of q0..q{k-1} over ``rows``, Gauss elimination of the symmetric matrix with the sums with h and unit vectors on the right.
    """
    tri = [(i, j) for i in range(k) for j in range(i, k)]
    sums = ", ".join([f"sum(w*q{i}*q{j}) AS a{i}_{j}" for i, j in tri] + [f"sum(w*q{i}*h) AS r{i}_0" for i in range(k)])
    units = "".join(f", {1.0 if i == m else 0.0}E0 AS r{i}_{m + 1}" for m in range(n_unit) for i in range(k))
    parts = [f"{name}_0 AS (SELECT *{units} FROM (SELECT {keys}, count(*) AS n, sum(w) AS sw, {sums} FROM {rows} GROUP BY {keys}) WHERE n >= {k + 2})"]
    for j in range(k - 1):
        new = [f"a{i}_{m}-a{j}_{i}*a{j}_{m}/a{j}_{j} AS a{i}_{m}" for i, m in tri if i > j]
        new += [f"r{i}_{c}-a{j}_{i}*r{j}_{c}/a{j}_{j} AS r{i}_{c}" for i in range(j + 1, k) for c in range(n_unit + 1)]
        parts.append(f"{name}_{j + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{j})")
    for i in range(k - 1, -1, -1):
        rest = lambda c: "".join(f"-a{i}_{m}*x{m}_{c}" for m in range(i + 1, k))  # noqa: B023, E731
        new = ", ".join(f"(r{i}_{c}{rest(c)})/a{i}_{i} AS x{i}_{c}" for c in range(n_unit + 1))
        parts.append(f"{name}_b{i} AS (SELECT *, {new} FROM {name}_{f'b{i + 1}' if i < k - 1 else k - 1})")
    out = ", ".join(f"x{i}_{c}" for i in range(k) for c in range(n_unit + 1))
    return [*parts, f"{name} AS MATERIALIZED (SELECT {keys}, n, sw, {out} FROM {name}_b0)"]


def robust_sql(name: str, source: str, keys: str, p: RateParams, n_unit: int = 3, *, n_sigma: str = "", residual_limit: str = "", min_points: str = "") -> str:
    """``n_sigma``, ``residual_limit`` and ``min_points`` may name keys in place of the numbers of ``p``. CTEs from ``source`` (keys, t, u, v, h, w) to ``name``: keys, p0, dhdt, accel, their errors, rmse, nobs, tspan and all x<i>_<c>, covariances as x<i>_<c + 1> * scale."""
    sigmas, furthest, least = n_sigma or p.n_sigma, residual_limit or p.residual_limit, min_points or p.min_points
    k, group = len(p.terms), f"WINDOW g AS (PARTITION BY {keys})"
    n_unit = min(n_unit, k)
    basis = ", ".join(f"{TERMS[t]} AS q{i}" for i, t in enumerate(p.terms))
    pos = {t: i for i, t in enumerate(p.terms)}
    rows = f"{name}r0"
    parts = [f"{rows} AS MATERIALIZED (SELECT *, {basis} FROM (SELECT *, count(*) OVER g AS n0, max(t) OVER g - min(t) OVER g AS tspan FROM {source} {group}) WHERE n0 >= {least} AND tspan >= {p.min_span})"]
    for r in range(1, p.rounds + 1):
        fit, last = f"{name}f{r}", f"{name}r{r}"
        parts += solved_sql(fit, rows if r == 1 else f"(SELECT * FROM {rows} WHERE NOT wild)", keys, k, n_unit if r == p.rounds else 0)
        predicted = "+".join(f"f.x{i}_0*q{i}" for i in range(k))
        drop = "" if r == 1 else " EXCLUDE (r, med, mad, wild)"
        parts += [
            f"{last}a AS (SELECT o.*{drop}, h-({predicted}) AS r FROM {rows if r == 1 else f'(SELECT * FROM {rows} WHERE NOT wild)'} o JOIN {fit} f USING ({keys}))",
            f"{last}b AS (SELECT *, median(r) OVER g AS med FROM {last}a {group})",
            f"{last} AS MATERIALIZED (SELECT *, mad >= 1E-10 AND (abs(r) > {sigmas}*mad OR abs(r) > {furthest}) AS wild FROM (SELECT *, 1.4826E0*median(abs(r-med)) OVER g AS mad FROM {last}b {group}))",
        ]
        rows = last
    coefficient = lambda t: f"f.x{pos[t]}_0" if t in pos else "NULL::DOUBLE"
    error = lambda t: f"sqrt(greatest(f.x{pos[t]}_{pos[t] + 1}, 0)*scale)" if t in pos else "NULL::DOUBLE"
    ok = f"years >= {p.min_years_accel} AND abs({coefficient('accel')}) <= {p.accel_limit}"
    parts.append(
        f"{name} AS MATERIALIZED (SELECT {keys}, {coefficient('one')} AS p0, {coefficient('rate')} AS dhdt, CASE WHEN {ok} THEN {coefficient('accel')} END AS accel, {error('one')} AS p0_err, {error('rate')} AS dhdt_err, "
        f"CASE WHEN {ok} THEN {error('accel')} END AS accel_err, rmse, nobs, tspan, scale, {', '.join(f'f.x{i}_{c}' for i in range(k) for c in range(n_unit + 1))} FROM (SELECT {keys}, stddev_pop(r) AS rmse, "
        f"count(*) FILTER (NOT wild) AS nobs, count(DISTINCT floor(t+{p.t_ref}E0)) FILTER (NOT wild) AS years, any_value(tspan) AS tspan, sum(r*r) AS rr FROM {rows} GROUP BY {keys}) s JOIN {name}f{p.rounds} f USING ({keys}), "
        f"LATERAL (SELECT sw/n*rr/greatest(n-{k}, 1) AS scale) WHERE nobs >= {least}" + (f" AND abs({coefficient('rate')}) <= {p.rate_limit})" if "rate" in pos else ")")
    )
    return ", ".join(parts)
