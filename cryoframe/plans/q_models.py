"""Queries over fits, trends, interpolation and validation (I, M)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from cryoframe.functions import timecols
from cryoframe.operators import interpolate, ranks, rates, slopes, spatial, trend, yearblocks
from cryoframe.operators.blocks import node_series, plane_aggregates, plane_solution
from cryoframe.plans.base import IDS, points, query, tile_nodes_sql, with_pts
from cryoframe.plans.fit_sql import TERMS, neighbours_sql, robust_sql, solved_sql
from cryoframe.plans.q_spatial import CENT_SQL, CROSS_SQL, TRACK_SQL, centroids, crossing_table, nodes
from cryoframe.plans.q_stats import FOLD_SQL, PAIR_SQL, agreement_pairs, folded
from cryoframe.session import cut

P = rates.RateParams(radius=15_000.0, t_ref=1998.5)

SER_SQL = """pw AS (SELECT node_x, node_y, "year", (x-node_x)/15000 AS u, (y-node_y)/15000 AS v, h FROM pts JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 15000.0E0*15000.0E0),
 ms AS (SELECT node_x, node_y, "year", count(*) AS n_obs, avg(h) AS mh, avg(u) AS mu, avg(v) AS mv, var_pop(u)*count(*) AS a, var_pop(v)*count(*) AS d, covar_pop(u,v)*count(*) AS o, covar_pop(u,h)*count(*) AS p, covar_pop(v,h)*count(*) AS q, var_pop(h)*count(*) AS r FROM pw GROUP BY ALL HAVING count(*)>=10),
 ser AS (SELECT node_x, node_y, "year", n_obs, mh-(p*d-q*o)/(a*d-o*o)*mu-(q*a-p*o)/(a*d-o*o)*mv AS h_node,
   sqrt(greatest(r-(p*d-q*o)/(a*d-o*o)*p-(q*a-p*o)/(a*d-o*o)*q,0)/greatest(n_obs-3,1)*(1.0E0/n_obs+(mu*mu*d-2*mu*mv*o+mv*mv*a)/(a*d-o*o))) AS sigma FROM ms WHERE a*d-o*o>1E-10*a*d)"""


def pairs_of(spark, sf, step=5000.0, radius=15000.0, cols=("h", "t_year", "s_elv", "year", "beam")):
    return spatial.radius_join(points(spark, sf).select(*IDS, "x", "y", *cols), nodes(spark, sf, step=step).select("node_x", "node_y"), radius)


def series(spark, sf, step=5000.0):
    return node_series(pairs_of(spark, sf, step, cols=("h", "year")), radius=15000.0)


@query("I04_node_series", with_pts('SELECT node_x, node_y, "year", n_obs, h_node, sigma FROM ser', tile_nodes_sql(50000, 5000), SER_SQL), floats="h_node sigma")
def i04(spark, sf):
    return series(spark, sf)


@query("I10_plane_value", with_pts("SELECT ci, cj, n_obs, mh-(p*d-q*o)/(a*d-o*o)*mu-(q*a-p*o)/(a*d-o*o)*mv AS h_node, greatest(r-(p*d-q*o)/(a*d-o*o)*p-(q*a-p*o)/(a*d-o*o)*q,0)/greatest(n_obs-3,1)*(1.0E0/n_obs+(mu*mu*d-2*mu*mv*o+mv*mv*a)/(a*d-o*o)) AS var_node FROM (SELECT floor(x/2500)::BIGINT AS ci, floor(y/2500)::BIGINT AS cj, count(*) AS n_obs, avg(h) AS mh, avg(u) AS mu, avg(v) AS mv, var_pop(u)*count(*) AS a, var_pop(v)*count(*) AS d, covar_pop(u,v)*count(*) AS o, covar_pop(u,h)*count(*) AS p, covar_pop(v,h)*count(*) AS q, var_pop(h)*count(*) AS r FROM (SELECT x, y, h, x/2500-floor(x/2500)-0.5E0 AS u, y/2500-floor(y/2500)-0.5E0 AS v FROM pts) GROUP BY 1,2) WHERE n_obs>=10 AND a>0 AND d>0 AND a*d-o*o>1E-10*a*d"), floats="h_node var_node", digits=5)
def i10(spark, sf):
    u, v = F.col("x") / 2500 - F.floor(F.col("x") / 2500) - 0.5, F.col("y") / 2500 - F.floor(F.col("y") / 2500) - 0.5
    s = points(spark, sf).groupBy(spatial.cell("x", 2500).alias("ci"), spatial.cell("y", 2500).alias("cj")).agg(*plane_aggregates(u, v, F.col("h")))
    return plane_solution(s.where(F.col("n_obs") >= 10)).where(F.col("h_node").isNotNull())


FIT_COLUMNS = ["p0", "dhdt", "accel", "p0_err", "dhdt_err", "accel_err", "rmse", "nobs", "tspan"]
FIT_FLOATS = "p0 dhdt accel p0_err dhdt_err accel_err rmse tspan"
FIT_LIST = "p0, dhdt, accel, p0_err, dhdt_err, accel_err, rmse, nobs, tspan"


def lattice_of(spark, sf, step):
    return nodes(spark, sf, step=step).select("node_x", "node_y")


@query("I01_robust_fit", with_pts(f"SELECT node_x, node_y, {FIT_LIST} FROM fit", tile_nodes_sql(50000, 16666), neighbours_sql(15000), robust_sql("fit", "pw", "node_x, node_y", P)), floats=FIT_FLOATS, digits=5)
def i01(spark, sf):
    """One node per 17 km over all points: rate near -0.5 in spite of the spikes."""
    return rates.node_rates(points(spark, sf), lattice_of(spark, sf, 16_666.0), P).select("node_x", "node_y", *FIT_COLUMNS)


@query("I02_node_rates", with_pts(f"SELECT node_x, node_y, {FIT_LIST} FROM fit", tile_nodes_sql(50000, 5000), neighbours_sql(15000), robust_sql("fit", "pw", "node_x, node_y", P)), floats=FIT_FLOATS, digits=5)
def i02(spark, sf):
    return rates.node_rates(points(spark, sf), lattice_of(spark, sf, 5_000.0), P).select("node_x", "node_y", *FIT_COLUMNS)


WINDOWED_SQL = "wp AS (SELECT pts.*, s::DOUBLE AS win_start, s+4.0E0 AS win_end FROM pts, (SELECT unnest(range(1995,1999)) AS s) WHERE t_year>=s AND t_year<s+4)"


@query(
    "I03_window_rates",
    with_pts(f"SELECT node_x, node_y, win_start, win_end, {FIT_LIST} FROM fit", tile_nodes_sql(50000, 10000), WINDOWED_SQL, neighbours_sql(15000, "win_start, win_end, ", "wp"), robust_sql("fit", "pw", "node_x, node_y, win_start, win_end", P)),
    floats=FIT_FLOATS, digits=5,
)
def i03(spark, sf):
    w = rates.moving_windows(4.0, 1.0, 1995.0, 2002.0)
    return rates.window_rates(points(spark, sf), lattice_of(spark, sf, 10_000.0), w, P).select("node_x", "node_y", "win_start", "win_end", *FIT_COLUMNS)


CLOSE = replace(P, radius=10_000.0)


@query("I01_hot_nodes_in_rounds", with_pts(f"SELECT node_x, node_y, {FIT_LIST} FROM fit", tile_nodes_sql(50000, 25000), neighbours_sql(10000), robust_sql("fit", "pw", "node_x, node_y", CLOSE)), floats=FIT_FLOATS, digits=5)
def i01_hot(spark, sf):
    """The distributed path: every neighbourhood counts as too large for one task."""
    return rates.node_rates(points(spark, sf), lattice_of(spark, sf, 25_000.0), CLOSE, limit=100).select("node_x", "node_y", *FIT_COLUMNS)


# The same estimator with a straight line in time, whose weighted solution SQL can write out: two rounds of fit and rejection.
LINE = replace(P, space_order=0, time_order=1, rounds=2)


def line_sql(name: str, source: str, keys: str, *, trend: bool = True, min_points: int = 30) -> str:
    """CTEs from ``source`` (keys, t: years from the reference, h, w) to ``name`` (keys, p0, dhdt, dhdt_err, rmse, nobs, tspan)."""
    group = f"WINDOW g AS (PARTITION BY {keys})"
    slope, least = ("(s0*b1-s1*b0)/(s0*s2-s1*s1)", 4) if trend else ("0.0E0", 3)
    level = "(s2*b0-s1*b1)/(s0*s2-s1*s1)" if trend else "b0/s0"

    def fitted(made: str, of: str) -> str:
        return (
            f"{made}s AS (SELECT *, count(*) OVER g AS n, sum(w) OVER g AS s0, sum(w*t) OVER g AS s1, sum(w*t*t) OVER g AS s2, sum(w*h) OVER g AS b0, sum(w*t*h) OVER g AS b1 FROM {of} {group}), "
            f"{made}r AS (SELECT *, {level} AS p0, {slope} AS dhdt, h-({level})-({slope})*t AS r FROM {made}s WHERE n>={least}), "
            f"{made}m AS (SELECT *, median(r) OVER g AS med FROM {made}r {group}), "
            f"{made} AS (SELECT *, mad>=1E-10 AND (abs(r)>3*mad OR abs(r)>5) AS wild FROM (SELECT *, 1.4826E0*median(abs(r-med)) OVER g AS mad FROM {made}m {group}))"
        )

    return ", ".join([
        f"{name}0 AS (SELECT * FROM (SELECT *, count(*) OVER g AS n0, max(t) OVER g - min(t) OVER g AS tspan FROM {source} {group}) WHERE n0>={min_points} AND tspan>=3)",
        fitted(f"{name}1", f"{name}0"),
        fitted(f"{name}2", f"(SELECT * EXCLUDE (n, s0, s1, s2, b0, b1, p0, dhdt, r, med, mad, wild) FROM {name}1 WHERE NOT wild)"),
        f"{name} AS (SELECT {keys}, any_value(p0) AS p0, any_value(dhdt) AS dhdt, "
        + (f"sqrt(any_value(s0/(s0*s2-s1*s1)*s0/n)*sum(r*r)/(count(*)-2)) AS dhdt_err, " if trend else "NULL::DOUBLE AS dhdt_err, ")
        + f"stddev_pop(r) AS rmse, count(*) FILTER (NOT wild) AS nobs, any_value(tspan) AS tspan FROM {name}2 GROUP BY {keys} HAVING count(*) FILTER (NOT wild)>={min_points}"
        + (" AND abs(any_value(dhdt))<=20)" if trend else ")"),
    ])


def near_sql(radius: float, extra: str = "", source: str = "pts", height: str = "h", name: str = "pw") -> str:
    return (
        f"{name} AS (SELECT node_x, node_y, {extra}t_year-1998.5E0 AS t, {height} AS h, 1/(s_elv*s_elv+1E-12) AS w FROM {source} "
        f"JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= {radius}E0*{radius}E0)"
    )


LINE_COLUMNS = ["p0", "dhdt", "dhdt_err", "rmse", "nobs", "tspan"]
LINE_FLOATS = "p0 dhdt dhdt_err rmse tspan"


@query("I02_line_rates", with_pts("SELECT * FROM ln", tile_nodes_sql(50000, 5000), near_sql(15000), line_sql("ln", "pw", "node_x, node_y")), floats=LINE_FLOATS)
def i02_line(spark, sf):
    return rates.node_rates(points(spark, sf), nodes(spark, sf).select("node_x", "node_y"), LINE).select("node_x", "node_y", *LINE_COLUMNS)


@query("I01_line_in_rounds", with_pts("SELECT * FROM ln", tile_nodes_sql(50000, 25000), near_sql(10000), line_sql("ln", "pw", "node_x, node_y")), floats=LINE_FLOATS)
def i01_line(spark, sf):
    """The distributed path, for which every neighbourhood counts as too large for one task."""
    return rates.node_rates(points(spark, sf), nodes(spark, sf, step=25_000.0).select("node_x", "node_y"), replace(LINE, radius=10_000.0), limit=100).select("node_x", "node_y", *LINE_COLUMNS)


@query(
    "I03_line_window_rates",
    with_pts("SELECT * FROM ln", tile_nodes_sql(50000, 10000), "wp AS (SELECT pts.*, s::DOUBLE AS win_start, s+4.0E0 AS win_end FROM pts, (SELECT unnest(range(1995,1999)) AS s) WHERE t_year>=s AND t_year<s+4)",
             near_sql(15000, "win_start, win_end, ", "wp"), line_sql("ln", "pw", "node_x, node_y, win_start, win_end")),
    floats=LINE_FLOATS,
)
def i03_line(spark, sf):
    w = rates.moving_windows(4.0, 1.0, 1995.0, 2002.0)
    r = rates.window_rates(points(spark, sf), nodes(spark, sf, step=10_000.0).select("node_x", "node_y"), w, LINE)
    return r.select("node_x", "node_y", "win_start", "win_end", *LINE_COLUMNS)


LEAK_SQL = (
    "ph AS (SELECT pts.*, q AS period, c AS phase, CASE WHEN c=0 THEN cos(2*pi()/q*t_year) ELSE sin(2*pi()/q*t_year) END AS unit FROM pts, (VALUES (1.0E0),(0.5E0)) a(q), (VALUES (0),(1)) b(c))",
    near_sql(15000, "period, phase, ", "ph", "unit"), line_sql("ln", "pw", "node_x, node_y, period, phase"),
    "lk AS (SELECT node_x, node_y, period, max(dhdt) FILTER (phase=0) AS r_cos, max(dhdt) FILTER (phase=1) AS r_sin, max(nobs) AS nobs FROM ln GROUP BY 1,2,3)",
)


@query("I17_line_leakage", with_pts("SELECT *, sqrt(r_cos*r_cos+r_sin*r_sin) AS leakage FROM lk", tile_nodes_sql(50000, 25000), *LEAK_SQL), floats="r_cos r_sin leakage")
def i17_line(spark, sf):
    return rates.harmonic_leakage(points(spark, sf), nodes(spark, sf, step=25_000.0).select("node_x", "node_y"), LINE)


@query(
    "D53_line_aliasing",
    with_pts("SELECT period, count(*) AS n, median(l) AS median, quantile_cont(l,0.9) AS p90, max(l) AS max FROM (SELECT period, sqrt(r_cos*r_cos+r_sin*r_sin) AS l FROM lk) GROUP BY period", tile_nodes_sql(50000, 25000), *LEAK_SQL),
    floats="median p90 max",
)
def d53_line(spark, sf):
    from cryoframe.operators.skew import group_quantiles

    leak = rates.harmonic_leakage(points(spark, sf), nodes(spark, sf, step=25_000.0).select("node_x", "node_y"), LINE)
    return group_quantiles(leak, ["period"], "leakage", {"median": 0.5, "p90": 0.9, "max": 1.0})


@query(
    "I18_line_hindcast",
    with_pts(
        'SELECT "year", n, rms_trend, rms_still, bias, lead, 1-rms_trend/nullif(rms_still,0) AS gain FROM (SELECT floor(t+1998.5E0)::INT AS "year", count(*) AS n, sqrt(avg(e*e)) AS rms_trend, sqrt(avg(e0*e0)) AS rms_still, avg(e) AS bias, avg(t+1998.5E0-1999.0E0) AS lead '
        "FROM (SELECT pl.t, pl.h-ln.p0-ln.dhdt*pl.t AS e, pl.h-st.p0 AS e0 FROM pl JOIN ln USING (node_x, node_y) JOIN st USING (node_x, node_y)) GROUP BY 1)",
        tile_nodes_sql(50000, 25000), "early AS (SELECT * FROM pts WHERE t_year<1999.0E0)", "late AS (SELECT * FROM pts WHERE t_year>=1999.0E0)", near_sql(15000, source="early"), near_sql(15000, source="late", name="pl"),
        line_sql("ln", "pw", "node_x, node_y"), line_sql("st", "pw", "node_x, node_y", trend=False),
    ),
    floats="rms_trend rms_still bias lead gain",
)
def i18_line(spark, sf):
    return rates.hindcast(points(spark, sf), nodes(spark, sf, step=25_000.0).select("node_x", "node_y"), 1999.0, LINE)


MK_SQL = """pr AS (SELECT a.node_x, a.node_y, sign(b.h_node-a.h_node) AS s, (b.h_node-a.h_node)/(b."year"-a."year") AS m FROM ser a JOIN ser b ON a.node_x=b.node_x AND a.node_y=b.node_y AND a."year"<b."year"),
 mk AS (SELECT node_x, node_y, sum(s)/count(*) AS tau, median(m) AS sens_slope FROM pr GROUP BY ALL),
 mk2 AS (SELECT mk.*, n, mh-sens_slope*my AS intercept FROM mk JOIN (SELECT node_x, node_y, count(*)::INT AS n, median(h_node) AS mh, median("year") AS my FROM ser GROUP BY ALL) USING (node_x, node_y) WHERE n>=3)"""


@query("I05_mann_kendall_sen", with_pts("SELECT node_x, node_y, n, tau, sens_slope, intercept FROM mk2", tile_nodes_sql(50000, 5000), SER_SQL, MK_SQL), floats="tau sens_slope intercept", digits=3)
def i05(spark, sf):
    return trend.mann_kendall_sen(series(spark, sf), ["node_x", "node_y"]).select("node_x", "node_y", "n", "tau", "sens_slope", "intercept")


SEAS_SQL = """sm AS (SELECT floor(x/20000)::BIGINT AS ci, floor(y/20000)::BIGINT AS cj, "year", "month", avg(h) AS v FROM pts GROUP BY ALL),
 sp AS (SELECT a.ci, a.cj, sign(b.v-a.v) AS s, (b.v-a.v)/(b."year"-a."year") AS m FROM sm a JOIN sm b ON a.ci=b.ci AND a.cj=b.cj AND a."month"=b."month" AND a."year"<b."year"),
 sk AS (SELECT ci, cj, sum(s)/count(*) AS tau, median(m) AS sens_slope FROM sp GROUP BY ALL)"""


def monthly(spark, sf):
    return points(spark, sf).groupBy(spatial.cell("x", 20000).alias("ci"), spatial.cell("y", 20000).alias("cj"), "year", "month").agg(F.avg("h").alias("v"))


@query("I06_seasonal_kendall", with_pts('SELECT sk.ci, sk.cj, tau, sens_slope, ic AS intercept FROM sk JOIN (SELECT sm.ci, sm.cj, median(v-sens_slope*"year") AS ic FROM sm JOIN sk ON sm.ci=sk.ci AND sm.cj=sk.cj GROUP BY 1,2 HAVING count(*)>=4) q ON q.ci=sk.ci AND q.cj=sk.cj', SEAS_SQL), floats="tau sens_slope intercept", digits=5)
def i06(spark, sf):
    return trend.seasonal_mann_kendall_sen(monthly(spark, sf), ["ci", "cj"], value="v").select("ci", "cj", "tau", "sens_slope", "intercept")


# Exact two-sided p by length and discordant pairs; series here have at most seven years.
KENDALL_SQL = "kx(n, dis, p) AS (VALUES " + ", ".join(f"({n}, {d}, {p!r}::DOUBLE)" for n, d, p in ranks.kendall_exact_table(7)) + ")"
TREND_SQL = """tq AS (SELECT mk2.*, p AS p_value FROM (SELECT mk2.*, tau*n*(n-1)/2 AS s FROM mk2 WHERE n>=4) mk2 JOIN kx ON kx.n=mk2.n AND kx.dis=round((mk2.n*(mk2.n-1)/2-s)/2)),
 tf AS (SELECT *, min(p_value*m/rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, node_x, node_y) AS rk FROM tq))"""


@query("I07_trend_table", with_pts("SELECT node_x, node_y, n AS n_epochs, p_value, least(a,1) AS p_fdr, a<=0.05E0 AS significant, CASE WHEN a>0.05E0 THEN 'no_trend' WHEN sens_slope<0 THEN 'decreasing' ELSE 'increasing' END AS trend FROM tf", tile_nodes_sql(50000, 5000), SER_SQL, MK_SQL, KENDALL_SQL, TREND_SQL), floats="p_value p_fdr")
def i07(spark, sf):
    return trend.trend_table(series(spark, sf)).select("node_x", "node_y", "n_epochs", "p_value", "p_fdr", "significant", "trend")


@query("I08_identifiability", with_pts("SELECT pc, n, n_years, pcv AS phase_coverage, pcv>=0.35E0 AS seasonal_ok, n_years>=5 AS accel_ok, CASE WHEN pcv<0.35E0 AND n_years<5 THEN 'phase coverage; years' WHEN pcv<0.35E0 THEN 'phase coverage' WHEN n_years<5 THEN 'years' ELSE '' END AS reason FROM (SELECT pc, count(*) AS n, count(DISTINCT floor(t_year)) AS n_years, 1-sqrt(pow(avg(cos(2*pi()*t_year)),2)+pow(avg(sin(2*pi()*t_year)),2)) AS pcv FROM pts GROUP BY pc)"), floats="phase_coverage")
def i08(spark, sf):
    """All months of every supplier."""
    return yearblocks.term_gate(yearblocks.phase_coverage(points(spark, sf), ["pc"]))


def blocks(spark, sf, step=10_000.0, **kw):
    return yearblocks.year_blocks(pairs_of(spark, sf, step), radius=15000.0, t_ref=1998.5, **kw)


@query("I09_term_fits")
def i09(spark, sf):
    return yearblocks.compare_models(blocks(spark, sf, beam="beam"), candidates={**yearblocks.MODEL_CANDIDATES, **yearblocks.SEASONAL_CANDIDATES})


def left_out_sql(name: str, terms: list[str]) -> list[str]:
    """Each year of a node predicted from the others: pooled error as ``name`` (node_x, node_y, model, oos_rmse)."""
    k, keys = len(terms), "node_x, node_y, held"
    predicted = "+".join(f"f.x{i}_0*q{i}" for i in range(k))
    return [
        f"{name}q AS MATERIALIZED (SELECT node_x, node_y, year, h, w, {', '.join(f'{TERMS[t]} AS q{i}' for i, t in enumerate(terms))} FROM pw)",
        f"{name}t AS (SELECT q.*, y.year AS held FROM {name}q q JOIN yr y USING (node_x, node_y) WHERE q.year<>y.year AND y.n>=3)",
        *solved_sql(f"{name}f", f"{name}t", keys, k, 0),
        f"{name} AS (SELECT node_x, node_y, '{name}' AS model, sqrt(sum(power(h-({predicted}), 2))/count(*)) AS oos_rmse FROM {name}q q JOIN {name}f f USING (node_x, node_y) WHERE q.year=f.held GROUP BY 1,2)",
    ]


LINEAR_TERMS = ["one", "rate", "u", "v", "uv", "uu", "vv"]


@query(
    "I11_left_out_years",
    with_pts(
        "SELECT node_x, node_y, model, oos_rmse FROM (SELECT DISTINCT node_x, node_y, unnest(['linear', 'linear_accel', 'linear_beam']) AS model FROM yr) LEFT JOIN (SELECT * FROM linear UNION ALL SELECT * FROM linear_accel UNION ALL SELECT node_x, node_y, 'linear_beam', oos_rmse FROM linear) USING (node_x, node_y, model)", tile_nodes_sql(50000, 10000),
        neighbours_sql(15000, '"year", ', nodes="nodes").replace("1/(s_elv*s_elv+1E-12) AS w", "1.0E0 AS w"), "yr AS MATERIALIZED (SELECT node_x, node_y, year, count(*) AS n FROM pw GROUP BY 1,2,3)",
        *left_out_sql("linear", LINEAR_TERMS), *left_out_sql("linear_accel", [*LINEAR_TERMS, "accel"]),
    ),
    floats="oos_rmse",
)
def i11(spark, sf):
    return yearblocks.compare_models(blocks(spark, sf)).select("node_x", "node_y", "model", "oos_rmse")


@query("I12_model_choice")
def i12(spark, sf):
    return yearblocks.best_models(yearblocks.compare_models(blocks(spark, sf, beam="beam")))


@query("I13_variogram_fit")
def i13(spark, sf):
    """Fitted on fifteen lag rows; reported beside them."""
    c = centroids(spark, sf)
    fit = interpolate.fit_variogram(c, "v", ids=["ci", "cj"], max_lag=40_000.0, x="cx", y="cy")
    lags = interpolate.empirical_variogram(c, "v", ids=["ci", "cj"], max_lag=40_000.0, x="cx", y="cy")
    return lags.withColumn("model", F.lit(fit["model"])).withColumn("range_m", F.lit(fit["range_m"])).withColumn("sill", F.lit(fit["sill"])).withColumn("nugget", F.lit(fit["nugget"]))


@query("I14_year_jackknife")
def i14(spark, sf):
    return yearblocks.jackknife(blocks(spark, sf, sigma="s_elv", basis=yearblocks.RATE_BASIS), basis=yearblocks.RATE_BASIS)


@query("I15_year_bootstrap")
def i15(spark, sf):
    """Acceleration with its year-bootstrap interval, all gates but the bootstrap switched off."""
    c = yearblocks.AccelCriteria(delta_aicc=-1e18, max_ac1=2.0, require_oos_gain=False, min_sign_fraction=0.0, max_year_shift=1e18)
    a = yearblocks.assess_acceleration(pairs_of(spark, sf, 25_000.0), radius=15000.0, t_ref=1998.5, criteria=c, ties=IDS)
    return a.select("node_x", "node_y", "ci_lo", "ci_hi", "sign_fraction", "n_obs", "n_years")


@query("I16_acceleration_support")
def i16(spark, sf):
    return yearblocks.assess_acceleration(pairs_of(spark, sf, 25_000.0), radius=15000.0, t_ref=1998.5, ties=IDS)


def leak_sql(time: str, source: str = "pts") -> tuple[str, ...]:
    return (
        f"ph AS (SELECT p.*, q AS period, c AS phase, CASE WHEN c=0 THEN cos(2*pi()/q*{time}) ELSE sin(2*pi()/q*{time}) END AS unit FROM {source} p, (VALUES (1.0E0),(0.5E0)) a(q), (VALUES (0),(1)) b(c))",
        neighbours_sql(15000, "period, phase, ", "ph", "unit"), robust_sql("fit", "pw", "node_x, node_y, period, phase", P),
        "lk AS (SELECT node_x, node_y, period, max(dhdt) FILTER (phase=0) AS r_cos, max(dhdt) FILTER (phase=1) AS r_sin, max(nobs) AS nobs FROM fit GROUP BY 1,2,3)",
    )


LEAKAGE = "SELECT *, sqrt(r_cos*r_cos+r_sin*r_sin) AS leakage FROM lk"
STRETCHED_SQL = "st AS (SELECT pts.*, floor(t_year)+(t_year-floor(t_year)-lo)/(hi-lo) AS t_full FROM pts, (SELECT min(t_year-floor(t_year)) AS lo, max(t_year-floor(t_year)) AS hi FROM pts WHERE \"month\" BETWEEN 6 AND 8) WHERE \"month\" BETWEEN 6 AND 8)"


@query("I17_harmonic_leakage", with_pts(LEAKAGE, tile_nodes_sql(50000, 25000), *leak_sql("t_year")), floats="r_cos r_sin leakage")
def i17(spark, sf):
    return rates.harmonic_leakage(points(spark, sf), lattice_of(spark, sf, 25_000.0), P)


@query("I17_stretched_leakage", with_pts(LEAKAGE, tile_nodes_sql(50000, 25000), STRETCHED_SQL, *leak_sql("t_full", "st")), floats="r_cos r_sin leakage")
def i17_stretched(spark, sf):
    """What sampling of one season does, had the same epochs been spread over the whole year."""
    season = points(spark, sf).where(F.col("month").between(6, 8))
    frac = F.col("t_year") - F.floor("t_year")
    ends = season.agg(F.min(frac).alias("lo"), F.max(frac).alias("hi"))
    full = season.crossJoin(F.broadcast(ends)).withColumn("t_full", timecols.phase_stretch("t_year", F.col("lo"), F.col("hi")))
    return rates.harmonic_leakage(full, lattice_of(spark, sf, 25_000.0), P, phase_time="t_full")


@query(
    "D53_aliasing_summary",
    with_pts("SELECT *, median*0.5E0 AS bias_at_half_metre FROM (SELECT period, count(*) AS n, median(l) AS median, quantile_cont(l,0.9) AS p90, quantile_cont(l,0.99) AS p99, max(l) AS max FROM (SELECT period, sqrt(r_cos*r_cos+r_sin*r_sin) AS l FROM lk) GROUP BY period)", tile_nodes_sql(50000, 25000), *leak_sql("t_year")),
    floats="median p90 p99 max bias_at_half_metre",
)
def d53(spark, sf):
    """Leakage times the seasonal amplitude is the bias it can cause."""
    from cryoframe.operators.skew import group_quantiles

    leak = rates.harmonic_leakage(points(spark, sf), lattice_of(spark, sf, 25_000.0), P)
    q = group_quantiles(leak, ["period"], "leakage", {"median": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0})
    return q.withColumn("bias_at_half_metre", F.col("median") * 0.5)


TREND, STILL = replace(P, time_order=1), replace(P, time_order=0)
ERRORS_SQL = " AS e, ".join(
    "pl.h-(" + "+".join(f"{name}.x{i}_0*pl.{c}" if c != "one" else f"{name}.x{i}_0" for i, c in enumerate({"one": "one", "rate": "t", "u": "u", "v": "v", "uv": "u*pl.v", "uu": "u*pl.u", "vv": "v*pl.v"}[t] for t in q.terms)) + ")"
    for name, q in (("tr", TREND), ("st", STILL))
) + " AS e0"


@query(
    "I18_hindcast",
    with_pts(
        f'SELECT "year", n, rms_trend, rms_still, bias, lead, 1-rms_trend/nullif(rms_still,0) AS gain FROM (SELECT floor(t+1998.5E0)::INT AS "year", count(*) AS n, sqrt(avg(e*e)) AS rms_trend, sqrt(avg(e0*e0)) AS rms_still, avg(e) AS bias, avg(t+1998.5E0-1999.0E0) AS lead '
        f"FROM (SELECT pl.t, {ERRORS_SQL} FROM pl JOIN tr USING (node_x, node_y) JOIN st USING (node_x, node_y)) GROUP BY 1)",
        tile_nodes_sql(50000, 25000), "early AS (SELECT * FROM pts WHERE t_year<1999.0E0)", "late AS (SELECT * FROM pts WHERE t_year>=1999.0E0)", neighbours_sql(15000, source="early"), neighbours_sql(15000, source="late", name="pl"),
        robust_sql("tr", "pw", "node_x, node_y", TREND), robust_sql("st", "pw", "node_x, node_y", STILL),
    ),
    floats="rms_trend rms_still bias lead gain", digits=5,
)
def i18(spark, sf):
    return rates.hindcast(points(spark, sf), lattice_of(spark, sf, 25_000.0), 1999.0, TREND)


VARIANCE_SQL = "+".join(f"{a}*{b}*x{i}_{j + 1}" for i, a in enumerate(("1", "dt", "dt*dt/2")) for j, b in enumerate(("1", "dt", "dt*dt/2")))


@query(
    "I18_projection",
    with_pts(
        f"SELECT node_x, node_y, epoch, height, sigma, height-1.96E0*sigma AS low, height+1.96E0*sigma AS high FROM (SELECT node_x, node_y, epoch, x0_0+x1_0*dt+x2_0*dt*dt/2 AS height, sqrt(greatest(({VARIANCE_SQL})*scale, 0)) AS sigma "
        "FROM fit, (SELECT epoch, epoch-1998.5E0 AS dt FROM (VALUES (2000.0E0),(2002.0E0),(2005.0E0),(2010.0E0)) e(epoch)))",
        tile_nodes_sql(50000, 10000), neighbours_sql(15000), robust_sql("fit", "pw", "node_x, node_y", P),
    ),
    floats="height sigma low high", digits=5,
)
def i18_projection(spark, sf):
    """Heights past the record with the interval of the whole covariance."""
    return rates.project(rates.node_rates(points(spark, sf), lattice_of(spark, sf, 10_000.0), P), P, [2000.0, 2002.0, 2005.0, 2010.0])


IDW_SQL = """nn AS (SELECT * FROM (SELECT node_x, node_y, v, sqrt((node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy)) AS d, row_number() OVER (PARTITION BY node_x, node_y ORDER BY (node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy), ci, cj) AS k FROM nodes, cen) WHERE k<=16)"""


def targets(spark, sf):
    return nodes(spark, sf, step=10_000.0).select("node_x", "node_y")


def near16(spark, sf):
    return interpolate.neighbours_of(targets(spark, sf), centroids(spark, sf), "v", target_id=["node_x", "node_y"], source_id=["ci", "cj"], k=16, txy=("node_x", "node_y"), nxy=("cx", "cy"), base=2500.0)


T = ["node_x", "node_y"]


REGRESSION_SQL = """xy AS (SELECT local_dhdt AS vx, dhdt AS vy FROM pr),
 sl AS (SELECT list_sort(list((b.vy-a.vy)/(b.vx-a.vx))) AS s FROM xy a JOIN xy b ON a.vx < b.vx),
 tie AS (SELECT (SELECT sum(k*(k-1)*(2*k+5)) FROM (SELECT count(*)::DOUBLE AS k FROM xy GROUP BY vx)) + (SELECT sum(k*(k-1)*(2*k+5)) FROM (SELECT count(*)::DOUBLE AS k FROM xy GROUP BY vy)) AS t),
 rk AS (SELECT rank() OVER (ORDER BY vx) + (count(*) OVER (PARTITION BY vx)-1)/2.0E0 AS rx, rank() OVER (ORDER BY vy) + (count(*) OVER (PARTITION BY vy)-1)/2.0E0 AS ry FROM xy),
 hd AS (SELECT count(*) AS n, median(vx) AS mx, median(vy) AS my, corr(vy, vx) AS pearson_r, (SELECT corr(rx, ry) FROM rk) AS spearman_r FROM xy),
 ci AS (SELECT n, mx, my, pearson_r, spearman_r, s, list_median(s) AS slope, 1.959963984540054E0*sqrt((n*(n-1.0E0)*(2*n+5)-t)/18) AS reach, len(s) AS np FROM hd, tie, sl)"""


@query(
    "I19_robust_regression",
    with_pts("""SELECT n, slope, s[greatest(round_even((np-reach)/2, 0)::BIGINT, 1)] AS slope_low, s[least(round_even((np+reach)/2, 0)::BIGINT+1, np)] AS slope_high, my-slope*mx AS intercept, pearson_r, spearman_r,
      s[greatest(round_even((np-reach)/2, 0)::BIGINT, 1)] <= 1 AND s[least(round_even((np+reach)/2, 0)::BIGINT+1, np)] >= 1 AS consistent_with_1 FROM ci""", TRACK_SQL, CROSS_SQL, CENT_SQL, PAIR_SQL, REGRESSION_SQL),
    floats="slope slope_low slope_high intercept pearson_r spearman_r", digits=5,
)
def i19(spark, sf):
    """Rates of crossings against those of their nearest nodes."""
    return slopes.robust_regression(agreement_pairs(spark, sf, "local_dhdt", "dhdt"), "local_dhdt", "dhdt")


@query("I20_idw", with_pts("SELECT node_x, node_y, sum(v/(d*d))/sum(1/(d*d)) AS pred, (sum(v*v/(d*d))/sum(1/(d*d))-pow(sum(v/(d*d))/sum(1/(d*d)),2))*1E4 AS var4 FROM nn GROUP BY ALL", tile_nodes_sql(50000, 10000), CENT_SQL, IDW_SQL), floats="pred var4", digits=6)
def i20(spark, sf):
    return interpolate.idw(near16(spark, sf), T, "v").select(*T, "pred", (F.col("var") * 1e4).alias("var4"))


@query("I21_gaussian_kernel", with_pts("SELECT node_x, node_y, sum(w*v)/sum(w) AS pred, (sum(w*v*v)/sum(w)-pow(sum(w*v)/sum(w),2))/greatest(pow(sum(w),2)/sum(w*w),1)*1E4 AS var4 FROM (SELECT *, exp(-d*d/(2*8000.0E0*8000)) AS w FROM nn) GROUP BY ALL HAVING sum(w)>0", tile_nodes_sql(50000, 10000), CENT_SQL, IDW_SQL), floats="pred var4")
def i21(spark, sf):
    return interpolate.gaussian_kernel(near16(spark, sf), T, "v", sigma=8000.0).where(F.col("pred").isNotNull()).select(*T, "pred", (F.col("var") * 1e4).alias("var4"))


@query("I22_median_kernel", with_pts("SELECT node_x, node_y, any_value(m) AS pred, pow(1.253E0*1.4826E0*median(abs(v-m)),2)/count(*)*1E4 AS var4 FROM (SELECT *, median(v) OVER (PARTITION BY node_x, node_y) AS m FROM nn WHERE d<=9000 OR k=1) GROUP BY ALL", tile_nodes_sql(50000, 10000), CENT_SQL, IDW_SQL), floats="pred var4")
def i22(spark, sf):
    return interpolate.median_kernel(near16(spark, sf), T, "v", radius=9000.0).select(*T, "pred", (F.col("var") * 1e4).alias("var4"))


VG = {"model": "spherical", "nugget": 1.0e-6, "sill": 6.0e-6, "range_m": 20_000.0}


@query("I23_kriging")
def i23(spark, sf):
    return interpolate.ordinary_kriging(near16(spark, sf), T, "v", variogram=VG)


@query("I24_optimal_interpolation")
def i24(spark, sf):
    return interpolate.optimal_interpolation(near16(spark, sf), T, "v", variogram=VG)


def folded_cells(spark, sf):
    c = centroids(spark, sf).select("ci", "cj", F.col("cx").alias("x"), F.col("cy").alias("y"), "v")
    c = c.withColumn("bi", F.floor(F.col("x") / 10000)).withColumn("bj", F.floor(F.col("y") / 10000))
    return ranks.block_folds(c, 5, ["bi", "bj"], order=F.pmod(F.col("bi") * 7919 + F.col("bj") * 104729, F.lit(1009)))


@query("I25_cross_validation")
def i25(spark, sf):
    cells = cut(folded_cells(spark, sf))
    r = interpolate.cross_validate(cells, list(interpolate.PREDICTORS), value="v", ids=["ci", "cj"], n_folds=5, k=16, max_lag=40_000.0, base=2500.0)
    return interpolate.prediction_metrics(r, ["method"])


FOLDED_CELLS_SQL = (
    CENT_SQL, "fb AS (SELECT bi, bj, ((row_number() OVER (ORDER BY (bi*7919+bj*104729)%1009, bi, bj)-1)%5)::INT AS fold FROM (SELECT DISTINCT floor(cx/10000)::BIGINT AS bi, floor(cy/10000)::BIGINT AS bj FROM cen))",
    "fc AS MATERIALIZED (SELECT cen.*, fold FROM cen JOIN fb ON bi=floor(cx/10000) AND bj=floor(cy/10000))",
)
FAN_SQL = (
    "nk AS MATERIALIZED (SELECT * FROM (SELECT t.ci, t.cj, t.fold, t.v AS truth, s.v, (t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy) AS d2, row_number() OVER (PARTITION BY t.ci, t.cj ORDER BY (t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy), s.ci, s.cj) AS rk FROM fc t JOIN fc s ON t.fold<>s.fold) WHERE rk<=16)",
    "mn AS (SELECT ci, cj, fold, truth, list(v ORDER BY v) AS l FROM nk WHERE d2<=225000000 OR rk=1 GROUP BY 1,2,3,4)",
    "pd AS (SELECT 'idw' AS method, ci, cj, fold, truth, sum(v/d2)/sum(1/d2) AS pred FROM nk GROUP BY 1,2,3,4,5 UNION ALL SELECT 'gaussian_kernel', ci, cj, fold, truth, sum(v*exp(-d2/2E8))/sum(exp(-d2/2E8)) FROM nk GROUP BY 1,2,3,4,5 UNION ALL SELECT 'median_kernel', ci, cj, fold, truth, list_median(l) FROM mn)",
)


@query("C21_fold_methods", with_pts("SELECT fold, method, count(*) AS n, sqrt(avg((pred-truth)*(pred-truth))) AS rmse, avg(pred-truth) AS bias FROM pd GROUP BY fold, method", *FOLDED_CELLS_SQL, *FAN_SQL), floats="rmse bias", digits=8)
def c21(spark, sf):
    """Every fold with every method: one search for neighbours, one grouping a method."""
    cells = cut(folded_cells(spark, sf))
    r = interpolate.cross_validate(cells, ["idw", "gaussian_kernel", "median_kernel"], value="v", ids=["ci", "cj"], n_folds=5, k=16, base=2500.0, options={"sigma": 10_000.0, "radius": 15_000.0})
    return r.groupBy("fold", "method").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("rmse"), F.avg("resid").alias("bias"))


GRID_PRED_SQL = """gx AS (SELECT x0+i*5000.0E0 AS gx, y0+j*5000.0E0 AS gy FROM (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM cen), (SELECT unnest(range(0,40)) AS i), (SELECT unnest(range(0,40)) AS j) WHERE x0+i*5000.0E0<=x1+5E-6 AND y0+j*5000.0E0<=y1+5E-6),
 gn AS (SELECT * FROM (SELECT gx, gy, v, 0.001E0+v/100 AS s, (gx-cx)*(gx-cx)+(gy-cy)*(gy-cy) AS d2, row_number() OVER (PARTITION BY gx, gy ORDER BY (gx-cx)*(gx-cx)+(gy-cy)*(gy-cy), ci, cj) AS k FROM gx, cen) WHERE k<=16)"""


@query("I26_grid_prediction", with_pts("SELECT gx, gy, sum(v/d2)/sum(1/d2) AS pred, sum(s/d2)/sum(1/d2) AS sigma_input FROM gn GROUP BY gx, gy", CENT_SQL, GRID_PRED_SQL), floats="gx gy pred sigma_input")
def i26(spark, sf):
    c = centroids(spark, sf).withColumn("s", F.lit(0.001) + F.col("v") / 100)
    return interpolate.interpolate_to_grid(c, "idw", value="v", sigma="s", source_id=["ci", "cj"], res=5000.0, k=16, x="cx", y="cy").select("gx", "gy", "pred", "sigma_input")


IDW_RESIDUAL_SQL = """ir AS (SELECT ci, cj, cx, cy, sum(sv/(d*d))/sum(1/(d*d))-any_value(v) AS resid FROM (SELECT t.ci, t.cj, t.cx, t.cy, t.v, s.v AS sv, sqrt((t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy)) AS d,
   row_number() OVER (PARTITION BY t.ci, t.cj ORDER BY (t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy), s.ci, s.cj) AS rk FROM fc t JOIN fc s ON t.fold<>s.fold) WHERE rk<=16 GROUP BY ci, cj, cx, cy)"""
def correlated(spark, sf):
    """What is correlated over distance: the signal, the residuals of its cross-validation, and rates at crossings."""
    cells = cut(folded_cells(spark, sf))
    r = interpolate.cross_validate(cells, ["idw"], value="v", ids=["ci", "cj"], n_folds=5, k=16, base=2500.0)
    residuals = cut(r.join(cells.select("ci", "cj", "x", "y"), ["ci", "cj"]))
    crossings = cut(crossing_table(spark, sf).select("track1", "track2", "x", "y", "dhdt").where(F.col("dhdt").isNotNull()))
    cell_id = ["ci", "cj"]
    return {"signal": (cells, "v", cell_id, 40_000.0), "residual": (residuals, "resid", cell_id, 40_000.0), "crossing": (crossings, "dhdt", ["track1", "track2"], 20_000.0)}


@query("I27_residual_correlation")
def i27(spark, sf):
    """Range of the signal, of its cross-validation residuals, and of rates at crossings; a kind with under 50 rows has none."""
    rows = []
    for kind, (df, col, ids, reach) in correlated(spark, sf).items():
        n = df.count()
        if n >= 50:
            f = interpolate.fit_variogram(df, col, ids=ids, max_lag=reach)
            rows.append((kind, n, f["model"], f["range_m"], f["sill"], f["nugget"], f["nugget"] / f["sill"] if f["sill"] > 0 else None))
    return spark.createDataFrame(rows, "kind string, n bigint, model string, range_m double, sill double, nugget double, nugget_fraction double")


@query(
    "I27_lag_rows",
    with_pts(
        "SELECT kind, lag, count(*) AS n_pairs, avg(g) AS gamma, (lag+0.5E0)*any_value(w) AS center FROM (SELECT kind, w, floor(d/w)::INT AS lag, g FROM (SELECT a.kind, a.w, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, 0.5E0*(a.v-b.v)*(a.v-b.v) AS g FROM al a JOIN al b ON a.kind=b.kind AND a.i<b.i) WHERE d<15*w) GROUP BY kind, lag",
        TRACK_SQL, CROSS_SQL, *FOLDED_CELLS_SQL, IDW_RESIDUAL_SQL,
        "al AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM (SELECT 'signal' AS kind, 40000.0E0/15 AS w, cx AS x, cy AS y, v FROM cen UNION ALL SELECT 'residual', 40000.0E0/15, cx, cy, resid FROM ir UNION ALL SELECT 'crossing', 20000.0E0/15, x, y, dhdt FROM xo WHERE dhdt IS NOT NULL))",
    ),
    floats="gamma center", digits=7,
)
def i27_lags(spark, sf):
    parts = [interpolate.empirical_variogram(df, col, ids=ids, max_lag=reach).withColumn("kind", F.lit(kind)) for kind, (df, col, ids, reach) in correlated(spark, sf).items()]
    return reduce(lambda a, b: a.unionByName(b), parts).select("kind", "lag", "n_pairs", "gamma", "center")


VALIDATION_SQL = (
    FOLD_SQL,
    "pf AS MATERIALIZED (SELECT pts.*, fold FROM pts JOIN fo ON bi=floor(x/10000) AND bj=floor(y/10000))",
    "tv AS (SELECT p.* EXCLUDE (fold), f AS fold FROM pf p, (SELECT unnest(range(0,5))::INT AS f) WHERE fold<>f)",
    neighbours_sql(15000, "fold, ", "tv"), robust_sql("fit", "pw", "node_x, node_y, fold", P),
    """rs AS MATERIALIZED (SELECT pa, pb, pc, pd, x, y, t_year, s_elv, fold, h-p0-dhdt*(t_year-1998.5E0) AS resid, p0_err*p0_err+power(dhdt_err*(t_year-1998.5E0), 2) AS var FROM (SELECT pf.*, p0, dhdt, p0_err, dhdt_err,
      row_number() OVER (PARTITION BY pa, pb, pc, pd ORDER BY (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y), node_x, node_y) AS k FROM pf JOIN fit USING (fold) WHERE (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 1E8) WHERE k=1)""",
)
STRATA_SQL = (
    # Cells say how far other folds are at the most, and which of their cells can hold the nearest point: within 2 sqrt(2) cells more than the nearest centre.
    "gp AS MATERIALIZED (SELECT x, y, fold, floor(x/1000)::BIGINT AS gi, floor(y/1000)::BIGINT AS gj FROM pf)", "gc AS MATERIALIZED (SELECT DISTINCT fold, gi, gj FROM gp)",
    "nc AS MATERIALIZED (SELECT a.fold, a.gi, a.gj, sqrt(min((a.gi-b.gi)*(a.gi-b.gi)+(a.gj-b.gj)*(a.gj-b.gj)))+3 AS reach FROM gc a JOIN gc b ON a.fold<>b.fold GROUP BY ALL)",
    "cc AS MATERIALIZED (SELECT a.fold, a.gi, a.gj, b.fold AS other, b.gi AS hi, b.gj AS hj FROM nc a JOIN gc b ON a.fold<>b.fold AND (a.gi-b.gi)*(a.gi-b.gi)+(a.gj-b.gj)*(a.gj-b.gj)<=reach*reach)",
    "nd AS (SELECT pa, pb, pc, pd, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM (SELECT rs.*, floor(x/1000)::BIGINT AS gi, floor(y/1000)::BIGINT AS gj FROM rs) a "
    "JOIN cc USING (fold, gi, gj) JOIN gp b ON b.fold=other AND b.gi=hi AND b.gj=hj GROUP BY ALL)",
    "lg AS (SELECT fold, resid, 'dist_to_train' AS stratum, d AS v FROM rs JOIN nd USING (pa, pb, pc, pd) UNION ALL SELECT fold, resid, 'year', floor(t_year) FROM rs UNION ALL SELECT fold, resid, 's_elv', s_elv FROM rs)",
    "ed AS (SELECT fold, stratum, list_sort(list_distinct([min(v), quantile_cont(v,0.25), quantile_cont(v,0.5), quantile_cont(v,0.75), max(v)])) AS e FROM lg GROUP BY 1,2 HAVING count(*)>=10)",
)


def validated(spark, sf):
    p = cut(folded(spark, sf).select(*IDS, "x", "y", "h", "t_year", "s_elv", "fold"))
    return p, interpolate.observation_validation(p, lattice_of(spark, sf, 10_000.0), P, n_folds=5, max_distance=10_000.0, ids=IDS)


@query(
    "I28_observation_validation",
    with_pts("SELECT fold, count(*) AS n, sqrt(avg(resid*resid)) AS rmse, avg(abs(resid)) AS mae, avg(resid) AS bias, avg((abs(resid)/sqrt(var)<=1)::INT) AS coverage_68, avg((abs(resid)/sqrt(var)<=1.96E0)::INT) AS coverage_95, stddev_pop(resid/sqrt(var)) AS z_std FROM rs GROUP BY fold", tile_nodes_sql(50000, 10000), *VALIDATION_SQL),
    floats="rmse mae bias coverage_68 coverage_95 z_std", digits=4,
)
def i28(spark, sf):
    return interpolate.prediction_metrics(validated(spark, sf)[1], ["fold"])


@query(
    "I28_error_by_strata",
    with_pts("SELECT fold, stratum, greatest(len(list_filter(e, lambda q: q<v))-1, 0)::INT+1 AS quartile, count(*) AS n, sqrt(avg(resid*resid)) AS rmse FROM lg JOIN ed USING (fold, stratum) GROUP BY 1,2,3", tile_nodes_sql(50000, 10000), *VALIDATION_SQL, *STRATA_SQL),
    floats="rmse", digits=5,
)
def i28_strata(spark, sf):
    """Error of held-out heights by quartile of the distance to the training points, of the year and of the stated sigma."""
    p, r = validated(spark, sf)
    r = interpolate.distance_to_train(cut(r), p, ids=IDS, n_folds=5)
    r = cut(r.select("fold", "resid", "t_year", "s_elv", "dist_to_train"))  # the classes read it more than once
    return interpolate.error_by_strata(r, {"dist_to_train": F.col("dist_to_train"), "year": F.floor("t_year"), "s_elv": F.col("s_elv")}, ["fold"])


@query(
    "I32_idw_search",
    with_pts("""SELECT k, p AS power, count(*) AS n, sqrt(avg((pred-v)*(pred-v))) AS rmse, avg(abs(pred-v)) AS mae FROM (SELECT k, p, ci, cj, any_value(tv) AS v, sum(w*sv)/sum(w) AS pred FROM (SELECT kk.k, pp.p, nb.*, 1/pow(greatest(d,1.0E0),pp.p) AS w FROM
      (SELECT t.ci, t.cj, t.v AS tv, s.v AS sv, sqrt((t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy)) AS d, row_number() OVER (PARTITION BY t.ci, t.cj ORDER BY (t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy), s.ci, s.cj) AS rk FROM fc t JOIN fc s ON t.fold<>s.fold) nb, (VALUES (4),(8),(16)) kk(k), (VALUES (1.0E0),(2.0E0)) pp(p) WHERE rk<=kk.k) GROUP BY k, p, ci, cj) GROUP BY 1,2""",
             CENT_SQL, "fb AS (SELECT bi, bj, ((row_number() OVER (ORDER BY (bi*7919+bj*104729)%1009, bi, bj)-1)%5)::INT AS fold FROM (SELECT DISTINCT floor(cx/10000)::BIGINT AS bi, floor(cy/10000)::BIGINT AS bj FROM cen))", "fc AS (SELECT cen.*, fold FROM cen JOIN fb ON bi=floor(cx/10000) AND bj=floor(cy/10000))"),
    floats="rmse mae", digits=9,
)
def i32(spark, sf):
    return interpolate.idw_search(cut(folded_cells(spark, sf)), [4, 8, 16], [1.0, 2.0], value="v", ids=["ci", "cj"], n_folds=5, base=2500.0)


@query(
    "I32_idw_search_buffered",
    with_pts(
        """SELECT k, p AS power, count(*) AS n, count(*)/(SELECT count(*) FROM fc) AS coverage_fraction, sqrt(avg((pred-v)*(pred-v))) AS rmse, avg(abs(pred-v)) AS mae, avg(pred-v) AS bias, median(near) AS median_nearest FROM (SELECT k, p, ci, cj, any_value(tv) AS v, sum(w*sv)/sum(w) AS pred, min(d) AS near, count(*) AS c FROM (SELECT kk.k, pp.p, nb.*, 1/pow(greatest(d,1.0E0),pp.p) AS w FROM
          (SELECT t.ci, t.cj, t.v AS tv, s.v AS sv, sqrt((t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy)) AS d, row_number() OVER (PARTITION BY t.ci, t.cj ORDER BY (t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy), s.ci, s.cj) AS rk FROM fc t JOIN tr s ON t.fold=s.held) nb, (VALUES (4),(8),(16)) kk(k), (VALUES (1.0E0),(2.0E0)) pp(p) WHERE rk<=kk.k) GROUP BY k, p, ci, cj) WHERE c=k AND near<=25000 GROUP BY 1,2""",
        *FOLDED_CELLS_SQL,
        "tr AS MATERIALIZED (SELECT s.*, h AS held FROM fc s, (SELECT unnest(range(0,5))::INT AS h) WHERE s.fold<>h AND NOT EXISTS (SELECT 1 FROM fc t WHERE t.fold=h AND (t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy)<64000000))",
    ),
    floats="coverage_fraction rmse mae bias median_nearest", digits=7,
)
def i32_buffered(spark, sf):
    cells = cut(folded_cells(spark, sf))
    return interpolate.idw_search_buffered(cells, [4, 8, 16], [1.0, 2.0], value="v", ids=["ci", "cj"], n_folds=5, buffer_m=8000.0, max_support=25_000.0, base=2500.0)


def shelf_cells(spark, sf):
    return centroids(spark, sf).select("ci", "cj", F.col("cx").alias("x"), F.col("cy").alias("y"), "v", F.when(F.col("ci") + F.col("cj") < 3, "tiny").when(F.col("ci") < 8, "west").otherwise("east").alias("shelf"))


@query(
    "I33_within_shelves",
    with_pts(
        "SELECT node_x, node_y, shelf, dist, fallback, sum(v*w)/sum(w) AS pred, greatest(sum(v*v*w)/sum(w)-pow(sum(v*w)/sum(w),2),0)*1E4 AS var4 FROM (SELECT *, 1/pow(greatest(d,1),2) AS w FROM nn WHERE k<=8) GROUP BY ALL",
        tile_nodes_sql(50000, 10000), CENT_SQL, "sc AS (SELECT *, CASE WHEN ci+cj<3 THEN 'tiny' WHEN ci<8 THEN 'west' ELSE 'east' END AS shelf FROM cen)", "sz AS (SELECT shelf, count(*) AS m FROM sc GROUP BY shelf)",
        "pd AS (SELECT node_x, node_y, ci, cj, v, shelf AS own, sqrt((node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy)) AS d, row_number() OVER (PARTITION BY node_x, node_y ORDER BY (node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy), ci, cj) AS r FROM nodes, sc)",
        "pl AS (SELECT node_x, node_y, own AS shelf, d AS dist, m<4 AS fallback FROM pd JOIN sz ON sz.shelf=own WHERE r=1 AND d<=20000)",
        "nn AS (SELECT pd.node_x, pd.node_y, pl.shelf, dist, fallback, v, d, row_number() OVER (PARTITION BY pd.node_x, pd.node_y ORDER BY r) AS k FROM pd JOIN pl ON pl.node_x=pd.node_x AND pl.node_y=pd.node_y AND (fallback OR own=pl.shelf))",
    ),
    floats="pred var4 dist",
)
def i33(spark, sf):
    t = targets(spark, sf).select(F.col("node_x").alias("x"), F.col("node_y").alias("y"), "node_x", "node_y")
    r = interpolate.interpolate_within(t, cut(shelf_cells(spark, sf)), "v", target_id=["node_x", "node_y"], source_id=["ci", "cj"], k=8, base=2500.0, max_distance=20_000.0)
    return r.select("node_x", "node_y", "shelf", "dist", "fallback", "pred", (F.col("var") * 1e4).alias("var4"))


@query(
    "I34_masked_resampling",
    with_pts(
        "SELECT ti, tj, CASE WHEN support_m<=3000 THEN pred END AS pred, support_m FROM (SELECT ti, tj, sum(v/pow(greatest(d,1),2))/sum(1/pow(greatest(d,1),2)) AS pred, min(d) AS support_m FROM nn WHERE k<=8 GROUP BY 1,2)",
        CENT_SQL, "cl AS (SELECT floor(x/2000)::BIGINT AS ti, floor(y/2000)::BIGINT AS tj, mask_class, count(*) AS n FROM pts GROUP BY ALL)",
        "tg AS (SELECT ti, tj, (ti+0.5E0)*2000 AS x, (tj+0.5E0)*2000 AS y FROM (SELECT ti, tj, arg_max(mask_class, (n, -mask_class)) AS c FROM cl GROUP BY ti, tj) WHERE c=3)",
        "nn AS (SELECT ti, tj, v, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS d, row_number() OVER (PARTITION BY ti, tj ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy), ci, cj) AS k FROM tg, cen)",
    ),
    floats="pred support_m",
)
def i34(spark, sf):
    """Onto 2 km cells of the floating class, null beyond the support distance."""
    t = interpolate.class_cells(points(spark, sf), 2000.0, 3).withColumnRenamed("ci", "ti").withColumnRenamed("cj", "tj")
    near = interpolate.neighbours_of(t, centroids(spark, sf), "v", target_id=["ti", "tj"], source_id=["ci", "cj"], k=8, nxy=("cx", "cy"), base=2500.0)
    far = near.groupBy("ti", "tj").agg(F.sqrt(F.min("d2")).alias("support_m"))
    p = interpolate.idw(near, ["ti", "tj"], "v", exact_eps=1e-6, floor=1.0).join(far, ["ti", "tj"])
    return p.select("ti", "tj", F.when(F.col("support_m") <= 3000.0, F.col("pred")).alias("pred"), "support_m")


@query("M01_predictor_registry")
def m01(spark, sf):
    near = cut(near16(spark, sf))
    out = None
    for name, fn in interpolate.PREDICTORS.items():
        p = fn(near, T, "v", variogram=VG).agg(F.count("pred").alias("n"), F.avg("pred").alias("mean_pred")).withColumn("method", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


@query("M02_model_registry")
def m02(spark, sf):
    mine = {"flat": ("constant", "linear"), "tilted": ("constant", "spatial", "linear")}
    return yearblocks.best_models(yearblocks.compare_models(blocks(spark, sf, 25_000.0), candidates=mine))


@query("M03_criteria_as_data")
def m03(spark, sf):
    c = yearblocks.AccelCriteria(delta_aicc=0.0, max_ac1=0.9, draws=50)
    a = yearblocks.assess_acceleration(pairs_of(spark, sf, 25_000.0), radius=15000.0, t_ref=1998.5, criteria=c, ties=IDS)
    return a.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("accel_supported").alias("n_supported"))




@query(
    "D39_seasonal_amplitude",
    with_pts("SELECT ci, cj, n, x1_0 AS rate, sqrt(x2_0*x2_0+x3_0*x3_0) AS amplitude FROM hf",
             "rw AS (SELECT floor(x/20000)::BIGINT AS ci, floor(y/20000)::BIGINT AS cj, h, 1.0E0 AS w, 1.0E0 AS q0, t_year-1998.5E0 AS q1, cos(2*pi()*t_year) AS q2, sin(2*pi()*t_year) AS q3 FROM pts)", *solved_sql("hf", "rw", "ci, cj", 4, 0)),
    floats="rate amplitude",
)
def d39(spark, sf):
    """Constant, trend and annual harmonic per cell from sums of products."""
    from cryoframe.operators.blocks import moment_sums, solve_sums

    import math

    p = points(spark, sf).withColumn("ci", spatial.cell("x", 20000)).withColumn("cj", spatial.cell("y", 20000))
    arg = F.col("t_year") * F.lit(2 * math.pi)
    basis = {"one": F.lit(1.0), "t": F.col("t_year") - 1998.5, "c": F.cos(arg), "s": F.sin(arg)}
    fit = solve_sums(moment_sums(p, ["ci", "cj"], basis, F.col("h")), ["ci", "cj"], list(basis))
    return fit.where(F.col("coef").isNotNull()).select("ci", "cj", "n", F.element_at("coef", 2).alias("rate"), F.hypot(F.element_at("coef", 3), F.element_at("coef", 4)).alias("amplitude"))


