"""Queries over mass, experiments and streams (D08-D21, K, L) and the flagship."""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from cryoframe.operators import experiments, mass, poisson, rates, robust, spatial
from cryoframe.operators.blocks import line_fit, node_series
from cryoframe.operators.skew import group_quantiles
from cryoframe.plans.base import IDS, points, query, table, tile_nodes_sql, with_pts
from cryoframe.plans.fit_sql import robust_sql
from cryoframe.plans.q_predicates import node_stats
from cryoframe.plans.q_sources import scratch, stored_points
from cryoframe.plans.q_spatial import nodes
from cryoframe.plans.q_stats import D01, D01_SQL, YC_SQL, yearly_cells
from cryoframe.session import cut
from cryoframe.streaming import incremental

SER2_SQL = """pw AS (SELECT node_x, node_y, "year", (x-node_x)/15000 AS u, (y-node_y)/15000 AS v, h FROM st JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 15000.0E0*15000.0E0),
 ms AS (SELECT node_x, node_y, "year", count(*) AS n_obs, avg(h) AS mh, avg(u) AS mu, avg(v) AS mv, var_pop(u)*count(*) AS a, var_pop(v)*count(*) AS d, covar_pop(u,v)*count(*) AS o, covar_pop(u,h)*count(*) AS p, covar_pop(v,h)*count(*) AS q FROM pw GROUP BY ALL HAVING count(*)>=10),
 ser AS (SELECT node_x, node_y, "year", mh-(p*d-q*o)/(a*d-o*o)*mu-(q*a-p*o)/(a*d-o*o)*mv AS h_node FROM ms WHERE a*d-o*o>1E-10*a*d),
 rt AS (SELECT node_x, node_y, count(*) AS n, regr_slope(h_node,"year") AS slope, regr_sxx(h_node,"year") AS sxx, regr_syy(h_node,"year") AS syy, regr_sxy(h_node,"year") AS sxy FROM ser GROUP BY ALL HAVING count(*)>=4),
 rv AS (SELECT slope AS pred, greatest(syy-sxy*sxy/sxx,0)/(n-2)/sxx AS var FROM rt)"""


def mass_sql(src: str, cell_m: float, length: float, by: str = "") -> str:
    a, k = cell_m**2, 917.0 / 1e12
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    sb = "coalesce(sqrt(avg(CASE WHEN var>=0 THEN var END)),0)"
    return (
        f"SELECT {head}count(pred) AS n_cells, avg(pred) AS dhdt_mean, {sb} AS sigma_bar, count(pred)*{a!r}::DOUBLE/1E6 AS area_km2, sum(pred)*{a!r}::DOUBLE AS dvdt_m3, sum(pred)*{a!r}::DOUBLE*{k!r} AS dmdt_gt, "
        f"-sum(pred)*{a!r}::DOUBLE*{k!r}/361.8E0 AS sle_mm, {sb}*sqrt(count(pred)*{a * a!r}::DOUBLE)*{k!r} AS sigma_gt_independent, {sb}*sqrt(count(pred)*{a!r}::DOUBLE*{math.pi * length**2!r})*{k!r} AS sigma_gt_correlated, "
        f"{sb}*sqrt(count(pred)*{a!r}::DOUBLE*{math.pi * length**2!r})*{k!r}/361.8E0 AS sigma_sle_correlated, {math.sqrt(math.pi) * length / cell_m!r} AS inflation FROM {src}{tail}"
    )


MASS_FLOATS = "dhdt_mean sigma_bar area_km2 dvdt_m3 dmdt_gt sle_mm sigma_gt_independent sigma_gt_correlated sigma_sle_correlated inflation"


@query("Z01_points_to_mass", with_pts("SELECT * REPLACE (dvdt_m3/1E9 AS dvdt_m3) FROM (" + mass_sql("rv", 5000.0, 34100.0) + ")", D01_SQL, tile_nodes_sql(50000, 5000, "st"), SER2_SQL), floats=MASS_FLOATS, digits=5)
def z01(spark, sf):
    """Points, space-time filter, node-year planes, node rates, mass: native expressions throughout."""
    kept = cut(robust.filter_space_time(points(spark, sf).select("x", "y", "t_year", "year", "h"), checkpoint=True, **D01))
    grid = spatial.lattice(kept, 50_000, 5_000)
    pairs = spatial.radius_join(kept.select("x", "y", "h", "year"), grid.select("node_x", "node_y"), 15_000.0)
    rate = line_fit(node_series(pairs, radius=15_000.0), ["node_x", "node_y"], "h_node", "year")
    m = mass.mass_balance(rate.select(F.col("slope").alias("pred"), (F.col("slope_sigma") ** 2).alias("var")), 5_000.0, 34_100.0)
    return m.withColumn("dvdt_m3", F.col("dvdt_m3") / 1e9)


ND_SQL = 'gv AS (SELECT floor(x/5000) AS ci, avg(disc)*20-1.2E0 AS pred, stddev_samp(disc)*2 AS var, mask_class FROM pts GROUP BY floor(x/5000), floor(y/5000), mask_class)'


def rate_grid(spark, sf):
    return points(spark, sf).groupBy(spatial.cell("x", 5000).alias("ci"), spatial.cell("y", 5000).alias("cj"), "mask_class").agg(
        (F.avg("disc") * 20 - 1.2).alias("pred"), (F.stddev_samp("disc") * 2).alias("var"))


@query("D16_mass_balance", with_pts("SELECT * REPLACE (dvdt_m3/1E9 AS dvdt_m3) FROM (" + mass_sql("gv", 5000.0, 34100.0, "mask_class") + ")", ND_SQL), floats=MASS_FLOATS, digits=5)
def d16(spark, sf):
    return mass.mass_balance(rate_grid(spark, sf), 5000.0, 34100.0, by=["mask_class"]).withColumn("dvdt_m3", F.col("dvdt_m3") / 1e9)


@query("D17_two_component_sigma", with_pts("SELECT mask_class, sqrt(w*w*A*25E6+c*c*A*pi()*34100.0E0*34100)*917E-12 AS sigma_gt, sqrt(w*w*A*25E6)*917E-12 AS white_gt, sqrt(c*c*A*pi()*34100.0E0*34100)*917E-12 AS correlated_gt FROM (SELECT mask_class, count(*)*25E6 AS A, stddev_samp(pred) AS w, 0.02E0 AS c FROM gv GROUP BY mask_class)", ND_SQL), floats="sigma_gt white_gt correlated_gt")
def d17(spark, sf):
    g = rate_grid(spark, sf).groupBy("mask_class").agg((F.count(F.lit(1)) * 25e6).alias("A"), F.stddev_samp("pred").alias("w"))
    c = mass.two_component_sigma(F.col("A"), 5000.0, F.col("w"), F.lit(0.02), 34100.0)
    return g.select("mask_class", *[v.alias(k) for k, v in c.items()])


@query("D18_systematic_sigma", with_pts("SELECT avg(var) AS sigma_mean, count(*) AS n, avg(var)*count(*)*25E6*917E-12 AS sigma_gt FROM gv", ND_SQL), floats="sigma_mean sigma_gt")
def d18(spark, sf):
    return mass.systematic_sigma(rate_grid(spark, sf), "var", 5000.0)


@query("D19_rate_sweep", with_pts("SELECT r AS rate, sum(pred-r)*25E6*917E-12 AS dmdt_gt, -r*count(*)*25E6*917E-12 AS delta_gt FROM gv, (VALUES (-0.1E0),(-0.05E0),(-0.02E0),(0.0E0),(0.02E0),(0.05E0),(0.1E0)) v(r) GROUP BY r", ND_SQL), floats="dmdt_gt delta_gt")
def d19(spark, sf):
    return mass.rate_sweep(rate_grid(spark, sf), 5000.0, 34100.0).select("rate", "dmdt_gt", "delta_gt")


@query(
    "D08_node_year_medians",
    with_pts('SELECT node_x, node_y, "year", count(*) AS n, median(h) AS h_med FROM nb WHERE m>=30 GROUP BY ALL HAVING count(*)>=12', tile_nodes_sql(50000, 5000), 'nb AS (SELECT node_x, node_y, "year", h, count(*) OVER (PARTITION BY node_x, node_y) AS m FROM pts JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 5000.0E0*5000)'),
    floats="h_med",
)
def d08(spark, sf):
    nd = nodes(spark, sf).select("node_x", "node_y")
    pairs = spatial.radius_join(points(spark, sf).select("x", "y", "h", "year"), nd, 5000.0)
    hot = rates.crowded(points(spark, sf), nd, 5000.0, 2_000_000)
    med = group_quantiles(pairs, ["node_x", "node_y", "year"], "h", {"h_med": 0.5}, hot=None if hot is None else "check")
    rich = med.groupBy("node_x", "node_y").agg(F.sum("n").alias("_m")).where(F.col("_m") >= 30).select("node_x", "node_y")
    return med.where(F.col("n") >= 12).join(rich, ["node_x", "node_y"], "left_semi")


@query("D09_cumulative_mass", with_pts('SELECT "year", count(*) AS n_nodes, avg(a) AS mean_anomaly, avg(a)*count(*)*25E6*917E-12 AS mass_gt, avg(a)*0.917E0 AS mwe FROM (SELECT "year", h_y-arg_min(h_y,"year") OVER (PARTITION BY cell_x, cell_y) AS a FROM yc WHERE (cell_x,cell_y) IN (SELECT (cell_x,cell_y) FROM yc GROUP BY cell_x,cell_y HAVING count(*)=(SELECT count(DISTINCT "year") FROM yc))) GROUP BY "year"', YC_SQL), floats="mean_anomaly mass_gt mwe")
def d09(spark, sf):
    return mass.cumulative_mass(yearly_cells(spark, sf), ["cell_x", "cell_y"], "h_y", 5000.0)


SLOPE_SQL = """sl AS (SELECT l_extendedprice/1E5 AS s, 0.1E0+l_extendedprice/2E5+l_tax/10 AS e FROM lineitem),
 qe AS (SELECT quantile_cont(s, [""" + ", ".join(repr(i / 12) for i in range(13)) + """]) AS q FROM sl),
 sb AS (SELECT s, e, greatest(len(list_filter(q, lambda z: z < s))-1, 0) AS b FROM sl, qe),
 sm AS (SELECT b, median(s) AS ms, median(e) AS me FROM sb GROUP BY b HAVING count(*)>=500)"""


@query("D21_error_calibration", f"WITH {SLOPE_SQL} SELECT sqrt(greatest(regr_intercept(me*me, ms*ms),0)) AS sigma_vertical, sqrt(greatest(regr_slope(me*me, ms*ms),0)) AS sigma_horizontal, regr_r2(me*me, ms*ms) AS r2, count(*) AS n_bins FROM sm", floats="sigma_vertical sigma_horizontal r2", digits=5)
def d21(spark, sf):
    f = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1e5).alias("s"), (F.lit(0.1) + F.col("l_extendedprice") / 2e5 + F.col("l_tax") / 10).alias("e"))
    return mass.calibrate_slope_error(f, slope="s", sigma="e", bins=12)


# ------------------------------------------------------------------ experiments
P = rates.RateParams(radius=15_000.0, t_ref=1998.5)


GRID = experiments.parameter_grid(experiments.STANDARD_BASELINE, experiments.STANDARD_CHANGES)
NAMES_SQL = ", ".join(f"({k}, '{c['name']}')" for k, c in enumerate(GRID))
DRAWS = 100


def region_lattice(spark, sf):
    """Nodes every 10 km with the region (a tile of 50 km) and a number of the node that no configuration changes."""
    n = nodes(spark, sf, step=10_000.0)
    return n.select("node_x", "node_y", (F.col("tile_i") * 100 + F.col("tile_j")).cast("int").alias("region"), ((F.col("node_x") - 5000) / 10_000 * 1000 + (F.col("node_y") - 5000) / 10_000).cast("bigint").alias("unit"))


def filtered_points(spark, sf):
    """Points with a bit for every distinct setting of the filters; a pass is a supplier's points in order of time."""
    from pyspark.sql import Window

    p = points(spark, sf).select(*IDS, "x", "y", "t_year", "h", "s_elv")
    p = cut(p.withColumn("pos", F.row_number().over(Window.partitionBy("pc").orderBy("t_year", "pa", "pb", "pd")).cast("bigint") - 1).drop("pa", "pb", "pd"))
    return experiments.with_filters(p, GRID, height="h", track="pc", position="pos", space_time=D01)


def grid_fits(spark, sf):
    p, bits = filtered_points(spark, sf)
    p = cut(p.select("x", "y", "t_year", "h", "s_elv", "kept"))  # fits read it more than once
    lattice = region_lattice(spark, sf)
    fits = experiments.run_grid(p, lattice, GRID, bits, P)
    return cut(fits.select("node_x", "node_y", "config", "dhdt", "rmse", "nobs").join(F.broadcast(cut(lattice)), ["node_x", "node_y"]))


def config_names(spark):
    return F.broadcast(spark.createDataFrame([(k, c["name"]) for k, c in enumerate(GRID)], "config int, name string"))


def grid_sql() -> list[str]:
    """Filters, then the fit of each configuration, as one table per step."""
    settings = list(dict.fromkeys(map(experiments.filter_settings, GRID)))
    along = list(dict.fromkeys((w, f) for w, f, _ in settings))
    frame = lambda half: f"(PARTITION BY pc ORDER BY t_year, pa, pb, pd ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    parts = ["tk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY t_year, pa, pb, pd) AS rn, count(*) OVER (PARTITION BY pc) AS m FROM pts)"]
    for k, (w, f) in enumerate(along):
        half, wide = w // 2, w * f // 2
        parts.append(
            f"al{k} AS MATERIALIZED (SELECT * EXCLUDE (r, rn, m) FROM (SELECT *, greatest(1.4826E0*median(abs(r)) OVER {frame(wide)}, 0.1E0) AS mad FROM (SELECT *, h-median(h) OVER {frame(half)} AS r FROM tk)) "
            f"WHERE NOT (rn>{half} AND m-rn>={half} AND abs(r)>5*mad))"
        )
    for k, (w, f, both) in enumerate(settings):
        source = f"al{along.index((w, f))}"
        if both:
            st = D01_SQL
            for name in ("p1", "m1", "k1", "p2", "m2", "st"):
                st = st.replace(f"{name} AS (", f"{name}_{k} AS (").replace(f"FROM {name}", f"FROM {name}_{k}")
            parts.append(st.replace("FROM pts", f"FROM (SELECT * EXCLUDE (mad) FROM {source})"))
            source = f"st_{k}"
        parts.append(f"kp{k} AS (SELECT * FROM {source})")
    rules = [f"{k} AS config, {c['radius']}E0 AS rad, {c['n_sigma']}E0 AS ns, {c['residual_limit']}E0 AS rl, {c['min_points']} AS mp, x, y, t_year, h, s_elv FROM kp{settings.index(experiments.filter_settings(c))}" for k, c in enumerate(GRID)]
    keys = "config, ns, rl, mp, node_x, node_y"
    parts += [
        f"pool AS MATERIALIZED (SELECT {' UNION ALL SELECT '.join(rules)})",
        f"pw AS MATERIALIZED (SELECT {keys}, t_year-1998.5E0 AS t, (x-node_x)/rad AS u, (y-node_y)/rad AS v, h, 1/(s_elv*s_elv+1E-12) AS w FROM pool JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= rad*rad)",
        robust_sql("fit", "pw", keys, P, n_sigma="ns", residual_limit="rl", min_points="mp"),
        "fits AS MATERIALIZED (SELECT config, node_x, node_y, dhdt, rmse, nobs, (floor(node_x/50000)*100+floor(node_y/50000))::INT AS region, ((node_x-5000)/10000*1000+(node_y-5000)/10000)::BIGINT AS unit FROM fit)",
    ]
    parts.append(f"nm AS (SELECT * FROM (VALUES {NAMES_SQL}) v(config, name))")
    return parts


def kept_sql() -> str:
    settings = list(dict.fromkeys(map(experiments.filter_settings, GRID)))
    each = " UNION ALL ".join(f"SELECT '{c['name']}' AS name, count(*) AS n_kept FROM kp{settings.index(experiments.filter_settings(c))}" for c in GRID)
    return f"SELECT name, (SELECT count(*) FROM pts) AS n_points, n_kept, n_kept/(SELECT count(*) FROM pts) AS frac_retained FROM ({each})"


FILTERS_SQL = [part for part in grid_sql() if part.split(" ")[0].rstrip("0123456789") in ("tk", "al", "p1_", "kp")]


@query("K01_parameter_grid", with_pts(kept_sql(), *FILTERS_SQL), floats="frac_retained")
def k01(spark, sf):
    """Retention of every configuration: filters worked out once for each distinct setting."""
    p, bits = filtered_points(spark, sf)
    counts = p.agg(F.count(F.lit(1)).alias("n_points"), *[F.count_if(F.shiftright("kept", b) % 2 == 1).alias(f"k{b}") for b in sorted(set(bits))])
    each = F.explode(F.array(*[F.struct(F.lit(c["name"]).alias("name"), F.col(f"k{b}").alias("n_kept")) for c, b in zip(GRID, bits, strict=True)])).alias("c")
    return counts.select("n_points", each).select("c.name", "n_points", "c.n_kept", (F.col("c.n_kept") / F.col("n_points")).alias("frac_retained"))


@query(
    "K02_single_configuration",
    with_pts("SELECT name, region, n_nodes, dhdt_median, dhdt_mad, rmse_median, nobs_median FROM (SELECT config, region, count(*) AS n_nodes, any_value(md) AS dhdt_median, 1.4826E0*median(abs(dhdt-md)) AS dhdt_mad, median(rmse) AS rmse_median, median(nobs) AS nobs_median FROM (SELECT *, median(dhdt) OVER (PARTITION BY config, region) AS md FROM fits) GROUP BY 1,2) JOIN nm USING (config)", tile_nodes_sql(50000, 10000), *grid_sql()),
    floats="dhdt_median dhdt_mad rmse_median nobs_median", digits=5,
)
def k02(spark, sf):
    """Every configuration in every region, from one pass over the points."""
    return experiments.configuration_statistics(grid_fits(spark, sf), ["config", "region"]).join(config_names(spark), "config").drop("config")


def modular_counts(unit, rep):
    """Poisson counts by whole numbers that SQL can follow."""
    return poisson.counts_of((unit[:, None] * 7919 + rep[None, :] * 104729 + unit[:, None] * rep[None, :]) % 10007 / 10007)


COUNT_SQL = "(" + "+".join(f"(((unit*7919+rep*104729+unit*rep)%10007)/10007.0E0>={x!r})::INT" for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()) + ")"
BOOTSTRAP_SQL = [
    "pr AS MATERIALIZED (SELECT t.config, t.region, t.unit, t.dhdt-b.dhdt AS d, t.rmse-b.rmse AS dr FROM fits t JOIN fits b USING (node_x, node_y) WHERE t.config<>0 AND b.config=0)",
    f"wt AS (SELECT config, region, rep, d, k FROM (SELECT *, {COUNT_SQL} AS k FROM pr, (SELECT unnest(range(0,{DRAWS})) AS rep)), LATERAL (SELECT unnest(range(0,k)) AS copy))",
    "ci AS (SELECT config, region, quantile_cont(m,0.025) AS ci_lo, quantile_cont(m,0.975) AS ci_hi, count(*) AS draws FROM (SELECT config, region, rep, median(d) AS m FROM wt GROUP BY 1,2,3) GROUP BY 1,2)",
    "ct AS (SELECT config, region, count(*) AS n_test FROM fits WHERE config<>0 GROUP BY 1,2)", "cb AS (SELECT region, count(*) AS n_base FROM fits WHERE config=0 GROUP BY 1)",
    "sh AS (SELECT config, region, count(*) AS n_common, any_value(md) AS median_shift, 1.4826E0*median(abs(d-md)) AS mad_shift, quantile_cont(abs(d),0.95) AS p95_abs, median(dr) AS residual_shift FROM (SELECT *, median(d) OVER (PARTITION BY config, region) AS md FROM pr) GROUP BY 1,2)",
]


@query(
    "K03_paired_comparison",
    with_pts("SELECT name, region, n_base, n_test, n_common, median_shift, mad_shift, p95_abs, residual_shift, (n_test-n_base)/n_base AS coverage_gain, ci_lo, ci_hi, draws, NOT (ci_lo<=1E-9 AND ci_hi>=-1E-9) AS significant FROM sh JOIN ct USING (config, region) JOIN cb USING (region) JOIN ci USING (config, region) JOIN nm USING (config)", tile_nodes_sql(50000, 10000), *grid_sql(), *BOOTSTRAP_SQL),
    floats="median_shift mad_shift p95_abs residual_shift coverage_gain ci_lo ci_hi", digits=5,
)
def k03(spark, sf):
    """Thirteen changes against the baseline, region by region, with the interval of a Poisson bootstrap."""
    shifts = experiments.paired_shifts(grid_fits(spark, sf), ["region"], keys=["node_x", "node_y"], unit="unit", draws=DRAWS, draw=modular_counts)
    return shifts.join(config_names(spark), "config").drop("config")


SEAS_CMP_SQL = """cm AS (SELECT cell_x, cell_y, a.d AS a, b.d AS b, a.r AS ra, b.r AS rb FROM (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, avg(h) AS d, stddev_samp(h) AS r FROM pts WHERE beam<=4 GROUP BY 1,2) a JOIN (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, avg(h) AS d, stddev_samp(h) AS r FROM pts WHERE beam<=6 GROUP BY 1,2) b USING (cell_x, cell_y)),
 nn AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT floor(x/5000), floor(y/5000) FROM pts WHERE beam<=4)) AS n_base, (SELECT count(*) FROM (SELECT DISTINCT floor(x/5000), floor(y/5000) FROM pts WHERE beam<=6)) AS n_test)"""


def cells_of(p):
    return p.groupBy(spatial.cell("x", 5000).alias("cell_x"), spatial.cell("y", 5000).alias("cell_y")).agg(F.avg("h").alias("dhdt"), F.stddev_samp("h").alias("rmse"))


#: All beams beside those of the lower half of the range.
ALL_CMP_SQL = SEAS_CMP_SQL.replace("beam<=4", "2*beam<=(SELECT min(beam)+max(beam) FROM pts)").replace(" WHERE beam<=6", "")


@query("K04_acceptance", with_pts("SELECT n_base, n_test, n_common, median_shift, mad_shift, p95_abs, residual_shift, (n_test-n_base)/n_base AS coverage_gain, abs(median_shift)<=0.05E0 AS shift_ok, residual_shift<=0.1E0 AS residual_ok, (n_test-n_base)/n_base>=0.02E0 AS coverage_ok, abs(median_shift)<=0.05E0 AND residual_shift<=0.1E0 AND (n_test-n_base)/n_base>=0.02E0 AS accepted FROM nn, (SELECT count(*) AS n_common, median(b-a) AS median_shift, 1.4826E0*(SELECT median(abs(b-a-(SELECT median(b-a) FROM cm))) FROM cm) AS mad_shift, quantile_cont(abs(b-a),0.95) AS p95_abs, median(rb-ra) AS residual_shift FROM cm)", ALL_CMP_SQL), floats="median_shift mad_shift p95_abs residual_shift coverage_gain")
def k04(spark, sf):
    """All beams as the test side, those of the lower half of the range as the baseline."""
    p = points(spark, sf)
    ends = p.agg((F.min("beam") + F.max("beam")).alias("ends"))
    lower = p.crossJoin(F.broadcast(ends)).where(2 * F.col("beam") <= F.col("ends"))
    return experiments.acceptance(experiments.compare_to_baseline(cells_of(lower), cells_of(p), keys=["cell_x", "cell_y"]))


@query("K05_run_record", with_pts("SELECT 'cells' AS stage, count(*) AS n_rows, 'finished' AS status FROM (SELECT DISTINCT floor(x/5000), floor(y/5000) FROM pts)"))
def k05(spark, sf):
    out = node_stats(spark, sf)
    path = scratch(spark, "runs")
    rec = experiments.run_record(spark, uuid.uuid4().hex, "cells", out, inputs={"points": sf}, outputs={}, parameters={"cell": 5000}, n_rows=out.count())
    experiments.append_run(rec, path)
    return spark.read.schema(experiments.RUN_SCHEMA).parquet(path).select("stage", "n_rows", "status")


# ------------------------------------------------------------------ streams
@query("L01_granule_intake", with_pts("SELECT beam::INT AS beam, count(*) AS n FROM pts WHERE -115.0E0+x*2.0E-4 BETWEEN -114.0 AND -98.0 AND -77.5E0+y*4.5E-5 BETWEEN -77.0 AND -73.5 GROUP BY beam"))
def l01(spark, sf):
    """Intake run twice: the second run finds nothing new and adds nothing."""
    src, base = stored_points(spark, sf), scratch(spark, "intake")
    roi = {"lon_min": -114.0, "lon_max": -98.0, "lat_min": -77.0, "lat_max": -73.5}
    for _ in range(2):
        incremental.intake(spark, src, os.path.join(base, "out"), os.path.join(base, "cp"), roi=roi).awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).groupBy(F.col("beam").cast("int").alias("beam")).agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark, sf):
    batch = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = scratch(spark, "events")
    batch.write.parquet(path)
    return spark.readStream.schema(batch.schema).parquet(path)


SESSION_SQL = """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
 SELECT user_id, count(*) AS n, sum(value) AS value_sum, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, k
 HAVING max(ts)+INTERVAL 1 DAY <= (SELECT max(ts) FROM events)-INTERVAL 1 HOUR"""


@query("L02_pass_sessions", SESSION_SQL, floats="value_sum")
def l02(spark, sf):
    """Sessions closed by the watermark; the last open ones wait for later rows."""
    base = scratch(spark, "sessions")
    s = incremental.pass_sessions(event_stream(spark, sf), key="user_id", time="ts", gap="1 day", late="1 hour", value="value")
    out = incremental.run_available(s, os.path.join(base, "out"), os.path.join(base, "cp"))
    return out.select("user_id", "n", "value_sum", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


WINDOW_SQL = """SELECT epoch_us(w) AS start_us, floor(user_id*100.0E0/1000)::BIGINT AS cell_x, floor(value*10/1000)::BIGINT AS cell_y, count(*) AS n
 FROM (SELECT *, make_timestamp((epoch_us(ts)//432000000000)*432000000000) AS w FROM events) WHERE w + INTERVAL 5 DAY <= (SELECT max(ts) FROM events)-INTERVAL 1 HOUR GROUP BY 1,2,3"""


@query("L03_cell_window_counts", WINDOW_SQL)
def l03(spark, sf):
    base = scratch(spark, "counts")
    e = event_stream(spark, sf).withColumn("x", F.col("user_id") * 100.0).withColumn("y", F.col("value") * 10)
    c = incremental.cell_month_counts(e, time="ts", late="1 hour", size=1000.0, window="5 days")
    out = incremental.run_available(c, os.path.join(base, "out"), os.path.join(base, "cp"))
    return out.select(F.unix_micros("start").alias("start_us"), "cell_x", "cell_y", "n")
