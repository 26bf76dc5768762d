"""Queries over group statistics, windows, top-k and set operations (D, E, F, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cryoframe.functions import timecols
from cryoframe.functions.predicates import classify_nodes, grounded_keep
from cryoframe.operators import crossings, interpolate, ranks, robust, spatial, summaries, tracks
from cryoframe.operators.blocks import harmonic_fit, line_fit
from cryoframe.operators.skew import group_median_mad, group_quantiles
from cryoframe.operators.yearblocks import phase_coverage
from cryoframe.plans.base import IDS, points, query, table, with_pts
from cryoframe.plans.q_predicates import CRITERIA_SQL, FLAGS_SQL, NODES_SQL, flags, node_stats
from cryoframe.plans.q_spatial import CENT_SQL, CROSS_SQL, FIELD_SQL, TRACK_SQL, centroids, crossing_sql, crossing_table, field
from cryoframe.plans.q_spatial import tracks as track_points
from cryoframe.session import cut

D01_SQL = """p1 AS (SELECT *, floor(x/5000) AS ix, floor(y/5000) AS iy, floor(t_year) AS it FROM pts),
 m1 AS (SELECT *, median(h) OVER w AS m, count(*) OVER w AS n FROM p1 WINDOW w AS (PARTITION BY ix, iy, it)),
 k1 AS (SELECT * FROM (SELECT *, 1.4826E0*median(abs(h-m)) OVER (PARTITION BY ix,iy,it) AS mad FROM m1) WHERE NOT (n>=20 AND abs(h-m)>5*greatest(mad,0.1E0))),
 p2 AS (SELECT * EXCLUDE (ix,iy,it,m,n,mad), floor((x+2500)/5000) AS ix, floor((y+2500)/5000) AS iy, floor(t_year+0.5E0) AS it FROM k1),
 m2 AS (SELECT *, median(h) OVER w AS m, count(*) OVER w AS n FROM p2 WINDOW w AS (PARTITION BY ix, iy, it)),
 st AS (SELECT * EXCLUDE (ix,iy,it,m,n,mad) FROM (SELECT *, 1.4826E0*median(abs(h-m)) OVER (PARTITION BY ix,iy,it) AS mad FROM m2) WHERE NOT (n>=20 AND abs(h-m)>5*greatest(mad,0.1E0)))"""
D01 = dict(height="h", cell_m=5000.0, dt_years=1.0, n_sigma=5.0, min_count=20, mad_floor=0.1)


@query("D01_space_time_filter", with_pts('SELECT "year", count(*) AS n, max(h) AS h_max, avg(h) AS h_mean FROM st GROUP BY "year"', D01_SQL), floats="h_max h_mean")
def d01(spark, sf):
    kept = robust.filter_space_time(points(spark, sf), **D01)
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h_max"), F.avg("h").alias("h_mean"))


@query("D02_track_direction", with_pts("SELECT track_id, up AS ascending, n_pts FROM dirs", TRACK_SQL, CROSS_SQL))
def d02(spark, sf):
    return tracks.track_direction(track_points(spark, sf), ties=["pa", "pb", "pd"])


def near_in_time(spark, sf, widest):
    """Crossings whose passes lie at most ``widest`` apart, with the columns that biases read."""
    return crossing_table(spark, sf, max_dt=widest).select("beam1", "beam2", "dt", "dh")


@query("D03_interbeam_bias", with_pts("SELECT beam1, beam2, count(*) AS n, any_value(m) AS median_dh, 1.4826E0*median(abs(d-m)) AS mad_dh FROM (SELECT *, median(d) OVER (PARTITION BY beam1, beam2) AS m FROM (SELECT beam1, beam2, dh+0.5E0*dt AS d FROM xo WHERE abs(dt)<=0.5E0)) GROUP BY beam1, beam2", TRACK_SQL, CROSS_SQL), floats="median_dh mad_dh", digits=5)
def d03(spark, sf):
    return robust.interbeam_bias(cut(near_in_time(spark, sf, 0.5)), max_dt=0.5, expected_rate=-0.5)


@query("D04_bias_windows", with_pts("SELECT w AS max_dt, sum(n)::BIGINT AS n_pairs, count(*) AS n_beam_pairs, max(abs(b)) AS max_abs_bias, median(abs(b)) AS median_abs_bias FROM (SELECT w, beam1, beam2, count(*) AS n, median(dh) AS b FROM xo JOIN (VALUES (0.05E0),(0.1E0),(0.25E0),(0.5E0)) v(w) ON abs(dt)<=w GROUP BY ALL) GROUP BY w", TRACK_SQL, CROSS_SQL), floats="max_abs_bias median_abs_bias", digits=5)
def d04(spark, sf):
    return robust.interbeam_bias_windows(cut(near_in_time(spark, sf, 0.5)))


PAIR_SQL = """nr AS (SELECT cx AS nx, cy AS ny, v*10-1.0E0 AS r, 0.02E0+v/10 AS e FROM cen),
 mt AS (SELECT * FROM (SELECT xo.*, r AS local_dhdt, e AS local_dhdt_err, row_number() OVER (PARTITION BY track1, track2, xo.x, xo.y ORDER BY (xo.x-nx)*(xo.x-nx)+(xo.y-ny)*(xo.y-ny), nx, ny) AS k FROM xo JOIN nr ON (xo.x-nx)*(xo.x-nx)+(xo.y-ny)*(xo.y-ny)<=25000000 WHERE dhdt IS NOT NULL) WHERE k=1),
 pr AS (SELECT *, dhdt-local_dhdt AS diff, sqrt(dhdt_err*dhdt_err+local_dhdt_err*local_dhdt_err) AS sc, (dhdt-local_dhdt)/sqrt(dhdt_err*dhdt_err+local_dhdt_err*local_dhdt_err) AS z FROM mt)"""


def agreement_pairs(spark, sf, *columns):
    """``columns`` of the crossings beside their nearest nodes. Written once, as several statistics read them; crossings grow with the
    square of the tracks, so nothing else of them is written or moved."""
    n = centroids(spark, sf).select(F.col("cx").alias("node_x"), F.col("cy").alias("node_y"), (F.col("v") * 10 - 1.0).alias("dhdt"), (F.col("v") / 10 + 0.02).alias("dhdt_err"))
    x = crossing_table(spark, sf, once=True).where(F.col("dhdt").isNotNull()).select("track1", "track2", "x", "y", "dhdt", "dhdt_err")
    return cut(crossings.match_to_nodes(x, n, 5000.0, ids=["track1", "track2", "x", "y"], base=2500.0, distinct=True).select(*columns))


@query("D05_hotspots", with_pts("SELECT cell_x, cell_y, n, x, y, md AS median_diff, mad AS mad_diff, mz AS median_z, abs(mz)>=2 AS hotspot FROM (SELECT cell_x, cell_y, count(*) AS n, avg(x) AS x, avg(y) AS y, any_value(md) AS md, median(z) AS mz, 1.4826E0*median(abs(diff-md)) AS mad FROM (SELECT *, floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, median(diff) OVER (PARTITION BY floor(x/5000), floor(y/5000)) AS md FROM pr) GROUP BY 1,2 HAVING count(*)>=10)", TRACK_SQL, CROSS_SQL, CENT_SQL, PAIR_SQL), floats="x y median_diff mad_diff median_z", digits=4)
def d05(spark, sf):
    return robust.hotspots(agreement_pairs(spark, sf, "x", "y", "diff", "z"), size_m=5000.0)


@query("D06_agreement_summary", with_pts("SELECT count(diff) AS n_matched, sqrt(avg(diff*diff)) AS rmse_diff, avg((abs(z)<=2)::INT) AS frac_within_2sigma, median(dhdt) AS median_xover, median(local_dhdt) AS median_local, median(diff) AS median_diff, 1.4826E0*(SELECT median(abs(diff-(SELECT median(diff) FROM pr))) FROM pr) AS mad_diff, median(abs(z)) AS median_abs_z FROM pr", TRACK_SQL, CROSS_SQL, CENT_SQL, PAIR_SQL), floats="rmse_diff frac_within_2sigma median_xover median_local median_diff mad_diff median_abs_z", digits=4)
def d06(spark, sf):
    return crossings.agreement_summary(agreement_pairs(spark, sf, "dhdt", "local_dhdt", "diff", "z"))


@query("D07_basal_cells", with_pts("SELECT cell_x, cell_y, count(*) AS n, median(disc) AS melt, median(tax) AS sigma, count(DISTINCT \"year\") AS n_windows, (cell_x+0.5E0)*5000 AS x_center FROM (SELECT *, floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y FROM pts WHERE mask_class=3 AND rflag<>'R') GROUP BY 1,2"), floats="melt sigma")
def d07(spark, sf):
    p = points(spark, sf).where((F.col("mask_class") == 3) & (F.col("rflag") != "R"))
    m = robust.cell_medians(p, "disc", size_m=5000.0, out="melt").drop("y_center")
    s = robust.cell_medians(p, "tax", size_m=5000.0, out="sigma").select("cell_x", "cell_y", "sigma")
    w = p.groupBy(spatial.cell("x", 5000).alias("cell_x"), spatial.cell("y", 5000).alias("cell_y")).agg(F.count_distinct("year").alias("n_windows"))
    return m.join(s, ["cell_x", "cell_y"]).join(w, ["cell_x", "cell_y"]).withColumnRenamed("x_center", "x_center")


@query("D10_parcel_medians", with_pts("SELECT pb AS parcel, count(*) AS n, median(disc) AS med FROM pts WHERE disc<0.09E0 GROUP BY pb"), floats="med")
def d10(spark, sf):
    return group_quantiles(points(spark, sf).where(F.col("disc") < 0.09).withColumn("parcel", F.col("pb")), ["parcel"], "disc", {"med": 0.5})


@query(
    "D11_variogram",
    with_pts("SELECT lag, count(*) AS n_pairs, avg(0.5E0*(va-vb)*(va-vb)) AS gamma, (lag+0.5E0)*2000 AS center FROM (SELECT a.v AS va, b.v AS vb, floor(sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy))/2000)::INT AS lag FROM cen a JOIN cen b ON (a.ci,a.cj)<(b.ci,b.cj) AND sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy))<30000) GROUP BY lag", CENT_SQL),
    floats="gamma", digits=9,
)
def d11(spark, sf):
    return interpolate.empirical_variogram(centroids(spark, sf), "v", ids=["ci", "cj"], max_lag=30000.0, n_lags=15, max_points=None, x="cx", y="cy")


RES_SQL = "rs AS (SELECT beam, h-500.0E0+0.5E0*(\"year\"-1998) AS r, s_elv*s_elv*400 AS v, disc FROM pts)"


def residual_rows(spark, sf):
    return points(spark, sf).select("beam", (F.col("h") - 500.0 + 0.5 * (F.col("year") - 1998)).alias("resid"), (F.col("s_elv") * F.col("s_elv") * 400).alias("var"), "disc")


@query("D12_fold_metrics", with_pts("SELECT beam, count(*) AS n, sqrt(avg(r*r)) AS rmse, avg(abs(r)) AS mae, avg(r) AS bias, avg((abs(r)/sqrt(v)<=1)::INT) AS coverage_68, avg((abs(r)/sqrt(v)<=1.96E0)::INT) AS coverage_95, stddev_pop(r/sqrt(v)) AS z_std, any_value(m) AS median, 1.4826E0*median(abs(r-m)) AS mad FROM (SELECT *, median(r) OVER (PARTITION BY beam) AS m FROM rs) GROUP BY beam", RES_SQL), floats="rmse mae bias coverage_68 coverage_95 z_std median mad")
def d12(spark, sf):
    r = residual_rows(spark, sf)
    return interpolate.prediction_metrics(r, ["beam"]).join(group_median_mad(r, ["beam"], "resid", med="median", mad="mad").drop("n"), "beam")


@query("D13_method_summary", with_pts("SELECT 'block' AS strategy, CASE WHEN beam%2=0 THEN 'even' ELSE 'odd' END AS method, count(*) AS n_folds, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(bias) AS bias_mean, abs(avg(c68)-0.6827E0) AS coverage_gap, abs(avg(zs)-1) AS z_gap FROM (SELECT beam, sqrt(avg(r*r)) AS rmse, avg(r) AS bias, avg((abs(r)/sqrt(v)<=1)::INT) AS c68, stddev_pop(r/sqrt(v)) AS zs FROM rs GROUP BY beam) GROUP BY 2", RES_SQL), floats="rmse_mean rmse_std bias_mean coverage_gap z_gap")
def d13(spark, sf):
    m = interpolate.prediction_metrics(residual_rows(spark, sf), ["beam"]).withColumn("strategy", F.lit("block")).withColumn("method", F.when(F.col("beam") % 2 == 0, "even").otherwise("odd"))
    return interpolate.summarise_methods(m)


@query("D14_reliability_report", with_pts("SELECT c AS reliability, count(dhdt) AS n, 100.0E0*nullif(count(dhdt),0)/(SELECT count(*) FROM nd) AS pct, median(dhdt) AS dhdt_median, avg(dhdt) AS dhdt_mean, median(nobs) AS nobs_median, median(rmse) AS rmse_median, median(dhdt_err) AS sigma_median, median(snr) AS snr_median, 100.0E0*avg((dhdt<0)::INT) AS thinning_pct FROM (VALUES ('reliable'),('acceptable'),('unreliable'),('absent')) v(c) LEFT JOIN cl ON cl.reliability=c GROUP BY c", NODES_SQL, CRITERIA_SQL), floats="pct dhdt_median dhdt_mean nobs_median rmse_median sigma_median snr_median thinning_pct")
def d14(spark, sf):
    return summaries.class_report(classify_nodes(node_stats(spark, sf)), ["reliable", "acceptable", "unreliable", "absent"])


@query("D15_flag_profile", with_pts("SELECT 'atl06_quality_summary' AS flag, q::BIGINT AS value, count(*) AS n, NULL::DOUBLE AS p05, NULL::DOUBLE AS p99 FROM fl GROUP BY q UNION ALL SELECT 'msw_flag', msw::BIGINT, count(*), NULL, NULL FROM fl GROUP BY msw UNION ALL SELECT 'h_robust_sprd', NULL, count(spread), quantile_cont(spread,0.05), quantile_cont(spread,0.99) FROM fl UNION ALL SELECT 'dem_h', NULL, count(dem), quantile_cont(dem,0.05), quantile_cont(dem,0.99) FROM fl", FLAGS_SQL), floats="p05 p99")
def d15(spark, sf):
    c, q = summaries.flag_profile(flags(spark, sf), ["atl06_quality_summary", "msw_flag"], ["h_robust_sprd", "dem_h"])
    return c.unionByName(q.select("flag", "n", "p05", "p99"), allowMissingColumns=True)


@query("D20_overpass_leverage", with_pts("SELECT pc, count(*) AS n_passes, sum(c*c)-count(*)*avg(c)*avg(c) AS leverage FROM (SELECT pc, ps, avg(t_year)-1998 AS c FROM (SELECT pc, t_year, sum(nw) OVER (PARTITION BY pc ORDER BY t_year, pa, pb, pd) AS ps FROM (SELECT *, CASE WHEN lag(t_year) OVER (PARTITION BY pc ORDER BY t_year, pa, pb, pd) IS NULL OR t_year-lag(t_year) OVER (PARTITION BY pc ORDER BY t_year, pa, pb, pd) > 0.0050E0 THEN 1 ELSE 0 END AS nw FROM pts)) GROUP BY pc, ps) GROUP BY pc"), floats="leverage", digits=4)
def d20(spark, sf):
    return tracks.overpass_leverage(points(spark, sf), keys=["pc"], tolerance=0.0050)


@query("D23_audit_cube", with_pts('SELECT CASE WHEN g=0 THEN floor(x/50000)::BIGINT END AS cell_x, CASE WHEN g=0 THEN floor(y/50000)::BIGINT END AS cell_y, "year", CASE WHEN g<2 THEN mask_class END AS state, CASE WHEN g=2 THEN beam END AS support, count(*) AS n FROM pts, (VALUES (0),(1),(2)) v(g) GROUP BY ALL'))
def d23(spark, sf):
    return summaries.audit_cube(points(spark, sf).withColumn("state", F.col("mask_class")).withColumn("support", F.col("beam")))


BOOT_SQL = "bo AS (SELECT (row_number() OVER (ORDER BY ci, cj)-1) AS i, v FROM cen)"


@query("D24_bootstrap_median", with_pts("SELECT quantile_cont(m,0.025) AS ci_lo, quantile_cont(m,0.975) AS ci_hi, count(*) AS draws FROM (SELECT rep, median(v) AS m FROM (SELECT rep, (rep*7919+s.i*104729+rep*s.i)%(SELECT count(*) FROM bo) AS k FROM bo s, (SELECT unnest(range(0,100)) AS rep)) JOIN bo ON bo.i=k GROUP BY rep)", CENT_SQL, BOOT_SQL), floats="ci_lo ci_hi")
def d24(spark, sf):
    c = centroids(spark, sf)
    pos = ranks.value_positions(c.withColumn("key", F.col("ci") * 1000000 + F.col("cj")), "key").select("key", F.col("below").alias("i"))
    numbered = c.withColumn("key", F.col("ci") * 1000000 + F.col("cj")).join(pos, "key")
    pick = F.pmod(F.col("rep") * 7919 + F.col("slot") * 104729 + F.col("rep") * F.col("slot"), F.col("_n"))
    return summaries.bootstrap_median(numbered, "v", draws=100, index="i", pick=pick)


@query("D25_representative_regions", with_pts("SELECT * FROM (SELECT cell_x, cell_y, n, floating, 'floating' AS kind FROM g WHERE floating>0.2E0 ORDER BY n DESC, cell_x, cell_y LIMIT 3) UNION ALL SELECT * FROM (SELECT cell_x, cell_y, n, floating, 'grounded' FROM g WHERE floating<=0.2E0 ORDER BY n DESC, cell_x, cell_y LIMIT 3)", "g AS (SELECT floor(x/10000)::BIGINT AS cell_x, floor(y/10000)::BIGINT AS cell_y, count(*) AS n, avg((mask_class=3)::INT) AS floating FROM pts GROUP BY 1,2 HAVING count(*)>=100)"), floats="floating")
def d25(spark, sf):
    return summaries.representative_regions(points(spark, sf), size=10000.0, min_rows=100)


@query("D26_rejection_reasons", with_pts("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN disc>0.08E0 THEN 'noisy' WHEN tax>0.06E0 THEN 'taxed' WHEN qty<5 THEN 'thin '||qty::INT ELSE 'kept' END AS reason FROM pts) GROUP BY reason ORDER BY n DESC, reason LIMIT 6"))
def d26(spark, sf):
    r = F.when(F.col("disc") > 0.08, "noisy").when(F.col("tax") > 0.06, "taxed").when(F.col("qty") < 5, F.concat(F.lit("thin "), F.col("qty").cast("int"))).otherwise("kept")
    return summaries.reasons_top(points(spark, sf).withColumn("reason", r), "reason")


@query("D27_latitude_profile", with_pts('SELECT "year", lat_box, count(*) AS n, median(h-500.0E0) AS anomaly FROM (SELECT *, round_even((-77.5E0+y*4.5E-5)/0.05E0,0)::BIGINT AS lat_box FROM pts) GROUP BY 1,2 HAVING count(*)>=5'), floats="anomaly")
def d27(spark, sf):
    p = points(spark, sf).withColumn("lat_box", F.rint((F.lit(-77.5) + F.col("y") * 4.5e-5) / 0.05).cast("bigint")).withColumn("a", F.col("h") - 500.0)
    return group_quantiles(p, ["year", "lat_box"], "a", {"anomaly": 0.5}).where(F.col("n") >= 5)


@query("D28_cell_year_medians", with_pts('SELECT floor(x/2000)::BIGINT AS cell_x, floor(y/2000)::BIGINT AS cell_y, "year", count(*) AS n, median(h) AS h_med, median(CASE WHEN beam IN (1,3,5) THEN h END) AS h_strong FROM pts GROUP BY 1,2,3 HAVING count(*)>=5'), floats="h_med h_strong")
def d28(spark, sf):
    p = points(spark, sf).withColumn("cell_x", spatial.cell("x", 2000)).withColumn("cell_y", spatial.cell("y", 2000)).withColumn("hs", F.when(F.col("beam").isin(1, 3, 5), F.col("h")))
    k = ["cell_x", "cell_y", "year"]
    return group_quantiles(p, k, "h", {"h_med": 0.5}).where(F.col("n") >= 5).join(group_quantiles(p, k, "hs", {"h_strong": 0.5}).drop("n"), k)


@query("D29_corridor_profile", with_pts('SELECT "year", box, count(*) AS n, median(h) AS h_med FROM (SELECT *, round_even(x/1000,0)::BIGINT AS box FROM pts WHERE y BETWEEN 40000 AND 60000) GROUP BY 1,2 HAVING count(*)>=8'), floats="h_med")
def d29(spark, sf):
    p = points(spark, sf).where(F.col("y").between(40000, 60000)).withColumn("box", F.rint(F.col("x") / 1000).cast("bigint"))
    return group_quantiles(p, ["year", "box"], "h", {"h_med": 0.5}).where(F.col("n") >= 8)


@query("D30_density_histogram", with_pts("SELECT h.*, s.* FROM (SELECT bin, n, n/(sum(n) OVER ()*0.1E0) AS density, -4.0E0+bin*0.1E0 AS left_edge FROM (SELECT floor((v+4.0E0)/0.1E0)::INT AS bin, count(*) AS n FROM q WHERE v>=-4 AND v<2.5E0 GROUP BY 1)) h, (SELECT avg(v) AS mean, avg(pow(v-m,3))/pow(avg(pow(v-m,2)),1.5E0) AS skewness, 100.0E0*avg((v<0)::INT) AS thinning_pct, median(v) AS median FROM q, (SELECT avg(v) AS m FROM q)) s", "q AS (SELECT h-500.0E0+qty*0.013E0 AS v FROM pts)"), floats="density left_edge mean skewness thinning_pct median")
def d30(spark, sf):
    p = points(spark, sf).select((F.col("h") - 500.0 + F.col("qty") * 0.013).alias("v"))
    return summaries.density_histogram(p, "v", -4.0, 2.5, 0.1).crossJoin(F.broadcast(summaries.shape(p, "v")))


@query("D31_retention", with_pts('SELECT "year", count(*) AS n_before, count(*) FILTER (mask_class=2 AND x>=5000 AND y>=2000) AS n_kept, count(*) FILTER (mask_class=2 AND x>=5000 AND y>=2000)/count(*) AS fraction FROM pts GROUP BY "year"'), floats="fraction")
def d31(spark, sf):
    return summaries.retention(points(spark, sf), grounded_keep(F.col("mask_class"), F.col("x"), F.col("y"), 5000.0, 2000.0), ["year"])


@query("D32_log_speed_bins", with_pts("SELECT bin, count(*) AS n, quantile_cont(disc,0.25) AS p25, median(disc) AS p50, quantile_cont(disc,0.75) AS p75 FROM (SELECT disc, floor(ln((qty+0.37E0)/1.0E0)/ln(60.0E0)*15)::INT AS bin FROM pts) GROUP BY bin HAVING count(*)>=20"), floats="p25 p50 p75")
def d32(spark, sf):
    return summaries.log_bins(points(spark, sf).withColumn("v", F.col("qty") + 0.37), "v", "disc", 1.0, 60.0)


HARM_SQL = """ev AS (SELECT event_type AS k, value AS y, epoch(ts-TIMESTAMP '2024-01-01')/3600 AS hr FROM events),
 sc AS (SELECT k, p AS period_h, y, sin(2*pi()/p*hr) AS s, cos(2*pi()/p*hr) AS c FROM ev, (VALUES (12.0E0),(12.4206E0),(23.9345E0),(25.8193E0)) v(p)),
 mo AS (SELECT k, period_h, count(*) AS n, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s,c) AS sc, covar_pop(s,y) AS sy, covar_pop(c,y) AS cy, var_pop(y) AS yy FROM sc GROUP BY 1,2)"""


@query("D34_harmonics", f"WITH {HARM_SQL} SELECT k, period_h, n, sqrt(pow((sy*cc-cy*sc)/(ss*cc-sc*sc),2)+pow((cy*ss-sy*sc)/(ss*cc-sc*sc),2)) AS amplitude, ((sy*cc-cy*sc)*sy+(cy*ss-sy*sc)*cy)/(ss*cc-sc*sc)/yy AS r2 FROM mo", floats="amplitude r2")
def d34(spark, sf):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3.6e9
    e = table(spark, sf, "events").select(F.col("event_type").alias("k"), F.col("value").alias("y"), hours.alias("hr"))
    return harmonic_fit(e, ["k"], "y", "hr")


@query("D35_forcing_summary", "SELECT 'value' AS variable, count(*) AS n, quantile_cont(value,0.1) AS p10, median(value) AS p50, quantile_cont(value,0.9) AS p90 FROM events UNION ALL SELECT 'user_id', count(*), quantile_cont(user_id::DOUBLE,0.1), median(user_id::DOUBLE), quantile_cont(user_id::DOUBLE,0.9) FROM events UNION ALL SELECT 'step_s', count(*), quantile_cont(s,0.1), median(s), quantile_cont(s,0.9) FROM (SELECT epoch(ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events) WHERE s IS NOT NULL UNION ALL SELECT 'spearman', count(*), NULL, corr(ra, rb), NULL FROM (SELECT (rank() OVER (ORDER BY value)+count(*) OVER (PARTITION BY value)/2.0E0) AS ra, (rank() OVER (ORDER BY user_id)+count(*) OVER (PARTITION BY user_id)/2.0E0) AS rb FROM events)", floats="p10 p50 p90")
def d35(spark, sf):
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = e.withColumn("step_s", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6)
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    q = summaries.quantile_table(step, ["value", "user_id", "step_s"], probs)
    s = ranks.spearman(e, "value", "user_id").select(F.lit("spearman").alias("variable"), "n", F.col("spearman_r").alias("p50"))
    return q.unionByName(s, allowMissingColumns=True)


@query("D36_cell_rate", with_pts('SELECT cell_x, cell_y, count(h_y) AS n_epochs, regr_slope(h_y,"year") AS slope, regr_r2(h_y,"year") AS r2 FROM (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, "year", avg(h) AS h_y FROM pts GROUP BY 1,2,3) GROUP BY 1,2 HAVING count(*)>=4'), floats="slope r2")
def d36(spark, sf):
    return line_fit(yearly_cells(spark, sf), ["cell_x", "cell_y"], "h_y", "year").select("cell_x", "cell_y", "n_epochs", "slope", "r2")


def yearly_cells(spark, sf, size=5000):
    return points(spark, sf).groupBy(spatial.cell("x", size).alias("cell_x"), spatial.cell("y", size).alias("cell_y"), "year").agg(F.avg("h").alias("h_y"))


@query("D37_cell_mean_rate", with_pts('SELECT cell_x, cell_y, avg(h_y) AS mean, count(*) AS n_epochs FROM (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, "year", avg(h) AS h_y FROM pts GROUP BY 1,2,3) WHERE "year">=1996 GROUP BY 1,2 HAVING count(*)>=4'), floats="mean")
def d37(spark, sf):
    y = yearly_cells(spark, sf).where(F.col("year") >= 1996)
    return y.groupBy("cell_x", "cell_y").agg(F.avg("h_y").alias("mean"), F.count("h_y").alias("n_epochs")).where(F.col("n_epochs") >= 4)


@query("D38_velocity_trend", with_pts('SELECT cell_x, cell_y, n, slope, CASE WHEN med>=10 THEN 100*slope/med END AS percent, r2 FROM (SELECT cell_x, cell_y, count(*) AS n, regr_slope(v,"year") AS slope, median(v) AS med, regr_r2(v,"year") AS r2 FROM (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, "year", avg(qty)*2 AS v FROM pts GROUP BY 1,2,3) GROUP BY 1,2 HAVING count(*)>=5)'), floats="slope percent r2")
def d38(spark, sf):
    y = points(spark, sf).groupBy(spatial.cell("x", 5000).alias("cell_x"), spatial.cell("y", 5000).alias("cell_y"), "year").agg((F.avg("qty") * 2).alias("v"))
    # A cell's series has one row per year.
    g = y.groupBy("cell_x", "cell_y").agg(F.count("v").alias("n"), F.regr_slope("v", "year").alias("slope"), F.median("v").alias("med"), F.regr_r2("v", "year").alias("r2"))
    return g.where(F.col("n") >= 5).withColumn("percent", F.when(F.col("med") >= 10, 100 * F.col("slope") / F.col("med"))).drop("med")


@query("D40_window_slope_test", with_pts("SELECT count(*) AS n_cells, median(d) AS med, quantile_cont(d,0.1) AS p10, quantile_cont(d,0.9) AS p90, avg((d>0)::INT) AS frac_pos FROM (SELECT floor(x/10000) AS ci, floor(y/10000) AS cj, regr_slope(h, t_year) FILTER (\"month\" IN (6,7,8)) - regr_slope(h, t_year) AS d FROM pts GROUP BY 1,2 HAVING count(*) FILTER (\"month\" IN (6,7,8))>=8)"), floats="med p10 p90 frac_pos")
def d40(spark, sf):
    winter = F.col("month").isin(6, 7, 8)
    g = points(spark, sf).groupBy(spatial.cell("x", 10000).alias("ci"), spatial.cell("y", 10000).alias("cj")).agg(
        (F.regr_slope(F.when(winter, F.col("h")), F.when(winter, F.col("t_year"))) - F.regr_slope("h", "t_year")).alias("d"), F.count_if(winter).alias("nw"))
    d = g.where(F.col("nw") >= 8)
    return group_quantiles(d, [], "d", {"med": 0.5, "p10": 0.1, "p90": 0.9}).withColumnRenamed("n", "n_cells").crossJoin(F.broadcast(d.agg(F.avg((F.col("d") > 0).cast("double")).alias("frac_pos"))))


@query("D41_external_trend", with_pts("""SELECT count(*) AS n, avg(a-b) AS bias, sqrt(avg((a-b)*(a-b))) AS rms, corr(a,b) AS r, regr_slope(a,b) AS slope, regr_intercept(a,b) AS intercept FROM (SELECT cell_x, cell_y, regr_slope(h_y,"year") AS a, regr_slope(g_y,"year") AS b FROM (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, "year", avg(h) AS h_y, avg(CASE WHEN t_year-"year" BETWEEN 0.4E0 AND 0.7E0 THEN h END) AS g_y FROM pts GROUP BY 1,2,3) GROUP BY 1,2 HAVING count(g_y)>=4)"""), floats="bias rms r slope intercept", digits=5)
def d41(spark, sf):
    frac = F.col("t_year") - F.col("year")
    y = points(spark, sf).groupBy(spatial.cell("x", 5000).alias("cell_x"), spatial.cell("y", 5000).alias("cell_y"), "year").agg(
        F.avg("h").alias("h_y"), F.avg(F.when(frac.between(0.4, 0.7), F.col("h"))).alias("g_y"))
    a = line_fit(y, ["cell_x", "cell_y"], "h_y", "year").select("cell_x", "cell_y", F.col("slope").alias("a"))
    j = a.join(line_fit(y, ["cell_x", "cell_y"], "g_y", "year").select("cell_x", "cell_y", F.col("slope").alias("b")), ["cell_x", "cell_y"])
    d = F.col("a") - F.col("b")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rms"), F.corr("a", "b").alias("r"),
                 F.regr_slope("a", "b").alias("slope"), F.regr_intercept("a", "b").alias("intercept"))


@query("D42_flexure_width", with_pts("SELECT mask_class AS glacier, count(*) AS n, median(d) AS p50, quantile_cont(d,0.9) AS p90, quantile_cont(d,0.95) AS p95 FROM (SELECT a.mask_class, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM pts a JOIN pts b ON a.mask_class=b.mask_class AND a.beam<>b.beam AND abs(a.x-b.x)<=3000 AND abs(a.y-b.y)<=3000 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=9000000 GROUP BY a.mask_class, a.pa, a.pb, a.pc, a.pd) GROUP BY 1"), floats="p50 p90 p95", digits=4)
def d42(spark, sf):
    """Every beam against all others."""
    p = points(spark, sf).select(*IDS, "x", "y", "beam", F.col("mask_class").alias("glacier"))
    src = p.select("glacier", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("beam").alias("s_beam"))
    near = spatial.nearest_join(p, src, target_id=IDS, source_id=[], by=["glacier"], unlike=("beam", "s_beam"), base=1000.0, max_distance=3000.0)
    return group_quantiles(cut(near.select("glacier", "dist")), ["glacier"], "dist", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


@query("D43_sampling_check", with_pts('SELECT corr(t, k) AS r_time_sampling, count(*) AS n_months, avg(k) AS mean_surfaces FROM (SELECT "year", "month", min(t_year) AS t, count(*)::DOUBLE AS k FROM pts GROUP BY 1,2)'), floats="r_time_sampling mean_surfaces")
def d43(spark, sf):
    from cryoframe.operators.trend import sampling_check

    m = points(spark, sf).groupBy("year", "month").agg(F.min("t_year").alias("t_year"), F.count(F.lit(1)).cast("double").alias("n_refsurfs"))
    return sampling_check(m)


@query("D44_coverage_report", with_pts('SELECT "year", NULL::INT AS beam, count(*) AS n, count(DISTINCT pc) AS n_tracks, false AS missing FROM pts GROUP BY "year" UNION ALL SELECT "year", beam, count(*), count(DISTINCT pc), false FROM pts GROUP BY "year", beam UNION ALL SELECT y::INT, NULL, 0, 0, true FROM (SELECT unnest(range(1990, 2006)) AS y) WHERE y NOT IN (SELECT "year" FROM pts)'))
def d44(spark, sf):
    p = points(spark, sf)
    c = summaries.coverage_counts(p, "year", "beam", "pc").withColumn("missing", F.lit(False))
    gaps = summaries.years_without(p, "year", 1990, 2005).select("year", F.lit(None).cast("int").alias("beam"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_tracks"), F.lit(True).alias("missing"))
    return c.unionByName(gaps)


@query("D45_displacement_summary", with_pts("SELECT count(*) AS n, median(d) AS p50, quantile_cont(d,0.9) AS p90, max(d) AS far FROM (SELECT sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2))/1000 AS d FROM pts GROUP BY granule)"), floats="p50 p90 far")
def d45(spark, sf):
    g = points(spark, sf).groupBy("granule").agg((F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 1000).alias("d"))
    return group_quantiles(g, [], "d", {"p50": 0.5, "p90": 0.9, "far": 1.0})


@query("D46_multi_level", with_pts("SELECT g AS level, CASE WHEN g IN (1,3) THEN \"year\"::VARCHAR ELSE '*' END AS \"window\", CASE WHEN g>=2 THEN rflag ELSE '*' END AS shelf, count(*) AS n, avg(disc) AS mean, median(disc) AS median, quantile_cont(disc,0.1) AS p10, quantile_cont(disc,0.9) AS p90, median(tax) AS tax_median FROM pts, (VALUES (0),(1),(2),(3)) v(g) GROUP BY 1,2,3"), floats="mean median p10 p90 tax_median")
def d46(spark, sf):
    p = points(spark, sf).select(F.col("year").alias("window"), F.col("rflag").alias("shelf"), "disc", "tax")
    return summaries.multi_level(p, [[], ["window"], ["shelf"], ["window", "shelf"]], "disc", terms=["tax"])


@query("D48_phase_coverage", with_pts("SELECT pc, count(*) AS n, count(DISTINCT floor(t_year)) AS n_years, 1-sqrt(pow(avg(cos(2*pi()*t_year)),2)+pow(avg(sin(2*pi()*t_year)),2)) AS phase_coverage FROM pts GROUP BY pc"), floats="phase_coverage")
def d48(spark, sf):
    return phase_coverage(points(spark, sf), ["pc"])


@query("D49_cell_fraction", with_pts("SELECT floor(ci/10)::BIGINT AS cell_i, floor(cj/10)::BIGINT AS cell_j, avg(f) AS fraction FROM (SELECT floor(x/500)::BIGINT AS ci, floor(y/500)::BIGINT AS cj, max((mask_class=3)::INT) AS f FROM pts GROUP BY 1,2) GROUP BY 1,2"), floats="fraction")
def d49(spark, sf):
    fine = points(spark, sf).groupBy(spatial.cell("x", 500).alias("ci"), spatial.cell("y", 500).alias("cj")).agg(F.max((F.col("mask_class") == 3).cast("double")).alias("f"))
    return fine.groupBy(F.floor(F.col("ci") / 10).alias("cell_i"), F.floor(F.col("cj") / 10).alias("cell_j")).agg(F.avg("f").alias("fraction"))


SP_SQL = "sp AS (SELECT cx, cy, v, w, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0E0 AS ra, rank() OVER (ORDER BY w)+(count(*) OVER (PARTITION BY w)-1)/2.0E0 AS rb FROM (SELECT avg(x) AS cx, avg(y) AS cy, round(avg(disc),3) AS v, round(avg(tax),3) AS w FROM pts GROUP BY floor(x/5000), floor(y/5000)))"


@query("D50_spatial_correlation", with_pts("SELECT count(*) AS n, corr(ra,rb) AS spearman_r, greatest(least((max(cx)-min(cx))*(max(cy)-min(cy))/(pi()*1E4*1E4), count(*)), 2.0E0) AS n_effective FROM sp", SP_SQL), floats="spearman_r n_effective")
def d50(spark, sf):
    c = points(spark, sf).groupBy(spatial.cell("x", 5000), spatial.cell("y", 5000)).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.round(F.avg("disc"), 3).alias("v"), F.round(F.avg("tax"), 3).alias("w"))
    return ranks.spatial_correlation(c, "v", "w", correlation_length=10000.0, x="cx", y="cy").select("n", "spearman_r", "n_effective")


@query("D51_dynamics_summary", with_pts("SELECT joint_class, count(*) AS n, (SELECT count(*) FROM jq WHERE joint_class='stable_fast') AS n_precursor FROM jq GROUP BY joint_class", NODES_SQL, "jq AS (SELECT CASE WHEN dhdt_err>0 AND abs(dhdt)<=1.96E0*dhdt_err AND n_pixels>=5 AND speed>=100 THEN 'stable_fast' WHEN dhdt_err>0 AND abs(dhdt)<=1.96E0*dhdt_err AND n_pixels>=5 THEN 'stable_slow' WHEN dhdt_err>0 AND dhdt+1.96E0*dhdt_err<0 AND n_pixels>=5 AND speed>=100 THEN 'thinning_fast' WHEN dhdt_err>0 AND dhdt+1.96E0*dhdt_err<0 AND n_pixels>=5 THEN 'thinning_slow' ELSE 'inconclusive' END AS joint_class FROM nd)"))
def d51(spark, sf):
    from cryoframe.functions.predicates import joint_class

    c = node_stats(spark, sf).groupBy(joint_class()["joint_class"].alias("joint_class")).agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.coalesce(F.sum(F.when(F.col("joint_class") == "stable_fast", F.col("n"))), F.lit(0)).alias("n_precursor"))))


STEPS, STARTS = (5, 10, 20), (0, 1, 2)
D52_SQL = with_pts(
    " UNION ALL ".join(
        f"SELECT {sub} AS subsample, {start} AS seed, n_xovers, n_valid, m.median AS median, 1.4826E0*(SELECT median(abs(dhdt-m.median)) FROM xo_{sub}_{start}) AS mad "
        f"FROM (SELECT count(*) AS n_xovers, count(dhdt) AS n_valid, median(dhdt) AS median FROM xo_{sub}_{start}) m"
        for sub in STEPS for start in STARTS
    ),
    TRACK_SQL,
    *[crossing_sql(sub, start) for sub in STEPS for start in STARTS],
)


@query("D52_track_sensitivity", D52_SQL, floats="median mad", digits=4)
def d52(spark, sf):
    """Crossings of all tracks for each step of the vertices and each first vertex, found in one pass over the tracks."""
    settings = [(step, first) for step in STEPS for first in STARTS]
    x = cut(crossing_table(spark, sf, settings=settings).select("setting", "dhdt"))
    n = x.groupBy("setting").agg(F.count(F.lit(1)).alias("n_xovers"), F.count("dhdt").alias("n_valid"))
    s = group_median_mad(x.where("dhdt is not null"), ["setting"], "dhdt", med="median", mad="mad").drop("n")
    names = spark.createDataFrame([(k, *s) for k, s in enumerate(settings)], "setting int, subsample int, seed int")
    found = names.join(n, "setting", "left").join(s, "setting", "left")  # one row a setting
    return found.select("n_xovers", "n_valid", "median", "mad", "subsample", "seed").fillna(0, ["n_xovers", "n_valid"])


# ------------------------------------------------------------------ ordered windows
EV_SQL = """tk AS (SELECT *, sum(nw) OVER (ORDER BY user_id, ts, event_id)-1 AS track_id FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts)/86400-epoch(lag(ts) OVER w)/86400 > 1.0E0 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def passes(spark, sf, gap=1.0):
    """Passes over ``events``: the user is the beam, time in days; slices of two days."""
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("beam"), day.alias("day"), "value")
    return tracks.track_ids(e, gap, time="day", ties=["event_id"], slice_width=2.0)


@query("E01_track_sessions", f"WITH {EV_SQL} SELECT track_id::BIGINT AS track_id, user_id AS beam, count(*) AS n, sum(value) AS v FROM tk GROUP BY 1,2", floats="v")
def e01(spark, sf):
    return passes(spark, sf).groupBy("track_id", "beam").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


ROLL_SQL = EV_SQL + """, rl AS (SELECT *, value-median(value) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS resid, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY track_id) AS m FROM tk),
 rm AS (SELECT *, greatest(1.4826E0*median(abs(resid)) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS BETWEEN 52 PRECEDING AND 52 FOLLOWING), 0.1E0) AS mad, rn>10 AND m-rn>=10 AS interior FROM rl)"""


def rolled(spark, sf):
    return tracks.along_track_flags(passes(spark, sf), height="value", n_sigma=2.0, chunk_rows=40)


@query("E02_rolling_median", f"WITH {ROLL_SQL} SELECT event_id, resid FROM rm", floats="resid")
def e02(spark, sf):
    """Chunks of 40 rows with halo: the answer must not depend on them."""
    return rolled(spark, sf).select("event_id", "resid")


@query("E03_rolling_mad", f"WITH {ROLL_SQL} SELECT event_id, mad FROM rm", floats="mad", digits=9)
def e03(spark, sf):
    return rolled(spark, sf).select("event_id", "mad")


@query("E04_edge_exemption", f"WITH {ROLL_SQL} SELECT interior, coalesce(interior AND abs(resid)>2*mad, false) AS bad, count(*) AS n FROM rm GROUP BY 1,2")
def e04(spark, sf):
    return rolled(spark, sf).groupBy("interior", "bad").agg(F.count(F.lit(1)).alias("n"))


YC_SQL = 'yc AS (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, "year", avg(h) AS h_y FROM pts GROUP BY 1,2,3)'


@query("E06_first_year_anomaly", with_pts('SELECT cell_x, cell_y, "year", h_y-first_value(h_y) OVER (PARTITION BY cell_x, cell_y ORDER BY "year") AS anomaly FROM yc', YC_SQL), floats="anomaly")
def e06(spark, sf):
    return summaries.first_year_anomaly(yearly_cells(spark, sf), ["cell_x", "cell_y"], "h_y").drop("h_y")


PANEL_SQL = 'pn AS (SELECT yc.*, h_y-arg_min(h_y,"year") OVER (PARTITION BY cell_x, cell_y) AS anomaly FROM yc WHERE (cell_x,cell_y) IN (SELECT (cell_x,cell_y) FROM yc GROUP BY cell_x,cell_y HAVING count(*)=(SELECT count(DISTINCT "year") FROM yc)))'


@query("E07_balanced_panel", with_pts('SELECT "year", count(*) AS n, avg(anomaly) AS anomaly FROM pn GROUP BY "year"', YC_SQL, PANEL_SQL), floats="anomaly")
def e07(spark, sf):
    return summaries.balanced_panel(yearly_cells(spark, sf), ["cell_x", "cell_y"], "h_y").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("anomaly").alias("anomaly"))


@query("E08_moving_slope", with_pts('SELECT cell_x, cell_y, s AS win_start, regr_slope(h_y,"year") AS slope FROM pn, (SELECT unnest(range(1995,1998)) AS s) WHERE "year" BETWEEN s AND s+4 GROUP BY ALL', YC_SQL, PANEL_SQL), floats="slope", digits=9)
def e08(spark, sf):
    p = summaries.balanced_panel(yearly_cells(spark, sf), ["cell_x", "cell_y"], "h_y")
    starts = F.filter(F.array(*[F.lit(s).cast("bigint") for s in (1995, 1996, 1997)]), lambda s: F.col("year").between(s, s + 4))
    return p.withColumn("win_start", F.explode(starts)).groupBy("cell_x", "cell_y", "win_start").agg(F.regr_slope("h_y", "year").alias("slope"))


@query("E09_lag1_autocorrelation", with_pts('SELECT pc, count(*) AS n, sum((r-m)*(rp-m))/sum((r-m)*(r-m)) AS ac1 FROM (SELECT *, lag(r) OVER (PARTITION BY pc ORDER BY t_year, pa, pb, pd) AS rp, avg(r) OVER (PARTITION BY pc) AS m FROM (SELECT *, h-500.0E0+0.5E0*("year"-1998) AS r FROM pts)) GROUP BY pc'), floats="ac1")
def e09(spark, sf):
    from cryoframe.operators.yearblocks import lag_one

    p = points(spark, sf).withColumn("r", F.col("h") - 500.0 + 0.5 * (F.col("year") - 1998))
    return lag_one(p, ["pc"], "r", "t_year", ties=["pa", "pb", "pd"])


@query("E10_false_discovery", with_pts("SELECT ci, cj, least(1.0E0, min(p*n/rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM (SELECT *, row_number() OVER (ORDER BY p, ci, cj) AS rk, count(*) OVER () AS n FROM (SELECT ci, cj, round(v*v*v*3000, 3) AS p FROM cen))", CENT_SQL), floats="p_fdr")
def e10(spark, sf):
    c = centroids(spark, sf).select("ci", "cj", F.round(F.col("v") * F.col("v") * F.col("v") * 3000, 3).alias("p"))
    return ranks.fdr(c, "p").select("ci", "cj", "p_fdr")


@query("E11_season_year", with_pts("SELECT season, count(*) AS n FROM (SELECT floor(t_year)::INT + CASE WHEN floor((t_year-floor(t_year))*12)+1>=12 THEN 1 ELSE 0 END AS season FROM pts WHERE \"month\" IN (12,1,2)) GROUP BY season"))
def e11(spark, sf):
    p = points(spark, sf).where(F.col("month").isin(12, 1, 2))
    return p.groupBy(timecols.season_year("t_year", [12, 1, 2]).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("E12_quartile_classes", with_pts("SELECT CASE WHEN h<=q1 THEN 0 WHEN h<=q2 THEN 1 WHEN h<=q3 THEN 2 ELSE 3 END AS quartile, count(*) AS n, avg(h) AS h_mean FROM pts, (SELECT quantile_cont(h,0.25) AS q1, median(h) AS q2, quantile_cont(h,0.75) AS q3 FROM pts) GROUP BY 1"), floats="h_mean")
def e12(spark, sf):
    return ranks.quartile_class(points(spark, sf), "h").groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h_mean"))


FOLD_SQL = "fo AS (SELECT bi, bj, ((row_number() OVER (ORDER BY (bi*7919+bj*104729)%1009, bi, bj)-1)%5)::INT AS fold FROM (SELECT DISTINCT floor(x/10000)::BIGINT AS bi, floor(y/10000)::BIGINT AS bj FROM pts))"


def folded(spark, sf):
    p = points(spark, sf).withColumn("bi", spatial.cell("x", 10000)).withColumn("bj", spatial.cell("y", 10000))
    return ranks.block_folds(p, 5, ["bi", "bj"], order=F.pmod(F.col("bi") * 7919 + F.col("bj") * 104729, F.lit(1009)))


@query("E13_fold_assignment", with_pts("SELECT fold, count(*) AS n, count(DISTINCT (bi,bj)) AS n_blocks FROM pts JOIN fo ON bi=floor(x/10000) AND bj=floor(y/10000) GROUP BY fold", FOLD_SQL))
def e13(spark, sf):
    return folded(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bi", "bj").alias("n_blocks"))


@query(
    "E14_no_leak",
    with_pts(
        "SELECT (SELECT count(*) FROM (SELECT pa, pb, pc, pd FROM pf GROUP BY ALL HAVING count(DISTINCT fold)>1)) AS n_leaked, "
        "(SELECT sum(k) FROM (SELECT count(DISTINCT fold) AS k FROM pf GROUP BY pc HAVING count(DISTINCT fold)>1))::BIGINT AS n_tracks_shared, (SELECT count(*) FROM pf) AS n",
        FOLD_SQL, "pf AS (SELECT pts.*, fold FROM pts JOIN fo ON bi=floor(x/10000) AND bj=floor(y/10000))",
    ),
)
def e14(spark, sf):
    """Blocks keep observations apart, yet not the tracks that run through them; both are counted."""
    train, test = interpolate.fold_views(folded(spark, sf), 5)
    n = test.agg(F.count(F.lit(1)).alias("n"))
    shared = ranks.leaked(train, test, ["pc", "fold"]).withColumnRenamed("n_leaked", "n_tracks_shared")
    return ranks.leaked(train, test, [*IDS, "fold"]).crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(n))


# ------------------------------------------------------------------ top-k and sets
@query("F01_capped_draw", with_pts("SELECT track_id, up AS ascending, n_pts FROM (SELECT *, row_number() OVER (PARTITION BY up ORDER BY (track_id*7919)%1009, track_id) AS k FROM dirs) WHERE k<=10", TRACK_SQL, CROSS_SQL))
def f01(spark, sf):
    d = tracks.track_direction(track_points(spark, sf), ties=["pa", "pb", "pd"])
    return ranks.hash_sample(d, 10, ["track_id"], by=["ascending"], order=F.pmod(F.col("track_id") * 7919, F.lit(1009)))


@query("F02_best_method", with_pts("SELECT CASE WHEN r2<=r1*1.02E0 AND d2<d1 THEN m2 ELSE m1 END AS winner, r1 AS best_rmse FROM (SELECT max(CASE WHEN k=1 THEN rmse END) AS r1, max(CASE WHEN k=2 THEN rmse END) AS r2, max(CASE WHEN k=1 THEN dev END) AS d1, max(CASE WHEN k=2 THEN dev END) AS d2, max(CASE WHEN k=1 THEN m END) AS m1, max(CASE WHEN k=2 THEN m END) AS m2 FROM (SELECT m, rmse, abs(c-0.6827E0) AS dev, row_number() OVER (ORDER BY rmse, m) AS k FROM (SELECT 'beam'||beam AS m, sqrt(avg(r*r)) AS rmse, avg((abs(r)/sqrt(v)<=1)::INT) AS c FROM rs GROUP BY beam)))", RES_SQL), floats="best_rmse")
def f02(spark, sf):
    m = interpolate.prediction_metrics(residual_rows(spark, sf), ["beam"]).withColumn("method", F.concat(F.lit("beam"), "beam"))
    return interpolate.pick_method(m)


@query("F03_largest_groups", with_pts("SELECT pc, count(*) AS n FROM pts WHERE mask_class=3 GROUP BY pc ORDER BY n DESC, pc LIMIT 5"))
def f03(spark, sf):
    return points(spark, sf).where(F.col("mask_class") == 3).groupBy("pc").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "pc").limit(5)


@query("F04_longest_pass", with_pts("SELECT granule, count(*) AS n, sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)) AS diagonal FROM pts GROUP BY granule HAVING count(*)>=3 ORDER BY round(diagonal,6) DESC, granule LIMIT 1"), floats="diagonal", digits=4)
def f04(spark, sf):
    return summaries.longest_pass(points(spark, sf), "granule", min_rows=3)


@query("F05_head_tail", with_pts('SELECT "year", median(a) FILTER (u<=3) AS head, median(a) FILTER (d<=3) AS tail FROM (SELECT "year", box, a, row_number() OVER (PARTITION BY "year" ORDER BY box) AS u, row_number() OVER (PARTITION BY "year" ORDER BY box DESC) AS d FROM (SELECT "year", floor(y/5000)::BIGINT AS box, median(h) AS a FROM pts GROUP BY 1,2)) GROUP BY "year"'), floats="head tail")
def f05(spark, sf):
    s = group_quantiles(points(spark, sf).withColumn("box", spatial.cell("y", 5000)), ["year", "box"], "h", {"a": 0.5})
    return summaries.head_tail(s, ["year"], "box", "a")


@query("F06_argmax_transect", with_pts("SELECT cell_j, arg_max(cell_i, (round(v,9), -cell_i)) AS fastest, max(v) AS peak, count(*) FILTER (v>0.5E0*mv) AS width FROM (SELECT *, max(v) OVER (PARTITION BY cell_j) AS mv FROM fld) GROUP BY cell_j", FIELD_SQL), floats="peak")
def f06(spark, sf):
    f = field(spark, sf)
    top = f.groupBy("cell_j").agg(F.max_by("cell_i", F.struct(F.round("v", 9).alias("v"), F.negate("cell_i"))).alias("fastest"), F.max("v").alias("peak"))
    w = f.join(top, "cell_j").groupBy("cell_j").agg(F.count_if(F.col("v") > 0.5 * F.col("peak")).alias("width"))
    return top.join(w, "cell_j")


@query("G01_bag_union", with_pts("SELECT count(*) AS n, sum(h) AS h_sum FROM (SELECT h FROM pts WHERE mask_class=3 UNION ALL SELECT h FROM pts WHERE beam<=3)"), floats="h_sum", digits=3)
def g01(spark, sf):
    p = points(spark, sf).select("h", "mask_class", "beam")
    return p.where(F.col("mask_class") == 3).unionByName(p.where(F.col("beam") <= 3)).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h_sum"))


@query("G02_difference", with_pts('SELECT DISTINCT pc, "year" FROM pts WHERE mask_class=3 EXCEPT SELECT DISTINCT pc, "year" FROM pts WHERE "month"=6 AND beam=1'))
def g02(spark, sf):
    p = points(spark, sf)
    return p.where(F.col("mask_class") == 3).select("pc", "year").distinct().exceptAll(p.where((F.col("month") == 6) & (F.col("beam") == 1)).select("pc", "year").distinct())


@query("G03_intersection", with_pts('SELECT DISTINCT pb, "year" FROM pts WHERE "month" IN (6,7,8) INTERSECT SELECT DISTINCT pb, "year" FROM pts WHERE "month" IN (12,1,2)'))
def g03(spark, sf):
    p = points(spark, sf)
    return p.where(F.col("month").isin(6, 7, 8)).select("pb", "year").intersect(p.where(F.col("month").isin(12, 1, 2)).select("pb", "year"))


@query("G04_distinct", with_pts("SELECT count(*) AS n FROM (SELECT DISTINCT mask_class, round_even(x/2000,0), round_even(y/2000,0) FROM pts)"))
def g04(spark, sf):
    q = points(spark, sf).select("mask_class", F.rint(F.col("x") / 2000).alias("qx"), F.rint(F.col("y") / 2000).alias("qy"))
    return q.dropDuplicates().agg(F.count(F.lit(1)).alias("n"))
