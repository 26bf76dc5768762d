"""Queries over filters and decisions (B), as far as they need no spatial join."""

from __future__ import annotations

from pyspark.sql import functions as F

from cryoframe.functions import predicates as pred
from cryoframe.operators import rates, spatial
from cryoframe.plans.base import points, query, with_pts
from cryoframe.schema import height_column

FLAGS_SQL = """fl AS (SELECT pts.*, CASE WHEN rflag='R' THEN 1 ELSE 0 END AS q, CASE WHEN pb%17=0 THEN NULL ELSE disc*15 END AS spread, (pc%7-1)::INT AS msw,
  h-CASE WHEN granule%97=0 THEN 150.0E0 ELSE qty END AS dem FROM pts)"""


def flags(spark, sf):
    return points(spark, sf).select(
        "*", (F.col("rflag") == "R").cast("int").alias("atl06_quality_summary"), F.when(F.col("pb") % 17 != 0, F.col("disc") * 15).alias("h_robust_sprd"),
        (F.col("pc") % 7 - 1).cast("int").alias("msw_flag"), (F.col("h") - F.when(F.col("granule") % 97 == 0, 150.0).otherwise(F.col("qty"))).alias("dem_h"),
    )


@query(
    "B01_flag_mask",
    with_pts("SELECT count(*) AS n, count(*) FILTER (q=0 AND coalesce(spread<=1.0E0,true) AND msw<=4 AND abs(h-dem)<=100) AS kept, count(*) FILTER (q<>0) AS bad_quality, count(*) FILTER (spread>1.0E0) AS bad_h_robust_sprd, count(*) FILTER (msw>4) AS bad_msw_flag, count(*) FILTER (abs(h-dem)>100) AS bad_dem_h FROM fl", FLAGS_SQL),
)
def b01(spark, sf):
    f = flags(spark, sf)
    return pred.flag_reasons(f, pred.flag_rules(f.columns, pred.FlagLimits(), "h"))


@query("B02_roi_box", with_pts("SELECT mask_class, count(*) AS n FROM pts WHERE x BETWEEN 20000 AND 80000 AND y BETWEEN 10000 AND 50000 GROUP BY mask_class"))
def b02(spark, sf):
    return points(spark, sf).where(pred.in_box("x", "y", 20000, 80000, 10000, 50000)).groupBy("mask_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B05_grounded_filter",
    with_pts("SELECT CASE WHEN mask_class<>2 THEN 'class' WHEN x<2000 THEN 'coast' WHEN y<5000 THEN 'grounding_line' ELSE 'kept' END AS reason, count(*) AS n, count(*) FILTER (mask_class=2 AND x>=2000 AND y>=5000) AS n_keep FROM pts GROUP BY 1"),
)
def b05(spark, sf):
    args = (F.col("mask_class"), F.col("x"), F.col("y"), 2000.0, 5000.0)
    p = points(spark, sf).select(pred.grounded_reason(*args).alias("reason"), pred.grounded_keep(*args).alias("keep"))
    return p.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("n_keep"))


@query("B06_shelf_filter", with_pts('SELECT "year", count(*) AS n FROM pts WHERE mask_class=3 AND y>=3000 AND x>=5000 GROUP BY "year"'))
def b06(spark, sf):
    p = points(spark, sf).where(pred.shelf_keep(F.col("mask_class"), F.col("x"), F.col("y"), 3000.0, 5000.0))
    return p.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("B09_node_acceptance", with_pts("SELECT count(*) AS n FROM pts WHERE mask_class=2 AND x>=5000 AND y>=2000 AND disc*10>=0.5E0"))
def b09(spark, sf):
    near = pred.grounded_keep(F.col("mask_class"), F.col("x"), F.col("y"), 5000.0, 2000.0)
    return points(spark, sf).where(near & (F.col("disc") * 10 >= 0.5)).agg(F.count(F.lit(1)).alias("n"))


NODES_SQL = """nd AS (SELECT floor(x/5000)::BIGINT AS ci, floor(y/5000)::BIGINT AS cj, (count(*)*40)::BIGINT AS nobs, count(DISTINCT "year") AS n_years_node, avg(disc)*20-1.2E0 AS dhdt,
  stddev_samp(disc)*2 AS dhdt_err, avg(tax)*20 AS rmse, max(t_year)-min(t_year) AS tspan, avg(qty)*4 AS speed, (count(*)%9)::BIGINT AS n_pixels FROM pts GROUP BY 1, 2)"""


def node_stats(spark, sf):
    """A node table made of cell statistics."""
    return points(spark, sf).groupBy(spatial.cell("x", 5000).alias("ci"), spatial.cell("y", 5000).alias("cj")).agg(
        (F.count(F.lit(1)) * 40).alias("nobs"), F.count_distinct("year").alias("n_years_node"), (F.avg("disc") * 20 - 1.2).alias("dhdt"),
        (F.stddev_samp("disc") * 2).alias("dhdt_err"), (F.avg("tax") * 20).alias("rmse"), (F.max("t_year") - F.min("t_year")).alias("tspan"),
        (F.avg("qty") * 4).alias("speed"), (F.count(F.lit(1)) % 9).alias("n_pixels"))


CRITERIA_SQL = """cl AS (SELECT *, abs(dhdt)/nullif(dhdt_err,0) AS snr, n_years_node::DOUBLE AS n_years_used, CASE
  WHEN dhdt IS NOT NULL AND dhdt_err>0 AND nobs>=5000 AND n_years_node>=5 AND rmse<=1.0E0 AND dhdt_err<=0.15E0 AND tspan>=4 AND abs(dhdt)/dhdt_err>=2 THEN 'reliable'
  WHEN dhdt IS NOT NULL AND dhdt_err>0 AND nobs>=500 AND n_years_node>=4 AND rmse<=2.5E0 AND dhdt_err<=0.5E0 AND tspan>=3 THEN 'acceptable' ELSE 'unreliable' END AS reliability FROM nd)"""


@query("B10_reliability", with_pts("SELECT ci, cj, snr, n_years_used, reliability FROM cl", NODES_SQL, CRITERIA_SQL), floats="snr")
def b10(spark, sf):
    return pred.classify_nodes(node_stats(spark, sf)).select("ci", "cj", "snr", "n_years_used", "reliability")


JOINT_SQL = """jc AS (SELECT *, coalesce(n_pixels>=5, false) AS has_v, coalesce(dhdt_err>0 AND dhdt+1.96E0*dhdt_err<0, false) AS thin, coalesce(dhdt_err>0 AND abs(dhdt)<=1.96E0*dhdt_err, false) AS stab,
  coalesce(n_pixels>=5 AND speed>=100, false) AS fast FROM nd)"""
JOINT_CASE = "CASE WHEN stab AND fast THEN 'stable_fast' WHEN stab AND has_v THEN 'stable_slow' WHEN thin AND fast THEN 'thinning_fast' WHEN thin AND has_v THEN 'thinning_slow' ELSE 'inconclusive' END"


@query("B11_joint_class", with_pts(f"SELECT ci, cj, {JOINT_CASE} AS joint_class, thin AS thinning_significant FROM jc", NODES_SQL, JOINT_SQL))
def b11(spark, sf):
    c = pred.joint_class()
    return node_stats(spark, sf).select("ci", "cj", c["joint_class"].alias("joint_class"), c["thinning_significant"].alias("thinning_significant"))


@query("B12_crosscheck", with_pts("SELECT count(*) FILTER (abs(dhdt)<=0.1E0) AS n_small, count(*) FILTER (speed>=100) AS n_fast, count(*) FILTER (abs(dhdt)<=0.1E0 AND speed>=100) AS n_both FROM nd", NODES_SQL))
def b12(spark, sf):
    small, fast = F.abs("dhdt") <= 0.1, F.col("speed") >= 100
    return node_stats(spark, sf).agg(F.count_if(small).alias("n_small"), F.count_if(fast).alias("n_fast"), F.count_if(small & fast).alias("n_both"))


@query("B13_parcel_reliability", with_pts("SELECT CASE WHEN x/10<5000 AND disc*30<=2 THEN 'reliable' WHEN x/10<10000 THEN 'acceptable' ELSE 'unreliable' END AS label, count(*) AS n FROM pts GROUP BY 1"))
def b13(spark, sf):
    return points(spark, sf).groupBy(pred.parcel_reliability(F.col("x") / 10, F.col("disc") * 30).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("B14_height_choice", with_pts("SELECT avg(h-disc) AS h_mean, 'h_corr' AS chosen FROM pts"), floats="h_mean")
def b14(spark, sf):
    p = points(spark, sf).withColumnRenamed("h", "h_elv").withColumn("h_corr", F.col("h_elv") - F.col("disc"))
    c = height_column(p)
    return p.agg(F.avg(c).alias("h_mean")).withColumn("chosen", F.lit(c))


WIN_SQL = "w AS (SELECT 1995.0E0+i AS a, 1998.0E0+i AS b FROM (SELECT unnest(range(0,5)) AS i))"


@query("B15_time_windows", with_pts("SELECT a AS win_start, b AS win_end, count(*) AS n FROM pts JOIN w ON t_year>=a AND t_year<b GROUP BY a, b", WIN_SQL))
def b15(spark, sf):
    windows = rates.moving_windows(3.0, 1.0, 1995.0, 2002.0)
    return rates.time_windows(points(spark, sf), windows).groupBy("win_start", "win_end").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B16_window_generators",
    with_pts("SELECT kind, a AS win_start, b AS win_end, (SELECT count(*) FROM pts WHERE t_year>=a AND t_year<b) AS n FROM (SELECT 'moving' AS kind, 1995.0E0+i AS a, 1998.0E0+i AS b FROM (SELECT unnest(range(0,5)) AS i) UNION ALL SELECT 'expanding', 1995.0E0, 1998.0E0+i FROM (SELECT unnest(range(0,5)) AS i))"),
)
def b16(spark, sf):
    """The record's own span makes the windows: two numbers reach the driver."""
    p = points(spark, sf)
    t0, t1 = p.agg(F.min("t_year"), F.max("t_year")).first()
    out = None
    for kind, ws in (("moving", rates.moving_windows(3.0, 1.0, t0, t1)), ("expanding", rates.expanding_windows(float(int(t0)), 3.0, t1))):
        n = rates.time_windows(p, ws).groupBy("win_start", "win_end").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        out = n if out is None else out.unionByName(n)
    return out


@query("B17_accepted_nodes", with_pts("SELECT ci, cj, nobs FROM nd WHERE (round_even((ci+0.5E0)*5000, 0), round_even((cj+0.5E0)*5000, 0)) IN (SELECT (round_even((ci+0.5E0)*5000, 0), round_even((cj+0.5E0)*5000, 0)) FROM nd WHERE dhdt_err<0.07E0)", NODES_SQL))
def b17(spark, sf):
    key = lambda d: d.withColumn("kx", F.rint((F.col("ci") + 0.5) * 5000).cast("bigint")).withColumn("ky", F.rint((F.col("cj") + 0.5) * 5000).cast("bigint"))
    n = key(node_stats(spark, sf))
    return n.join(n.where(F.col("dhdt_err") < 0.07), ["kx", "ky"], "left_semi").select("ci", "cj", "nobs")


@query("B18_trusted_rows", with_pts("SELECT shelf, count(*) FILTER (lab='reliable') AS n_rel, count(*) FILTER (contains(lower(shelf),'shelf_1') AND lab='reliable') AS n_trusted FROM (SELECT 'Shelf_'||mask_class AS shelf, CASE WHEN disc<0.05E0 THEN 'reliable' WHEN disc<0.08E0 THEN 'acceptable' END AS lab FROM pts) GROUP BY shelf"))
def b18(spark, sf):
    p = points(spark, sf).select(F.concat(F.lit("Shelf_"), "mask_class").alias("shelf"), F.when(F.col("disc") < 0.05, "reliable").when(F.col("disc") < 0.08, "acceptable").alias("lab"))
    rel = F.coalesce(F.col("lab").startswith("reli"), F.lit(False))
    on = F.coalesce(F.lower("shelf").contains("shelf_1"), F.lit(False))
    return p.groupBy("shelf").agg(F.count_if(rel).alias("n_rel"), F.count_if(rel & on).alias("n_trusted"))


@query(
    "B19_sampling_filter",
    with_pts("""SELECT ci, cj, count(*) AS n_months, count(DISTINCT "year") AS n_years, sum(k)::BIGINT AS n_points FROM (SELECT floor(x/20000)::BIGINT AS ci, floor(y/20000)::BIGINT AS cj, "year", "month", count(*) AS k FROM pts GROUP BY ALL HAVING count(*)>=2) GROUP BY ci, cj HAVING count(*)>=24 AND count(DISTINCT "year")>=4"""),
)
def b19(spark, sf):
    m = points(spark, sf).groupBy(spatial.cell("x", 20000).alias("ci"), spatial.cell("y", 20000).alias("cj"), "year", "month").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= 2)
    g = m.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n_months"), F.count_distinct("year").alias("n_years"), F.sum("k").alias("n_points"))
    return g.where((F.col("n_months") >= 24) & (F.col("n_years") >= 4))


@query("B20_gated_correction", with_pts("SELECT mask_class, sum(h-CASE WHEN mask_class=3 THEN coalesce(CASE WHEN pb%13<>0 THEN disc END,0.0E0)+tax ELSE 0.0E0 END) AS h_sum FROM pts GROUP BY mask_class"), floats="h_sum", digits=4)
def b20(spark, sf):
    p = points(spark, sf).withColumn("tide_ocean", F.when(F.col("pb") % 13 != 0, F.col("disc")).otherwise(F.lit(float("nan")))).withColumn("dac", F.col("tax"))
    return pred.apply_corrections(p, height="h").groupBy("mask_class").agg(F.sum("h_corr").alias("h_sum"))


@query(
    "B21_tide_replacement",
    with_pts("SELECT count(*) AS n, count(pr) AS n_predicted, sum(coalesce(pr, disc)) AS tide_sum, sum(disc) AS got_sum, avg(pr-disc) AS mean_diff, sqrt(avg((pr-disc)*(pr-disc))) AS rms_diff, max(abs(pr-disc)) AS max_diff FROM (SELECT disc, CASE WHEN tiles.m > 0.048E0 THEN m END AS pr FROM pts JOIN (SELECT floor(x/10000) AS ci, floor(y/10000) AS cj, avg(tax)*1.2E0 AS m FROM pts GROUP BY 1,2) tiles ON floor(x/10000)=ci AND floor(y/10000)=cj)"),
    floats="tide_sum got_sum mean_diff rms_diff max_diff", digits=5,
)
def b21(spark, sf):
    """Supplied predictions per cell, null where the model has none."""
    p = points(spark, sf).withColumn("ci", spatial.cell("x", 10000)).withColumn("cj", spatial.cell("y", 10000)).withColumn("tide_ocean", F.col("disc"))
    m = p.groupBy("ci", "cj").agg((F.avg("tax") * 1.2).alias("_m")).select("ci", "cj", F.when(F.col("_m") > 0.048, F.col("_m")).alias("tide_predicted"))
    r = pred.replace_tide(p.join(m, ["ci", "cj"], "left"))
    d = F.col("tide_predicted") - F.col("tide_ocean_got")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count("tide_predicted").alias("n_predicted"), F.sum("tide_ocean").alias("tide_sum"), F.sum("tide_ocean_got").alias("got_sum"),
                 F.avg(d).alias("mean_diff"), F.sqrt(F.avg(d * d)).alias("rms_diff"), F.max(F.abs(d)).alias("max_diff"))


@query("B24_support_class", with_pts("SELECT CASE WHEN y/2<=7500 THEN 'observed_near' WHEN y/2<=20000 THEN 'interpolated' WHEN y/2<=40000 THEN 'weak_extrapolation' ELSE 'constrained' END AS support, count(*) AS n FROM pts GROUP BY 1"))
def b24(spark, sf):
    return points(spark, sf).groupBy(pred.support_class(F.col("y") / 2, 20000.0, 40000.0).alias("support")).agg(F.count(F.lit(1)).alias("n"))


BOX_SQL = "bx AS (SELECT pc, min(x) AS x0, min(x)+3000 AS x1, min(y) AS y0, min(y)+20000 AS y1 FROM pts WHERE mask_class=4 GROUP BY pc)"


@query("B23_region_boxes", with_pts("SELECT mask_class, count(*) AS n FROM pts WHERE EXISTS (SELECT 1 FROM bx WHERE x>=x0-1000 AND x<x1+1000 AND y>=y0-1000 AND y<y1+1000) GROUP BY mask_class", BOX_SQL))
def b23(spark, sf):
    p = points(spark, sf)
    boxes = p.where(F.col("mask_class") == 4).groupBy("pc").agg(F.min("x").alias("x0"), (F.min("x") + 3000).alias("x1"), F.min("y").alias("y0"), (F.min("y") + 20000).alias("y1"))
    return spatial.in_boxes(p.select("x", "y", "mask_class"), boxes.drop("pc"), 1000.0, 5000.0).groupBy("mask_class").agg(F.count(F.lit(1)).alias("n"))


