"""Queries over the scalar functions (H)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cryoframe.functions import physics, projection, timecols
from cryoframe.operators.skew import attach_median_mad, group_median_mad
from cryoframe.plans.base import IDS, lonlat, points, query, table, with_pts
from cryoframe.plans.q_sources import MOORING_SQL, PSS_SQL, mooring_rows
from cryoframe.sources.fields import clean_mooring

KEYS = "pa, pb, pc, pd"


@query("H01_delta_time", with_pts("SELECT beam, sum(2018.0E0+tax*1E7/31557600.0E0-2018.0E0) AS t_sum, sum((t_year-2018.0E0)*31557600.0E0)/1E9 AS delta_sum FROM pts GROUP BY beam"), floats="t_sum delta_sum")
def h01(spark, sf):
    return points(spark, sf).groupBy("beam").agg(
        F.sum(timecols.year_from_delta(F.col("tax") * 1e7) - 2018.0).alias("t_sum"), (F.sum(timecols.delta_from_year("t_year")) / 1e9).alias("delta_sum"))


@query(
    "H02_month_of_year",
    """SELECT m AS month, count(*) AS n FROM (SELECT month(make_date(y, 1, 1) + least(floor((t-y)*len), len-1)::INT)::INT AS m FROM
       (SELECT t, floor(t)::INT AS y, dayofyear(make_date(floor(t)::INT, 12, 31)) AS len FROM (SELECT year(l_shipdate)+(l_partkey%1000)/1000.0E0 AS t FROM lineitem))) GROUP BY m""",
)
def h02(spark, sf):
    t = F.year("l_shipdate") + (F.col("l_partkey") % 1000) / F.lit(1000.0)
    return table(spark, sf, "lineitem").select(timecols.month_of(t).alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("H03_decimal_year", "SELECT event_type, sum(year(ts)+(dayofyear(ts)-1)/365.25E0) AS t_sum FROM events GROUP BY event_type", floats="t_sum", digits=4)
def h03(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(timecols.decimal_year("ts")).alias("t_sum"))


_E = projection.ECC
_K = projection._SCALE
PROJ_SQL = f"""pr AS (SELECT *, {_K!r}*tan({math.pi / 4!r}-(-radians(lat))/2)/pow((1-{_E!r}*sin(-radians(lat)))/(1+{_E!r}*sin(-radians(lat))), {_E / 2!r}) AS rho FROM
  (SELECT {KEYS}, -115.0E0+x*2.0E-4 AS lon, -77.5E0+y*4.5E-5 AS lat FROM pts))"""


@query(
    "H04_polar_stereographic",
    with_pts(f"SELECT {KEYS}, rho*sin(radians(lon)) AS px, rho*cos(radians(lon)) AS py, round(lon, 6) + 0.0::DOUBLE AS lon_back, round(lat, 6) + 0.0::DOUBLE AS lat_back FROM pr", PROJ_SQL),
    floats="px py", digits=4,
)
def h04(spark, sf):
    """Forward and back: the inverse must return the input."""
    p = lonlat(points(spark, sf))
    px, py = projection.to_polar(F.col("lon"), F.col("lat"))
    p = p.select(*IDS, px.alias("px"), py.alias("py"))
    lon, lat = projection.to_lonlat(F.col("px"), F.col("py"))
    return p.withColumn("lon_back", F.round(lon, 6)).withColumn("lat_back", F.round(lat, 6))


@query(
    "H05_signed_difference",
    with_pts("SELECT beam, sum(h-500.0E0-disc) AS diff_sum, sum(sqrt(s_elv*s_elv+disc*disc)) AS comb_sum, sum((h-500.0E0-disc)/nullif(sqrt(s_elv*s_elv+disc*disc),0)) AS z_sum FROM pts GROUP BY beam"),
    floats="diff_sum comb_sum z_sum", digits=4,
)
def h05(spark, sf):
    d = F.col("h") - 500.0 - F.col("disc")
    c = physics.combined_sigma("s_elv", "disc")
    return points(spark, sf).groupBy("beam").agg(F.sum(d).alias("diff_sum"), F.sum(c).alias("comb_sum"), F.sum(F.when(c > 0, d / c)).alias("z_sum"))


@query("H06_hydrostatic", with_pts("SELECT mask_class, count(CASE WHEN mask_class=3 THEN 1 END) AS n, sum(CASE WHEN mask_class=3 THEN disc*(1027.0E0/110.0E0) END) AS rate FROM pts GROUP BY mask_class"), floats="rate")
def h06(spark, sf):
    r = physics.thickness_rate("disc", F.col("mask_class") == 3)
    return points(spark, sf).groupBy("mask_class").agg(F.count(r).alias("n"), F.sum(r).alias("rate"))


@query("H07_basal_melt", with_pts("SELECT mask_class, sum(CASE WHEN mask_class=3 THEN coalesce(CASE WHEN beam<7 THEN tax END, 0.0E0)-disc-s_elv*2 END) AS melt FROM pts GROUP BY mask_class"), floats="melt")
def h07(spark, sf):
    smb = F.when(F.col("beam") < 7, F.col("tax"))
    m = physics.basal_melt(F.col("disc"), F.col("s_elv") * 2, smb, F.col("mask_class") == 3)
    return points(spark, sf).groupBy("mask_class").agg(F.sum(m).alias("melt"))


HAF_SQL = "f AS (SELECT beam, disc, (h-200.0E0)-(1027.0E0/917.0E0)*greatest(-(x-60000.0E0)/100, 0.0E0) AS haf FROM pts)"


@query("H08_height_above_flotation", with_pts("SELECT beam, sum(haf) AS haf_sum, count(*) FILTER (haf <= 0) AS n_floating FROM f GROUP BY beam", HAF_SQL), floats="haf_sum", digits=4)
def h08(spark, sf):
    haf = physics.height_above_flotation((F.col("x") - 60000.0) / 100, F.col("h") - 200.0)
    return points(spark, sf).groupBy("beam").agg(F.sum(haf).alias("haf_sum"), F.count_if(haf <= 0).alias("n_floating"))


@query("H09_time_to_unground", with_pts("SELECT beam, count(t) AS n, sum(t) AS t_sum FROM (SELECT beam, CASE WHEN haf<=0 THEN 0.0E0 WHEN disc>0.02E0 THEN haf/disc END AS t FROM f) GROUP BY beam", HAF_SQL), floats="t_sum", digits=2)
def h09(spark, sf):
    haf = physics.height_above_flotation((F.col("x") - 60000.0) / 100, F.col("h") - 200.0)
    t = physics.years_to_flotation(haf, -F.col("disc"))
    return points(spark, sf).groupBy("beam").agg(F.count(t).alias("n"), F.sum(t).alias("t_sum"))


@query("H10_datum_rates", with_pts("SELECT beam, sum(h-(-20.0E0-disc)) AS ortho, sum(disc-coalesce(CASE WHEN beam<6 THEN tax END,0.0E0)) AS rate, sum(disc+s_elv*0.1E0+tax*0.2E0) AS advected FROM pts GROUP BY beam"), floats="ortho rate advected", digits=4)
def h10(spark, sf):
    return points(spark, sf).groupBy("beam").agg(
        F.sum(physics.orthometric("h", F.lit(-20.0) - F.col("disc"))).alias("ortho"),
        F.sum(physics.remove_rate("disc", F.when(F.col("beam") < 6, F.col("tax")))).alias("rate"),
        F.sum(physics.add_advection("disc", "s_elv", F.lit(0.1), "tax", F.lit(0.2))).alias("advected"),
    )


@query("H11_freezing_point", with_pts("SELECT beam, sum(-0.0575E0*s+1.710523E-3*pow(s,1.5E0)-2.154996E-4*p) AS tf FROM (SELECT beam, 30.0E0+disc*50 AS s, 400.0E0+qty AS p FROM pts) GROUP BY beam"), floats="tf")
def h11(spark, sf):
    return points(spark, sf).groupBy("beam").agg(F.sum(physics.freezing_point(F.lit(30.0) + F.col("disc") * 50, F.col("qty") + 400.0)).alias("tf"))


@query("H12_practical_salinity", f"WITH {MOORING_SQL}, {PSS_SQL} SELECT count(*) AS n, sum(salinity) AS s_sum, min(salinity) AS s_min, max(salinity) AS s_max FROM frz", floats="s_sum s_min s_max", digits=5)
def h12(spark, sf):
    d = clean_mooring(mooring_rows(spark, sf))
    return d.agg(F.count("salinity").alias("n"), F.sum("salinity").alias("s_sum"), F.min("salinity").alias("s_min"), F.max("salinity").alias("s_max"))


@query("H13_speed_bearing", f"WITH {MOORING_SQL} SELECT floor(degrees(atan2(u,v)+2*pi())%360/30)::BIGINT AS sector, count(*) AS n, avg(sqrt(u*u+v*v)) AS speed FROM m GROUP BY 1", floats="speed")
def h13(spark, sf):
    d = clean_mooring(mooring_rows(spark, sf))
    return d.groupBy(F.floor(physics.bearing("u_cm_s", "v_cm_s") / 30).alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.avg("speed_cm_s").alias("speed"))


@query("H14_thermal_driving", f"WITH {MOORING_SQL}, {PSS_SQL} SELECT c AS conductivity, avg(t-freezing) AS driving, avg(sqrt(u*u+v*v)/100*(t-freezing)) AS proxy FROM frz GROUP BY c", floats="conductivity driving proxy")
def h14(spark, sf):
    d = clean_mooring(mooring_rows(spark, sf))
    return d.groupBy(F.col("conductivity_ms_cm").alias("conductivity")).agg(F.avg("thermal_driving").alias("driving"), F.avg("heat_proxy").alias("proxy"))


@query("H15_geolocation_sigma", with_pts("SELECT beam, sum(sqrt(0.03E0*0.03E0+6.0E0*6.0E0*disc*disc)) AS s_sum, sum(CASE WHEN tax>0 THEN sqrt(0.03E0*0.03E0+6.0E0*6.0E0*disc*disc)/sqrt(tax) END) AS r_sum FROM pts GROUP BY beam"), floats="s_sum r_sum")
def h15(spark, sf):
    s = physics.geolocation_sigma("disc", 0.03, 6.0)
    return points(spark, sf).groupBy("beam").agg(F.sum(s).alias("s_sum"), F.sum(physics.rate_sigma_from_leverage(s, F.col("tax"))).alias("r_sum"))


@query(
    "H16_harmonics",
    with_pts("SELECT beam, sum(cos(2*pi()*t_year)) AS c1, sum(sin(2*pi()*t_year/0.5E0)) AS s2, sum(floor(t_year)+(t_year-floor(t_year)-lo)/(hi-lo)) AS stretched FROM pts JOIN (SELECT beam AS b, min(t_year-floor(t_year)) AS lo, max(t_year-floor(t_year)) AS hi FROM pts GROUP BY beam) ON beam=b GROUP BY beam"),
    floats="c1 s2 stretched", digits=4,
)
def h16(spark, sf):
    p = points(spark, sf)
    frac = F.col("t_year") - F.floor("t_year")
    ends = p.groupBy("beam").agg(F.min(frac).alias("lo"), F.max(frac).alias("hi"))
    return p.join(ends, "beam").groupBy("beam").agg(
        F.sum(physics.harmonic("t_year", 1.0)).alias("c1"), F.sum(physics.harmonic("t_year", 0.5, "sin")).alias("s2"),
        F.sum(timecols.phase_stretch("t_year", F.col("lo"), F.col("hi"))).alias("stretched"))


@query(
    "H17_variogram_models",
    with_pts("SELECT beam, sum(CASE WHEN d=0 THEN 0.0E0 WHEN d>=30 THEN 2.0E0 ELSE 0.1E0+1.9E0*(1.5E0*d/30-0.5E0*pow(d/30,3)) END) AS spherical, sum(CASE WHEN d=0 THEN 0.0E0 ELSE 0.1E0+1.9E0*(1-exp(-d/30)) END) AS exponential FROM (SELECT beam, qty-1.0E0 AS d FROM pts) GROUP BY beam"),
    floats="spherical exponential", digits=5,
)
def h17(spark, sf):
    d = F.col("qty") - 1.0
    return points(spark, sf).groupBy("beam").agg(
        F.sum(physics.variogram_model("spherical", d, 0.1, 2.0, 30.0)).alias("spherical"),
        F.sum(physics.variogram_model("exponential", d, 0.1, 2.0, 30.0)).alias("exponential"))


@query("H20_amplitude_phase", with_pts("SELECT beam, sum(sqrt(a*a+b*b)) AS amp, sum(((atan2(b,a)/(2*pi())+1.0E0)%1.0E0)*365.25E0) AS doy FROM (SELECT beam, disc-0.05E0 AS a, tax-0.045E0 AS b FROM pts) GROUP BY beam"), floats="amp doy", digits=4)
def h20(spark, sf):
    amp, doy = physics.annual_amplitude_phase(F.col("disc") - 0.05, F.col("tax") - 0.045)
    return points(spark, sf).groupBy("beam").agg(F.sum(amp).alias("amp"), F.sum(doy).alias("doy"))


@query("H21_mad_scale", with_pts("SELECT beam, count(*) AS n, any_value(m) AS med, 1.4826E0*median(abs(h-m)) AS mad FROM (SELECT beam, h, median(h) OVER (PARTITION BY beam) AS m FROM pts) GROUP BY beam"), floats="med mad")
def h21(spark, sf):
    """Seven groups hold the whole table: the sliced path does the work."""
    return group_median_mad(points(spark, sf), ["beam"], "h", limit=5000)


@query("E05_group_transform", with_pts("SELECT mask_class, count(*) AS n_rows, sum(abs(h-m)) AS dev, sum(n) AS n_sum FROM (SELECT mask_class, h, median(h) OVER (PARTITION BY pc, \"year\") AS m, count(*) OVER (PARTITION BY pc, \"year\") AS n FROM pts) GROUP BY mask_class").replace("sum(n) AS", "sum(n)::BIGINT AS"), floats="dev", digits=5)
def e05(spark, sf):
    rows = attach_median_mad(points(spark, sf), ["pc", "year"], "h", n="n", med="med", mad="mad")
    return rows.groupBy("mask_class").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.abs(F.col("h") - F.col("med"))).alias("dev"), F.sum("n").alias("n_sum"))
