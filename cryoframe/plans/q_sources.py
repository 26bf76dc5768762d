"""Queries over the sources and sinks (A)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cryoframe.operators import spatial
from cryoframe.plans.base import LONLAT, lonlat, points, query, table, with_pts
from cryoframe.schema import POINTS, cast_to
from cryoframe.session import checkpoint_dir
from cryoframe.sources import fields
from cryoframe.sources import points as src

CONTRACT_SQL = f"""c AS (SELECT {LONLAT}, h::FLOAT AS h_elv, s_elv::FLOAT AS s_elv, t_year, beam::TINYINT AS beam,
  disc::FLOAT AS tide_ocean, NULL::FLOAT AS tide_equilibrium, (tax*0.5E0)::FLOAT AS dac, (-20.0E0-disc)::FLOAT AS geoid, granule FROM pts)"""


def contract(spark: SparkSession, sf: str) -> DataFrame:
    return lonlat(points(spark, sf)).select(
        "lon", "lat", F.col("h").alias("h_elv"), "s_elv", "t_year", "beam", F.col("disc").alias("tide_ocean"),
        F.lit(None).cast("float").alias("tide_equilibrium"), (F.col("tax") * 0.5).alias("dac"), (F.lit(-20.0) - F.col("disc")).alias("geoid"), "granule",
    )


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored_points(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "points")
    src.save_points(contract(spark, sf), path)
    return path


SUMMARY_SQL = "SELECT beam, count(*) AS n, min(h_elv::DOUBLE) AS h_min, max(h_elv::DOUBLE) AS h_max, count(tide_equilibrium) AS n_eq, avg(t_year) AS t_mean FROM c GROUP BY beam"


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("beam").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("h_elv").cast("double")).alias("h_min"), F.max(F.col("h_elv").cast("double")).alias("h_max"),
        F.count("tide_equilibrium").alias("n_eq"), F.avg("t_year").alias("t_mean"),
    )


@query("A01_point_scan", with_pts(SUMMARY_SQL, CONTRACT_SQL), floats="h_min h_max t_mean", digits=4)
def a01(spark, sf):
    return _summary(src.scan_points(spark, stored_points(spark, sf)))


@query("A02_cast_contract", with_pts("SELECT lon, lat, h_elv::DOUBLE AS h_elv, beam, tide_ocean::DOUBLE AS tide_ocean, t_year FROM c", CONTRACT_SQL), floats="lon lat h_elv tide_ocean t_year")
def a02(spark, sf):
    held = cast_to(contract(spark, sf), POINTS)
    return held.select("lon", "lat", F.col("h_elv").cast("double").alias("h_elv"), "beam", F.col("tide_ocean").cast("double").alias("tide_ocean"), "t_year")


@query("A03_point_sink", with_pts("SELECT count(*) AS n, sum(dac::DOUBLE) AS dac_sum, count(DISTINCT lon) AS n_lon FROM c", CONTRACT_SQL), floats="dac_sum", digits=3)
def a03(spark, sf):
    back = spark.read.schema(POINTS).parquet(stored_points(spark, sf))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dac").cast("double")).alias("dac_sum"), F.count_distinct("lon").alias("n_lon"))


@query("A04_pruned_scan", "SELECT l_returnflag, avg(l_discount::FLOAT::DOUBLE) AS mean_discount, count(*) AS n FROM lineitem GROUP BY l_returnflag", floats="mean_discount")
def a04(spark, sf):
    df = src.read_columns(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_discount", "not_there"], narrow=True)
    return df.groupBy("l_returnflag").agg(F.avg(F.col("l_discount").cast("double")).alias("mean_discount"), F.count(F.lit(1)).alias("n"))


@query(
    "A06_consolidate",
    with_pts("SELECT beam, count(*) AS n, avg(h) AS h_mean FROM p WHERE rflag <> 'R' AND disc <= 0.08E0 AND lon BETWEEN -114.0 AND -98.0 AND lat BETWEEN -77.0 AND -73.5 GROUP BY beam", f"p AS (SELECT *, {LONLAT} FROM pts)"),
    floats="h_mean",
)
def a06(spark, sf):
    """Flags and points are two projections of the files, paired again by file and row position."""
    raw = src.with_position(table(spark, sf, "lineitem"))
    flags = raw.select("file", "row", (F.col("l_returnflag") == "R").cast("int").alias("atl06_quality_summary"), F.col("l_discount").alias("spread"))
    pts = lonlat(points(spark, sf))
    pts = src.with_position(table(spark, sf, "lineitem")).select("file", "row", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pa"),
        F.col("l_partkey").alias("pb"), F.col("l_suppkey").alias("pc"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("pd")).join(pts, ["pa", "pb", "pc", "pd"])
    keep = (F.col("atl06_quality_summary") == 0) & (F.col("spread") <= 0.08)
    held = src.positional_flags(pts, flags, keep).where(F.col("lon").between(-114.0, -98.0) & F.col("lat").between(-77.0, -73.5))
    return held.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h_mean"))


@query(
    "A07_exclusion_audit",
    with_pts("SELECT granule AS file, count(*) AS n_before, count(*) FILTER (x < 60000 AND y < 60000) AS n_after, 100.0E0*count(*) FILTER (x < 60000 AND y < 60000)/count(*) AS pct_kept, count(*) FILTER (x < 60000 AND y < 60000) = 0 AS excluded FROM pts GROUP BY granule"),
    floats="pct_kept",
)
def a07(spark, sf):
    return src.exclusion_audit(points(spark, sf).withColumn("file", F.col("granule")), (F.col("x") < 60000) & (F.col("y") < 60000))


@query("A08_granule_difference", "SELECT o_orderkey AS granule FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def a08(spark, sf):
    listed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("granule"))
    gone = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("granule"))
    return src.pending(listed, gone, "granule")


NAME_SQL = "n AS (SELECT l_shipdate, CASE WHEN l_orderkey%37=0 THEN 'bad.h5' ELSE 'ATL06_' || strftime(l_shipdate, '%Y%m%d') || '1230' || CASE WHEN l_linenumber=7 THEN '60' ELSE '15' END || '_0001.h5' END AS name FROM lineitem)"


def granule_names(spark, sf):
    stamp = F.date_format("l_shipdate", "yyyyMMdd")
    name = F.when(F.col("l_orderkey") % 37 == 0, "bad.h5").otherwise(
        F.concat(F.lit("ATL06_"), stamp, F.lit("1230"), F.when(F.col("l_linenumber") == 7, "60").otherwise("15"), F.lit("_0001.h5"))
    )
    return table(spark, sf, "lineitem").select(name.alias("name"))


@query("A09_season_filter", f"WITH {NAME_SQL} SELECT month(l_shipdate)::INT AS month, count(*) AS n FROM n WHERE name <> 'bad.h5' AND month(l_shipdate) IN (6,7,8) GROUP BY 1")
def a09(spark, sf):
    held = granule_names(spark, sf).where(src.in_months(F.col("name"), [6, 7, 8]))
    return held.groupBy(src.granule_month(F.col("name")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("A10_granule_time", f"WITH {NAME_SQL} SELECT CASE WHEN name <> 'bad.h5' THEN date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 12 HOUR + INTERVAL 30 MINUTE + CASE WHEN substr(name, 19, 2)='60' THEN INTERVAL 59 SECOND ELSE INTERVAL 15 SECOND END END AS ts, count(*) AS n FROM n GROUP BY 1")
def a10(spark, sf):
    return granule_names(spark, sf).groupBy(src.granule_time(F.col("name")).cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A11_line_epoch",
    """SELECT epoch, count(*) AS n FROM (SELECT CASE l_linenumber%4 WHEN 0 THEN year(l_shipdate)+(month(l_shipdate)-0.5E0)/12
       WHEN 1 THEN year(l_shipdate)+(quarter(l_shipdate)-0.5E0)/4 WHEN 2 THEN year(l_shipdate)+0.5E0 END AS epoch FROM lineitem) GROUP BY epoch""",
    floats="epoch",
)
def a11(spark, sf):
    y, k = F.date_format("l_shipdate", "yyyy"), F.col("l_linenumber") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("line_"), F.date_format("l_shipdate", "yyyyMM"), F.lit(".gpkg")))
        .when(k == 1, F.concat(F.lit("line_"), y, F.lit("Q"), F.quarter("l_shipdate"), F.lit(".gpkg")))
        .when(k == 2, F.concat(F.lit("line_"), y, F.lit(".gpkg")))
        .otherwise("line.gpkg")
    )
    return table(spark, sf, "lineitem").select(F.round(src.line_epoch(name), 6).alias("epoch")).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


SEG_SQL = """seg AS (SELECT CASE WHEN granule%41=0 THEN 3.5E38 WHEN granule%43=0 THEN -999.0E0 ELSE h END AS h_li,
  CASE WHEN granule%47=0 THEN NULL ELSE -77.5E0+y*4.5E-5 END AS latitude, -115.0E0+x*2.0E-4 AS longitude, s_elv AS h_li_sigma,
  (t_year-2018.0E0)*31557600.0E0 AS delta_time, CASE WHEN rflag='R' AND beam=1 THEN 2 WHEN rflag='R' THEN 1 ELSE 0 END AS q, beam,
  CASE WHEN pb%31=0 THEN 3.4E38 ELSE disc END AS tide FROM pts)"""


def raw_segments(spark, sf):
    g = F.col("granule")
    beam = F.element_at(F.array(*[F.lit(b) for b in (*src.BEAMS, "gt9x")]), F.col("beam"))
    return points(spark, sf).select(
        F.when(g % 41 == 0, F.lit(3.5e38)).when(g % 43 == 0, F.lit(-999.0)).otherwise(F.col("h")).alias("h_li"),
        F.when(g % 47 == 0, F.lit(float("nan"))).otherwise(F.lit(-77.5) + F.col("y") * 4.5e-5).alias("latitude"),
        (F.lit(-115.0) + F.col("x") * 2.0e-4).alias("longitude"), F.col("s_elv").alias("h_li_sigma"),
        ((F.col("t_year") - 2018.0) * 31557600.0).alias("delta_time"),
        F.when((F.col("rflag") == "R") & (F.col("beam") == 1), 2).when(F.col("rflag") == "R", 1).otherwise(0).alias("atl06_quality_summary"),
        beam.alias("beam_name"), F.when(F.col("pb") % 31 == 0, F.lit(3.4e38)).otherwise(F.col("disc")).alias("tide_ocean"),
        F.col("disc").alias("h_robust_sprd"),
    )


VALID_SQL = "q <= 1 AND h_li < 3E30 AND h_li > -500 AND latitude IS NOT NULL"


@query(
    "A12_normalise_segments",
    with_pts(f"SELECT CASE WHEN beam<=6 THEN beam::TINYINT END AS beam, count(*) AS n, count(*) FILTER (tide < 1E30) AS n_tide, count(*) - count(*) AS n_dac, avg(2018.0E0+delta_time/31557600.0E0) AS t_mean, avg(h_li::FLOAT::DOUBLE) AS h_mean FROM seg WHERE {VALID_SQL} GROUP BY 1", SEG_SQL),
    floats="t_mean h_mean", digits=5,
)
def a12(spark, sf):
    d = src.normalise_segments(raw_segments(spark, sf))
    return d.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.count("tide_ocean").alias("n_tide"), F.count("dac").alias("n_dac"),
                                 F.avg("t_year").alias("t_mean"), F.avg(F.col("h_elv").cast("double")).alias("h_mean"))


@query(
    "A13_segment_flags",
    with_pts(
        "SELECT q AS atl06_quality_summary, count(*) AS n, avg(disc) AS spread, 0::BIGINT AS n_snr FROM seg2 WHERE q <= 1 AND ok GROUP BY 1",
        """seg2 AS (SELECT granule%41<>0 AND granule%43<>0 AND granule%47<>0 AS ok, disc,
          CASE WHEN rflag='R' AND beam=1 THEN 2 WHEN rflag='R' THEN 1 ELSE 0 END AS q FROM pts)""",
    ),
    floats="spread",
)
def a13(spark, sf):
    """Flags ride in the row of their segment, so the same filter keeps both aligned."""
    d = src.normalise_segments(raw_segments(spark, sf), flags=["atl06_quality_summary", "h_robust_sprd", "snr"])
    return d.groupBy("atl06_quality_summary").agg(F.count(F.lit(1)).alias("n"), F.avg("h_robust_sprd").alias("spread"), F.count("snr").alias("n_snr"))


@query(
    "A14_monthly_grid",
    with_pts("""SELECT ci, cj, "year", "month", ssha FROM (SELECT floor(x/10000)::BIGINT AS ci, floor(y/10000)::BIGINT AS cj, "year", "month", CASE WHEN count(*)%5=0 THEN NULL ELSE avg(disc) END AS ssha FROM pts GROUP BY ALL)
       WHERE ssha IS NOT NULL AND (ci+0.5E0)*1E4 BETWEEN 15000 AND 75000 AND (cj+0.5E0)*1E4 BETWEEN 5000 AND 95000"""),
    floats="ssha",
)
def a14(spark, sf):
    g = points(spark, sf).groupBy(spatial.cell("x", 10000).alias("ci"), spatial.cell("y", 10000).alias("cj"), "year", "month").agg(
        F.when(F.count(F.lit(1)) % 5 == 0, F.lit(3.4e38)).otherwise(F.avg("disc")).alias("ssha"))
    g = g.withColumn("lon", (F.col("ci") + 0.5) * 1e4).withColumn("lat", (F.col("cj") + 0.5) * 1e4)
    return fields.monthly_long(g, {"lon_min": 15000, "lon_max": 75000, "lat_min": 5000, "lat_max": 95000}).select("ci", "cj", "year", "month", "ssha")


@query(
    "A15_union_groups",
    with_pts("SELECT CASE rflag WHEN 'A' THEN 'Point_F' WHEN 'N' THEN 'Point_H' ELSE 'Point_Ib' END AS feature_type, count(*) AS n, count(CASE WHEN rflag<>'R' THEN disc END) AS n_range FROM pts WHERE x BETWEEN 10000 AND 90000 GROUP BY 1"),
)
def a15(spark, sf):
    p = points(spark, sf).where(F.col("x").between(10000, 90000))
    pick = lambda f, *more: p.where(F.col("rflag") == f).select("x", "y", *more)
    tide = F.col("disc").alias("tide_range")
    u = src.union_groups({"Point_F": pick("A", tide), "Point_H": pick("N", tide), "Point_Ib": pick("R")})
    return u.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n"), F.count("tide_range").alias("n_range"))


def mooring_rows(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    return e.select(
        F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.when(F.col("event_id") % 50 == 0, "-9999").otherwise((v - 20.0).cast("string")).alias("u_cm_s"),
        (F.col("user_id") % 17 - 8.0).cast("string").alias("v_cm_s"),
        F.when(F.col("event_id") % 31 == 0, "n/a").otherwise((F.lit(-1.5) + v * 0.01).cast("string")).alias("temperature_c"),
        (F.lit(27.0) + F.col("user_id") % 10 * 0.2).cast("string").alias("conductivity_ms_cm"),
    )


# Salinity, freezing point and what follows from them, in SQL.
PSS_SQL = """rr AS (SELECT *, c/42.9140E0 AS r, 0.6766097E0+2.00564E-2*t+1.104259E-4*t*t-6.9698E-7*t*t*t+1.0031E-9*t*t*t*t AS rt,
   1+521.3E0*(2.070E-5+521.3E0*(-6.370E-10+3.989E-15*521.3E0))/(1+3.426E-2*t+4.464E-4*t*t+(4.215E-1-3.107E-3*t)*(c/42.9140E0)) AS rp FROM m),
 q AS (SELECT *, sqrt(greatest(r/(rp*rt),0.0E0)) AS z FROM rr),
 sal AS (SELECT *, 0.0080E0+z*(-0.1692E0+z*(25.3851E0+z*(14.0941E0+z*(-7.0261E0+z*2.7081E0))))
   +((t-15)/(1+0.0162E0*(t-15)))*(0.0005E0+z*(-0.0056E0+z*(-0.0066E0+z*(-0.0375E0+z*(0.0636E0+z*(-0.0144E0)))))) AS salinity FROM q),
 frz AS (SELECT *, -0.0575E0*salinity+1.710523E-3*pow(greatest(salinity,0.0E0),1.5E0)-2.154996E-4*521.3E0 AS freezing FROM sal)"""
MOORING_SQL = """raw AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS tm, CASE WHEN event_id%50=0 THEN NULL ELSE value-20.0E0 END AS u, (user_id%17-8.0E0)::DOUBLE AS v,
   CASE WHEN event_id%31=0 THEN NULL ELSE -1.5E0+value*0.01E0 END AS t, 27.0E0+(user_id%10)*0.2E0 AS c FROM events),
 ok AS (SELECT * FROM raw WHERE u BETWEEN -200 AND 200 AND v BETWEEN -200 AND 200 AND t BETWEEN -3 AND 5 AND c BETWEEN 5 AND 70),
 m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tm ORDER BY u,v,t,c) AS k FROM ok) WHERE k=1)"""


@query(
    "A16_mooring",
    f"""WITH {MOORING_SQL}, {PSS_SQL} SELECT tm AS "time", u AS u_cm_s, v AS v_cm_s, t AS temperature_c, c AS conductivity_ms_cm, sqrt(u*u+v*v) AS speed_cm_s,
      (degrees(atan2(u,v))+360.0E0)%360.0E0 AS direction_deg, salinity, freezing AS freezing_c, t-freezing AS thermal_driving, sqrt(u*u+v*v)/100*(t-freezing) AS heat_proxy FROM frz""",
    floats="u_cm_s v_cm_s temperature_c conductivity_ms_cm speed_cm_s direction_deg salinity freezing_c thermal_driving heat_proxy",
)
def a16(spark, sf):
    """Read from tab-separated files that Spark has written from the events."""
    path = scratch(spark, "mooring")
    titles = {"time": "Timestamp (UTC)", "u_cm_s": "Eastward velocity", "v_cm_s": "Northward velocity", "temperature_c": "Temperature", "conductivity_ms_cm": "Conductivity"}
    mooring_rows(spark, sf).withColumnsRenamed(titles).write.option("sep", "\t").option("header", "true").csv(path)
    d = fields.clean_mooring(fields.read_mooring(spark, path))
    return d.withColumn("time", F.col("time").cast("timestamp_ntz"))


CELLS_YEAR_SQL = 'cy AS (SELECT floor(x/5000)::BIGINT AS cell_i, floor(y/5000)::BIGINT AS cell_j, "year", avg(h) AS v FROM pts GROUP BY ALL)'


def cells_by_year(spark, sf, size=5000):
    return points(spark, sf).groupBy(spatial.cell("x", size).alias("cell_i"), spatial.cell("y", size).alias("cell_j"), "year").agg(F.avg("h").alias("v"))


@query(
    "A17_field_crop",
    with_pts('SELECT "year", count(*) AS n, sum(v) AS total FROM cy WHERE (cell_i+0.5E0)*5000 BETWEEN 20000 AND 70000 AND (cell_j+0.5E0)*5000 BETWEEN 20000 AND 70000 AND "year" >= 1998 GROUP BY "year"', CELLS_YEAR_SQL),
    floats="total",
)
def a17(spark, sf):
    f = cells_by_year(spark, sf).withColumn("x", (F.col("cell_i") + 0.5) * 5000).withColumn("y", (F.col("cell_j") + 0.5) * 5000)
    c = fields.crop_field(f, (30000, 60000, 30000, 60000), buffer_m=10000, year_start=1998, time="year")
    return c.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(
    "A18_colatitude_table",
    with_pts("SELECT count(DISTINCT cj) AS n_a, count(DISTINCT ci) AS n_b, count(*) AS n, count(*)=count(DISTINCT cj)*count(DISTINCT ci) AS complete, sum(r)/1000 AS vlm_sum FROM (SELECT floor(x/20000)::BIGINT ci, floor(y/20000)::BIGINT cj, round(avg(disc)*100, 4) AS r FROM pts GROUP BY ALL)"),
    floats="vlm_sum",
)
def a18(spark, sf):
    g = points(spark, sf).groupBy(spatial.cell("x", 20000).alias("ci"), spatial.cell("y", 20000).alias("cj")).agg(F.round(F.avg("disc") * 100, 4).alias("r"))
    text = g.select(F.concat_ws("  ", "cj", "ci", "r", F.lit("0.5")).alias("value")).unionByName(g.select(F.lit("% comment").alias("value")))
    t = fields.colatitude_table(text)
    return fields.grid_is_complete(t).crossJoin(t.agg(F.sum("vlm").alias("vlm_sum")))


@query(
    "A19_mosaic",
    with_pts('SELECT cell_i, cell_j, arg_max(v, "year") AS v FROM cy GROUP BY cell_i, cell_j', CELLS_YEAR_SQL), floats="v",
)
def a19(spark, sf):
    return fields.mosaic(cells_by_year(spark, sf), ["cell_i", "cell_j"], "year", ["v"])


HALO_SQL = """act AS (SELECT DISTINCT floor(x/50000)::BIGINT AS tile_i, floor(y/50000)::BIGINT AS tile_j FROM pts),
 halo AS (SELECT act.*, pts.*, floor(x/50000)::BIGINT=tile_i AND floor(y/50000)::BIGINT=tile_j AS is_core FROM pts JOIN act ON
   x >= tile_i*50000-15000 AND x < (tile_i+1)*50000+15000 AND y >= tile_j*50000-15000 AND y < (tile_j+1)*50000+15000)"""


@query(
    "A20_tiles_manifest",
    with_pts("SELECT tile_i, tile_j, count(*) FILTER (is_core) AS n_core, count(*) AS n_with_halo, tile_i*50000.0E0 AS x_min, tile_j*50000.0E0 AS y_min FROM halo GROUP BY tile_i, tile_j", HALO_SQL),
)
def a20(spark, sf):
    path = scratch(spark, "tiles")
    src.write_tiles(spatial.halo_tiles(points(spark, sf), 50000, 15000), path)
    back = spark.read.parquet(path)
    man = spatial.tile_manifest(back, 50000)
    return man.withColumn("tile_i", F.col("tile_i").cast("bigint")).withColumn("tile_j", F.col("tile_j").cast("bigint"))


_MIXED = "+".join(f"(({c}::BIGINT*{k % src.HASH_PRIME})%{src.HASH_PRIME})*{(k >> 7) % src.HASH_PRIME}" for c, k in zip(("pa", "pb", "pc", "pd"), src.HASH_STEPS))


@query("A21_bernoulli_scan", with_pts(f"SELECT pa, x, y FROM (SELECT *, (7+{_MIXED})%{src.HASH_PRIME} AS mixed, count(*) OVER () AS total FROM pts) WHERE mixed < least(1.0E0, 500.0E0/total)*{src.HASH_PRIME}"))
def a21(spark, sf):
    p = points(spark, sf).select("pa", "pb", "pc", "pd", "x", "y")
    return src.bernoulli(p, 500, p.count(), ["pa", "pb", "pc", "pd"], seed=7).select("pa", "x", "y")


@query("A22_result_sinks", with_pts("SELECT beam::BIGINT AS beam, count(*) AS n, avg(h) AS h_mean, f AS fmt FROM pts, (VALUES ('csv'),('json'),('parquet')) AS v(f) GROUP BY beam, f"), floats="h_mean")
def a22(spark, sf):
    stats = points(spark, sf).groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h_mean"))
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch(spark, f"stats-{fmt}")
        src.write_result(stats, path, fmt)
        reader = spark.read.schema("beam bigint, n bigint, h_mean double") if fmt != "parquet" else spark.read
        back = (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)
        back = back.select(F.col("beam").cast("bigint").alias("beam"), "n", "h_mean", F.lit(fmt).alias("fmt"))
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "A23_unfinished_tiles",
    with_pts("SELECT DISTINCT floor(x/10000)::BIGINT AS tile_i, floor(y/10000)::BIGINT AS tile_j FROM pts EXCEPT SELECT DISTINCT floor(x/10000)::BIGINT, floor(y/10000)::BIGINT FROM pts WHERE granule%211=0"),
)
def a23(spark, sf):
    p = points(spark, sf).withColumn("tile_i", spatial.cell("x", 10000)).withColumn("tile_j", spatial.cell("y", 10000))
    return src.unfinished(p.select("tile_i", "tile_j").distinct(), p.where(F.col("granule") % 211 == 0), ["tile_i", "tile_j"])


