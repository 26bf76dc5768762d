"""Queries over joins (C) and the spatial parts of B, D and J."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cryoframe.functions.predicates import dem_residual
from cryoframe.operators import crossings, rates, spatial
from cryoframe.operators.skew import group_median_mad, group_quantiles
from cryoframe.plans.base import IDS, points, query, table, tile_nodes_sql, with_pts
from cryoframe.plans.q_predicates import WIN_SQL
from cryoframe.plans.q_sources import HALO_SQL

ID = "pa, pb, pc, pd"


def nodes(spark, sf, tile=50000.0, step=5000.0):
    return spatial.lattice(points(spark, sf), tile, step)


@query(
    "C01_radius_join",
    with_pts("SELECT node_x, node_y, count(*) AS n, avg(h) AS h_mean FROM pts JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 15000.0E0*15000.0E0 GROUP BY node_x, node_y", tile_nodes_sql(50000, 5000)),
    floats="h_mean",
)
def c01(spark, sf):
    """1.5 million pairs at the small scale, none of them made by a nested loop."""
    pairs = spatial.radius_join(points(spark, sf).select("x", "y", "h"), nodes(spark, sf).select("node_x", "node_y"), 15000.0)
    return pairs.groupBy("node_x", "node_y").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h_mean"))


CENT_SQL = "cen AS (SELECT floor(x/5000)::BIGINT AS ci, floor(y/5000)::BIGINT AS cj, avg(x) AS cx, avg(y) AS cy, avg(disc) AS v FROM pts GROUP BY 1, 2)"


def centroids(spark, sf):
    """One source per 5 km cell at the mean position of its points."""
    g = points(spark, sf).groupBy(spatial.cell("x", 5000).alias("ci"), spatial.cell("y", 5000).alias("cj"))
    return g.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("disc").alias("v"))


@query(
    "C02_k_nearest",
    with_pts("SELECT node_x, node_y, rank, ci, cj, d2/1E6 AS d2 FROM (SELECT node_x, node_y, ci, cj, (node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy) AS d2, row_number() OVER (PARTITION BY node_x, node_y ORDER BY (node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy), ci, cj)::INT AS rank FROM nodes, cen) WHERE rank <= 8", tile_nodes_sql(50000, 5000), CENT_SQL),
    floats="d2",
)
def c02(spark, sf):
    src = centroids(spark, sf).select("ci", "cj", F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    near = spatial.knn_join(nodes(spark, sf).select("node_x", "node_y"), src, 8, target_id=["node_x", "node_y"], source_id=["ci", "cj"], txy=("node_x", "node_y"), base=2500.0)
    return near.select("node_x", "node_y", "rank", "ci", "cj", (F.col("d2") / 1e6).alias("d2"))


@query(
    "C03_nearest_cutoff",
    with_pts("SELECT ci, cj, count(*) AS n, avg(dist) AS dist FROM (SELECT pts.*, ci, cj, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS dist, row_number() OVER (PARTITION BY pa,pb,pc,pd ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy), ci, cj) AS k FROM pts JOIN cen ON abs(x-cx)<=2000 AND abs(y-cy)<=2000 AND (x-cx)*(x-cx)+(y-cy)*(y-cy)<=4000000) WHERE k=1 GROUP BY ci, cj", CENT_SQL),
    floats="dist", digits=5,
)
def c03(spark, sf):
    src = centroids(spark, sf).select("ci", "cj", F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    near = spatial.nearest_join(points(spark, sf).select(*IDS, "x", "y"), src, target_id=IDS, source_id=["ci", "cj"], base=2500.0, max_distance=2000.0)
    return near.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("dist"))


# Tracks: a supplier is a satellite pass, its points lie on a line that climbs or falls with time.
TRACK_SQL = """tr AS (SELECT pc AS track_id, pa, pb, pd, beam, h, disc,
   row_number() OVER (PARTITION BY pc ORDER BY t_year, pa, pb, pd)-1 AS place, count(*) OVER (PARTITION BY pc) AS m, t_year FROM pts),
 trk AS (SELECT track_id, pa, pb, pd, beam, h, t_year, place, CASE WHEN track_id%2=0 THEN place*50.0E0 ELSE (m-1-place)*50.0E0 END AS y,
   (track_id*37)%101*250.0E0 + place*11.0E0 + (pb%7-3)*20.0E0 AS x FROM tr)"""


def tracks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("pc")
    p = points(spark, sf).withColumn("place", F.row_number().over(w.orderBy("t_year", "pa", "pb", "pd")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    up = F.col("pc") % 2 == 0
    return p.select(
        F.col("pc").alias("track_id"), "pa", "pb", "pd", "beam", "h", "t_year", "place",
        F.when(up, F.col("place") * 50.0).otherwise((F.col("m") - 1 - F.col("place")) * 50.0).alias("y"),
        (F.pmod(F.col("pc") * 37, F.lit(101)) * 250.0 + F.col("place") * 11.0 + (F.col("pb") % 7 - 3) * 20.0).alias("x"),
    )


CROSS_SQL = """dirs AS (SELECT track_id, arg_max(y, (t_year,pa,pb,pd)) > arg_min(y, (t_year,pa,pb,pd)) AS up, count(*) AS n_pts FROM trk GROUP BY track_id),
 vx AS (SELECT * FROM trk WHERE place % 10 = 0),
 sg AS (SELECT a.track_id, a.place AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, up FROM vx a JOIN vx b ON a.track_id=b.track_id AND b.place=a.place+10 JOIN dirs d ON d.track_id=a.track_id WHERE n_pts>=50),
 cr0 AS (SELECT a.track_id AS track1, d.track_id AS track2, a.seg AS seg1, d.seg AS seg2, a.x1, a.y1, a.x2-a.x1 AS rx, a.y2-a.y1 AS ry, d.x2-d.x1 AS sx, d.y2-d.y1 AS sy, d.x1-a.x1 AS qx, d.y1-a.y1 AS qy
   FROM sg a JOIN sg d ON a.up AND NOT d.up AND a.y1<=greatest(d.y1,d.y2) AND a.y2>=least(d.y1,d.y2)),
 cr AS (SELECT track1, track2, seg1, seg2, x1+tt*rx AS x, y1+tt*ry AS y FROM (SELECT *, (qx*sy-qy*sx)/(rx*sy-ry*sx) AS tt, (qx*ry-qy*rx)/(rx*sy-ry*sx) AS uu FROM cr0 WHERE rx*sy-ry*sx<>0) WHERE tt>=0 AND tt<1 AND uu>=0 AND uu<1),
 sd AS (SELECT cr.*, 1 AS side, track1 AS tk FROM cr UNION ALL SELECT cr.*, 2, track2 FROM cr),
 nb AS (SELECT sd.track1, sd.track2, sd.seg1, sd.seg2, sd.x, sd.y, side, (p.x-sd.x)/200 AS u, (p.y-sd.y)/200 AS v, p.h, p.t_year, p.beam FROM sd JOIN trk p ON p.track_id=tk AND p.y BETWEEN sd.y-200 AND sd.y+200 AND (p.x-sd.x)*(p.x-sd.x)+(p.y-sd.y)*(p.y-sd.y)<=40000),
 mm AS (SELECT track1, track2, seg1, seg2, x, y, side, count(*) AS n, avg(h) AS mh, avg(u) AS mu, avg(v) AS mv, var_pop(u)*count(*) AS a, var_pop(v)*count(*) AS d, covar_pop(u,v)*count(*) AS o, covar_pop(u,h)*count(*) AS p, covar_pop(v,h)*count(*) AS q, var_pop(h)*count(*) AS r,
   median(t_year) AS t, floor(median(beam))::INT AS beam FROM nb GROUP BY ALL HAVING count(*)>=4),
 ft AS (SELECT *, (p*d-q*o)/(a*d-o*o) AS bb, (q*a-p*o)/(a*d-o*o) AS cc FROM mm WHERE a>0 AND d>0 AND a*d-o*o > 1E-10*a*d),
 fs AS (SELECT *, mh-bb*mu-cc*mv AS hh, greatest(r-bb*p-cc*q,0)/greatest(n-3,1)*(1.0E0/n+(mu*mu*d-2*mu*mv*o+mv*mv*a)/(a*d-o*o)) AS vv FROM ft),
 xo AS (SELECT s1.x, s1.y, s1.t AS t1, s2.t AS t2, s2.t-s1.t AS dt, s1.hh AS h1, s2.hh AS h2, s2.hh-s1.hh AS dh, sqrt(s1.vv+s2.vv) AS dh_err,
   CASE WHEN abs(s2.t-s1.t)>=0.5E0 AND abs((s2.hh-s1.hh)/(s2.t-s1.t))<=20 THEN (s2.hh-s1.hh)/(s2.t-s1.t) END AS dhdt, CASE WHEN abs(s2.t-s1.t)>=0.5E0 THEN sqrt(s1.vv+s2.vv)/abs(s2.t-s1.t) END AS dhdt_err,
   s1.beam AS beam1, s2.beam AS beam2, s1.track1, s1.track2, s1.n AS n1, s2.n AS n2 FROM fs s1 JOIN fs s2 USING (track1, track2, seg1, seg2) WHERE s1.side=1 AND s2.side=2)"""


def crossing_table(spark, sf, rows=None, **kw):
    return crossings.find_crossings(tracks(spark, sf) if rows is None else rows, ties=["pa", "pb", "pd"], position="place", **kw)


def crossing_sql(subsample: int, start: int) -> str:
    """The same chain for another step and first vertex, inside one table of its own."""
    chain = CROSS_SQL.replace("place % 10 = 0", f"place >= {start} AND (place-{start}) % {subsample} = 0").replace("a.place+10 ", f"a.place+{subsample} ")
    return f"xo_{subsample}_{start} AS (WITH {chain} SELECT * FROM xo)"


@query("C04_track_crossings", with_pts("SELECT * FROM xo", TRACK_SQL, CROSS_SQL), floats="x y t1 t2 dt h1 h2 dh dh_err dhdt dhdt_err", digits=4)
def c04(spark, sf):
    return crossing_table(spark, sf)


EPOCH_SQL = """ep AS (SELECT DISTINCT mask_class AS shelf, "year"+(("month"-1)//3)/4.0E0 AS epoch FROM pts WHERE granule%5=0 AND "month"<>5)"""


@query(
    "C05_nearest_epoch",
    with_pts("SELECT shelf, epoch, count(*) AS n, avg(gap) AS gap FROM (SELECT mask_class AS shelf, epoch, abs(t_year-epoch) AS gap, row_number() OVER (PARTITION BY pa,pb,pc,pd ORDER BY round(abs(t_year-epoch),9), epoch) AS k FROM pts JOIN ep ON shelf=mask_class) WHERE k=1 GROUP BY shelf, epoch", EPOCH_SQL),
    floats="epoch gap",
)
def c05(spark, sf):
    p = points(spark, sf).withColumn("shelf", F.col("mask_class"))
    epochs = p.where((F.col("granule") % 5 == 0) & (F.col("month") != 5)).select("shelf", (F.col("year") + F.floor((F.col("month") - 1) / 3) / 4.0).alias("epoch")).distinct()
    j = spatial.nearest_epoch(p.select("shelf", "t_year"), epochs, time="t_year", epoch="epoch", by=["shelf"])
    return j.groupBy("shelf", "epoch").agg(F.count(F.lit(1)).alias("n"), F.avg("epoch_gap").alias("gap"))


@query("C06_coverage", with_pts("SELECT node_x, node_y FROM nodes WHERE EXISTS (SELECT 1 FROM cen WHERE v>0.055E0 AND (node_x-cx)*(node_x-cx)+(node_y-cy)*(node_y-cy)<=7500.0E0*7500)", tile_nodes_sql(50000, 5000), CENT_SQL))
def c06(spark, sf):
    good = centroids(spark, sf).where(F.col("v") > 0.055)
    return spatial.radius_join(nodes(spark, sf).select("node_x", "node_y"), good, 7500.0, xy=("node_x", "node_y"), node_xy=("cx", "cy"), how="left_semi")


SEASON_SQL = """se AS (SELECT floor(x/5000)::BIGINT AS cell_x, floor(y/5000)::BIGINT AS cell_y, avg(CASE WHEN "month" IN (6,7,8) THEN h END) AS jja, avg(CASE WHEN "month" IN (12,1,2) THEN h END) AS djf FROM pts GROUP BY 1,2)"""


def season_cells(spark, sf, months, name):
    g = points(spark, sf).where(F.col("month").isin(months)).groupBy(spatial.cell("x", 5000).alias("cell_x"), spatial.cell("y", 5000).alias("cell_y"))
    return g.agg(F.avg("h").alias(name))


@query("C07_season_pairing", with_pts("SELECT cell_x, cell_y, jja, djf, jja-djf AS diff FROM se WHERE jja IS NOT NULL AND djf IS NOT NULL", SEASON_SQL), floats="jja djf diff")
def c07(spark, sf):
    return season_cells(spark, sf, [6, 7, 8], "jja").join(season_cells(spark, sf, [12, 1, 2], "djf"), ["cell_x", "cell_y"]).withColumn("diff", F.col("jja") - F.col("djf"))


@query("C08_left_join", with_pts("SELECT cell_x, cell_y, jja, b.strong FROM se LEFT JOIN (SELECT floor(x/5000)::BIGINT AS cx, floor(y/5000)::BIGINT AS cy, count(*) AS strong FROM pts WHERE beam=1 AND \"month\"=6 GROUP BY 1,2) b ON cell_x=cx AND cell_y=cy WHERE jja IS NOT NULL", SEASON_SQL), floats="jja")
def c08(spark, sf):
    strong = points(spark, sf).where((F.col("beam") == 1) & (F.col("month") == 6)).groupBy(spatial.cell("x", 5000).alias("cell_x"), spatial.cell("y", 5000).alias("cell_y")).agg(F.count(F.lit(1)).alias("strong"))
    return season_cells(spark, sf, [6, 7, 8], "jja").join(strong, ["cell_x", "cell_y"], "left")


@query("C09_positional_join", "SELECT l_returnflag, count(*) AS n, sum(l_quantity*l_tax) AS v, true AS paired FROM lineitem GROUP BY l_returnflag", floats="v")
def c09(spark, sf):
    from cryoframe.sources.points import positional_flags, with_position

    a = with_position(table(spark, sf, "lineitem"))
    left, right = a.select("file", "row", "l_quantity", "l_returnflag"), a.select("file", "row", "l_tax")
    held = positional_flags(left, right, F.lit(True)).join(right, ["file", "row"])
    return held.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity") * F.col("l_tax")).alias("v"), F.bool_and("paired").alias("paired"))


FIELD_SQL = "fld AS (SELECT floor(x/5000)::BIGINT AS cell_i, floor(y/5000)::BIGINT AS cell_j, avg(disc) AS v, avg(tax) AS w FROM pts GROUP BY 1,2)"


def field(spark, sf, size=5000):
    return points(spark, sf).groupBy(spatial.cell("x", size).alias("cell_i"), spatial.cell("y", size).alias("cell_j")).agg(F.avg("disc").alias("v"), F.avg("tax").alias("w"))


@query(
    "C10_nearest_cell",
    with_pts("SELECT beam, sum(f.v) AS v_sum, count(g.v) AS n_inside, sum(g.w) AS w_sum FROM pts LEFT JOIN fld f ON f.cell_i=least(greatest(round_even((x-22500.0E0)/5000,0)::BIGINT+4,4),15) AND f.cell_j=least(greatest(round_even((y-22500.0E0)/5000,0)::BIGINT+4,4),15) LEFT JOIN (SELECT * FROM fld WHERE cell_i BETWEEN 4 AND 15 AND cell_j BETWEEN 4 AND 15) g ON g.cell_i=round_even((x-22500.0E0)/5000,0)::BIGINT+4 AND g.cell_j=round_even((y-22500.0E0)/5000,0)::BIGINT+4 GROUP BY beam", FIELD_SQL),
    floats="v_sum w_sum",
)
def c10(spark, sf):
    """Clipped to the edge of a sub-grid, and beside it null outside."""
    f = field(spark, sf)
    o = (2500.0, 2500.0)
    p = points(spark, sf).select("beam", "x", "y")
    p = spatial.sample_cells(p, f.select("cell_i", "cell_j", "v"), origin=o, step=5000.0, values=["v"], clip=(4, 15, 4, 15))
    inner = f.where(F.col("cell_i").between(4, 15) & F.col("cell_j").between(4, 15)).select("cell_i", "cell_j", F.col("v").alias("vi"), "w")
    p = spatial.sample_cells(p, inner, origin=o, step=5000.0, values=["vi", "w"])
    return p.groupBy("beam").agg(F.sum("v").alias("v_sum"), F.count("vi").alias("n_inside"), F.sum("w").alias("w_sum"))


BILIN_SQL = """bl AS (SELECT pa,pb,pc,pd, beam, h, floor((x-2500)/5000)::BIGINT AS i, floor((y-2500)/5000)::BIGINT AS j, (x-2500)/5000-floor((x-2500)/5000) AS fu, (y-2500)/5000-floor((y-2500)/5000) AS fv FROM pts),
 bc AS (SELECT bl.*, di, dj, CASE WHEN di=1 THEN fu ELSE 1-fu END * CASE WHEN dj=1 THEN fv ELSE 1-fv END AS wt FROM bl, (VALUES (0),(1)) a(di), (VALUES (0),(1)) b(dj)),
 bs AS (SELECT pa,pb,pc,pd, any_value(beam) AS beam, any_value(h) AS h, CASE WHEN count(*)=count(v) THEN sum(wt*v) END AS val FROM bc LEFT JOIN fld ON cell_i=i+di AND cell_j=j+dj WHERE wt>0 GROUP BY pa,pb,pc,pd)"""


@query("C11_bilinear", with_pts("SELECT beam, count(val) AS n, sum(val) AS v_sum FROM bs GROUP BY beam", FIELD_SQL, BILIN_SQL), floats="v_sum")
def c11(spark, sf):
    p = spatial.sample_bilinear(points(spark, sf).select(*IDS, "beam", "x", "y"), field(spark, sf), ids=IDS, origin=(2500.0, 2500.0), step=5000.0, value="v", out="val")
    return p.groupBy("beam").agg(F.count("val").alias("n"), F.sum("val").alias("v_sum"))


@query(
    "B22_dem_residual",
    with_pts("SELECT beam, count(r) AS n, sum(r) AS r_sum FROM (SELECT beam, CASE WHEN abs(h-val*10000)<=200 THEN h-val*10000 END AS r FROM bs) GROUP BY beam", FIELD_SQL, BILIN_SQL), floats="r_sum", digits=4,
)
def b22(spark, sf):
    p = spatial.sample_bilinear(points(spark, sf).select(*IDS, "beam", "h", "x", "y"), field(spark, sf), ids=IDS, origin=(2500.0, 2500.0), step=5000.0, value="v", out="val")
    r = dem_residual(F.col("h"), F.col("val") * 10000)
    return p.groupBy("beam").agg(F.count(r).alias("n"), F.sum(r).alias("r_sum"))


@query(
    "C12_time_bracket",
    with_pts("""SELECT beam, count(*) AS n, sum(t0) AS t0_sum, sum(w1) AS w_sum, count(*) FILTER (cl) AS n_clamped FROM (SELECT beam, greatest(least(e0, 2000.5E0), 1996.5E0) AS t0, CASE WHEN t_year<1996.5E0 OR t_year>=2000.5E0 THEN 0.0E0 ELSE t_year-e0 END AS w1, t_year<1996.5E0 OR t_year>2000.5E0 AS cl FROM (SELECT beam, t_year, floor(t_year-0.5E0)+0.5E0 AS e0 FROM pts)) GROUP BY beam"""),
    floats="t0_sum w_sum", digits=5,
)
def c12(spark, sf):
    p = points(spark, sf)
    epochs = p.where(F.col("year").between(1996, 2000)).select((F.col("year") + 0.5).alias("epoch")).distinct()
    j = spatial.bracket_times(p.select("beam", "t_year"), epochs, time="t_year")
    return j.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.sum("t0").alias("t0_sum"), F.sum("w1").alias("w_sum"), F.count_if("clamped").alias("n_clamped"))


@query("C13_node_tile", with_pts("SELECT tile_i, tile_j, count(*) AS n FROM (SELECT floor(cx/20000)::BIGINT AS tile_i, floor(cy/20000)::BIGINT AS tile_j FROM cen) GROUP BY 1,2", CENT_SQL))
def c13(spark, sf):
    tiles = points(spark, sf).select(spatial.cell("x", 20000).alias("tile_i"), spatial.cell("y", 20000).alias("tile_j")).distinct()
    c = centroids(spark, sf).withColumn("tile_i", spatial.cell("cx", 20000)).withColumn("tile_j", spatial.cell("cy", 20000))
    return c.join(tiles, ["tile_i", "tile_j"]).groupBy("tile_i", "tile_j").agg(F.count(F.lit(1)).alias("n"))


@query("C14_halo_tiles", with_pts("SELECT tile_i, tile_j, is_core, count(*) AS n, avg(h) AS h_mean FROM halo GROUP BY ALL", HALO_SQL), floats="h_mean")
def c14(spark, sf):
    t = spatial.halo_tiles(points(spark, sf), 50000, 15000)
    return t.groupBy("tile_i", "tile_j", "is_core").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h_mean"))


@query("D22_tile_counts", with_pts("SELECT tile_i, tile_j, count(*) FILTER (is_core) AS n_core, count(*) AS n_with_halo FROM halo GROUP BY ALL", HALO_SQL))
def d22(spark, sf):
    return spatial.tile_manifest(spatial.halo_tiles(points(spark, sf), 50000, 15000), 50000).select("tile_i", "tile_j", "n_core", "n_with_halo")


REF_SQL = "rf AS (SELECT place, x AS rx, y AS ry FROM trk WHERE track_id=(SELECT min(track_id) FROM trk))"


def corridor(spark, sf, width=300.0):
    """Points near the first track: nearest reference vertex, de-duplicated on position and time."""
    t = tracks(spark, sf)
    first = t.agg(F.min("track_id").alias("track_id"))
    ref = t.join(F.broadcast(first), "track_id").select("place", F.col("x").alias("sx"), F.col("y").alias("sy"))
    p = t.dropDuplicates(["x", "y", "t_year"])
    return spatial.nearest_join(
        p.select("x", "y", "t_year"), ref.withColumnRenamed("place", "ref_place"), target_id=["x", "y", "t_year"], source_id=["ref_place"], base=500.0, max_distance=width)


COR_SQL = "co AS (SELECT * FROM (SELECT x, y, t_year, place AS ref_place, sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) AS dist, row_number() OVER (PARTITION BY x,y,t_year ORDER BY (x-rx)*(x-rx)+(y-ry)*(y-ry), place) AS k FROM (SELECT DISTINCT x,y,t_year FROM trk) JOIN rf ON abs(y-ry)<=300 AND (x-rx)*(x-rx)+(y-ry)*(y-ry)<=90000) WHERE k=1)"


@query(
    "C15_corridor",
    with_pts("SELECT floor(ref_place/100)::BIGINT AS box, count(*) AS n, avg(dist) AS dist FROM co GROUP BY 1", TRACK_SQL, REF_SQL, COR_SQL),
    floats="dist", digits=4,
)
def c15(spark, sf):
    c = corridor(spark, sf)
    return c.groupBy(F.floor(F.col("ref_place") / 100).alias("box")).agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("dist"))


@query("C16_buffer_anti_join", with_pts("SELECT mask_class, count(*) AS n FROM pts p WHERE mask_class<>0 AND NOT EXISTS (SELECT 1 FROM pts q WHERE q.mask_class=0 AND q.x BETWEEN p.x-400 AND p.x+400 AND q.y BETWEEN p.y-400 AND p.y+400 AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)<160000) GROUP BY mask_class"))
def c16(spark, sf):
    p = points(spark, sf).select("x", "y", "mask_class")
    return spatial.outside_buffer(p.where(F.col("mask_class") != 0), p.where(F.col("mask_class") == 0), 400.0).groupBy("mask_class").agg(F.count(F.lit(1)).alias("n"))


GLAC_SQL = """gl AS (SELECT DISTINCT CASE p_type WHEN 'SMALL' THEN 'Pine Island North' ELSE 'Glaciér ' || p_type END AS name FROM part),
 cat AS (SELECT lower(regexp_replace(p_type,'[^A-Za-z0-9]','','g')) AS key, max(p_size)::DOUBLE AS width FROM part WHERE p_type<>'ECONOMY' GROUP BY p_type UNION ALL SELECT 'pineisland'||min(p_size), max(p_size)*10.0E0 FROM part)"""


@query(
    "C17_name_match",
    f"WITH {GLAC_SQL} SELECT name, coalesce(CASE WHEN name LIKE 'Pine%' THEN (SELECT max(width) FROM cat WHERE key LIKE 'pineisland%') END, (SELECT max(width) FROM cat WHERE contains('glacier'||lower(regexp_replace(substr(name,9),'[^A-Za-z0-9]','','g')), key) HAVING count(*)=1), 1000.0E0) AS width, coalesce(CASE WHEN name LIKE 'Pine%' THEN true END, (SELECT count(*)=1 FROM cat WHERE contains('glacier'||lower(regexp_replace(substr(name,9),'[^A-Za-z0-9]','','g')), key))) AS matched FROM gl",
)
def c17(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.when(F.col("p_type") == "SMALL", "Pine Island North").otherwise(F.concat(F.lit("Glaciér "), "p_type")).alias("name")).distinct()
    cat = part.where(F.col("p_type") != "ECONOMY").groupBy(F.col("p_type").alias("name")).agg(F.max("p_size").cast("double").alias("width"))
    cat = cat.unionByName(part.agg(F.concat(F.lit("Pine Island "), F.min("p_size").cast("string")).alias("name"), (F.max("p_size") * 10.0).alias("width")))
    return spatial.match_names(names, cat, name="name", value="width", fallback=F.lit(1000.0), families=["pineisland"])


@query("C18_node_windows", with_pts("SELECT node_x, node_y, a AS win_start, count(*) AS n FROM pts JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 10000.0E0*10000 JOIN w ON t_year>=a AND t_year<b GROUP BY ALL", tile_nodes_sql(50000, 10000), WIN_SQL))
def c18(spark, sf):
    """The neighbourhood is found once; windows fan out behind it."""
    pairs = spatial.radius_join(points(spark, sf).select("x", "y", "t_year"), nodes(spark, sf, step=10000.0).select("node_x", "node_y"), 10000.0)
    w = rates.time_windows(pairs, rates.moving_windows(3.0, 1.0, 1995.0, 2002.0))
    return w.groupBy("node_x", "node_y", "win_start").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C19_site_collocation",
    with_pts("""SELECT radius_km, count(*) AS n, median(h) AS med, quantile_cont(h, 0.1) AS p10, quantile_cont(h, 0.9) AS p90, min(d) AS nearest, (SELECT median(h) FROM (SELECT h FROM pts ORDER BY (x-sx)*(x-sx)+(y-sy)*(y-sy), pa, pb, pc, pd LIMIT 20)) AS near20
      FROM (SELECT h, sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy))/1000 AS d FROM pts, site) JOIN (VALUES (5.0E0),(10.0E0),(20.0E0),(40.0E0)) r(radius_km) ON d<=radius_km GROUP BY radius_km""".replace("FROM pts ORDER", "FROM pts, site ORDER"), "site AS (SELECT avg(x) AS sx, avg(y) AS sy FROM pts)"),
    floats="med p10 p90 nearest near20", digits=5,
)
def c19(spark, sf):
    p = points(spark, sf)
    site = p.agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"))
    d = p.crossJoin(F.broadcast(site)).withColumn("d", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) / 1000)
    near20 = d.withColumn("d2", (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2).orderBy("d2", *IDS).limit(20).agg(F.median("h").alias("near20"))
    fan = d.withColumn("radius_km", F.explode(F.filter(F.array(*[F.lit(r) for r in (5.0, 10.0, 20.0, 40.0)]), lambda r: F.col("d") <= r)))
    q = group_quantiles(fan, ["radius_km"], "h", {"med": 0.5, "p10": 0.1, "p90": 0.9})
    return q.join(fan.groupBy("radius_km").agg(F.min("d").alias("nearest")), "radius_km").crossJoin(F.broadcast(near20))


@query(
    "C20_node_velocity",
    with_pts("SELECT node_x, node_y, count(*) AS n_pixels, median(qty) AS speed, any_value(mx) AS vx_med, 1.4826E0*median(abs(qty-m)) AS speed_mad FROM (SELECT node_x, node_y, qty, median(qty) OVER (PARTITION BY node_x,node_y) AS m, median(disc) OVER (PARTITION BY node_x,node_y) AS mx FROM pts JOIN nodes ON (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 3000.0E0*3000) GROUP BY ALL UNION ALL SELECT node_x, node_y, 0, NULL, NULL, NULL FROM nodes WHERE NOT EXISTS (SELECT 1 FROM pts WHERE (x-node_x)*(x-node_x)+(y-node_y)*(y-node_y) <= 3000.0E0*3000)", tile_nodes_sql(50000, 10000)),
    floats="speed vx_med speed_mad",
)
def c20(spark, sf):
    nd = nodes(spark, sf, step=10000.0).select("node_x", "node_y")
    pairs = spatial.radius_join(points(spark, sf).select("x", "y", "qty", "disc"), nd, 3000.0)
    hot = rates.crowded(points(spark, sf), nd, 3000.0, 2_000_000)
    s = group_median_mad(pairs, ["node_x", "node_y"], "qty", med="speed", mad="speed_mad", hot=hot).withColumnRenamed("n", "n_pixels")
    v = group_quantiles(pairs, ["node_x", "node_y"], "disc", {"vx_med": 0.5}, hot=hot).drop("n")
    return nd.join(s, ["node_x", "node_y"], "left").join(v, ["node_x", "node_y"], "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0)))


@query(
    "J08_ring_fraction",
    with_pts(f"SELECT ci, cj, avg(coalesce((fld.v>0.05E0)::INT, 0)) AS fraction FROM (SELECT ci, cj, k, cx+4000*cos(k*{2 * math.pi / 16!r}) AS rx, cy+4000*sin(k*{2 * math.pi / 16!r}) AS ry FROM cen, (SELECT unnest(range(0,16)) AS k)) LEFT JOIN fld ON cell_i=round_even((rx-2500.0E0)/5000,0)::BIGINT AND cell_j=round_even((ry-2500.0E0)/5000,0)::BIGINT GROUP BY ci, cj", CENT_SQL, FIELD_SQL),
    floats="fraction",
)
def j08(spark, sf):
    ring = spatial.ring_samples(centroids(spark, sf), 4000.0, 16, x="cx", y="cy")
    s = spatial.sample_cells(ring, field(spark, sf).select("cell_i", "cell_j", F.col("v").alias("f")), origin=(2500.0, 2500.0), step=5000.0, values=["f"], xy=("ring_x", "ring_y"))
    return s.groupBy("ci", "cj").agg(F.avg(F.coalesce((F.col("f") > 0.05).cast("double"), F.lit(0.0))).alias("fraction"))
