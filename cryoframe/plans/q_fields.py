"""Queries over fields, zones, fronts and parcels (J, and parts of B, D, I)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cryoframe.functions.physics import basal_melt, thickness_rate
from cryoframe.operators import flow, fronts, grids, mass, spatial
from cryoframe.operators.skew import group_quantiles
from cryoframe.plans.base import IDS, points, query, with_pts
from cryoframe.plans.q_spatial import centroids
from cryoframe.session import cut

SIZE = 2500.0
# A field of thickness, velocity, bed and class over the cells of the points.
GRID_SQL = """gd AS (SELECT floor(x/2500)::BIGINT AS cell_i, floor(y/2500)::BIGINT AS cell_j, avg(h)+avg(qty)*10 AS "H", 100.0E0+avg(disc)*1000 AS vx, avg(tax)*500-20 AS vy, avg(qty)*20-900 AS bed, (count(*)%5)::INT AS mask_class, avg(h) AS z FROM pts GROUP BY 1,2)"""


def grid(spark, sf, size=SIZE):
    g = points(spark, sf).groupBy(spatial.cell("x", size).alias("cell_i"), spatial.cell("y", size).alias("cell_j"))
    return g.agg((F.avg("h") + F.avg("qty") * 10).alias("H"), (F.avg("disc") * 1000 + 100.0).alias("vx"), (F.avg("tax") * 500 - 20).alias("vy"),
                 (F.avg("qty") * 20 - 900).alias("bed"), (F.count(F.lit(1)) % 5).cast("int").alias("mask_class"), F.avg("h").alias("z"))


def grad_sql(src: str, cols: str, name: str) -> str:
    """Central differences in SQL, one-sided at an edge."""
    def d(c, lo, hi):
        return f"CASE WHEN {lo}.{c} IS NOT NULL AND {hi}.{c} IS NOT NULL THEN ({hi}.{c}-{lo}.{c})/5000 WHEN {hi}.{c} IS NOT NULL THEN ({hi}.{c}-o.{c})/2500 WHEN {lo}.{c} IS NOT NULL THEN (o.{c}-{lo}.{c})/2500 END"

    parts = ", ".join(f"{d(c, 'w', 'e')} AS d{c}_dx, {d(c, 's', 'n')} AS d{c}_dy" for c in cols.split())
    joins = " ".join(f"LEFT JOIN {src} {t} ON {t}.cell_i=o.cell_i{di} AND {t}.cell_j=o.cell_j{dj}" for t, di, dj in (("e", "+1", ""), ("w", "-1", ""), ("n", "", "+1"), ("s", "", "-1")))
    return f"{name} AS (SELECT o.*, {parts} FROM {src} o {joins})"


@query("J01_distance_to_class", with_pts("SELECT a.cell_i, a.cell_j, min(sqrt((a.cell_i-b.cell_i)*(a.cell_i-b.cell_i)+(a.cell_j-b.cell_j)*(a.cell_j-b.cell_j))*2500.0E0) AS distance FROM gd a, (SELECT * FROM gd WHERE mask_class=2) b GROUP BY 1,2", GRID_SQL), floats="distance")
def j01(spark, sf):
    return grids.distance_to_class(grid(spark, sf).select("cell_i", "cell_j", "mask_class"), F.col("mask_class") == 2, SIZE).select("cell_i", "cell_j", "distance")


_W = grids.gaussian_weights(1.0)
SMOOTH_SQL = f"kw AS (SELECT * FROM (VALUES {', '.join(f'({k - 4}, {w!r}::DOUBLE)' for k, w in enumerate(_W))}) v(o, w))"


@query("J02_nan_smoothing", with_pts("SELECT a.cell_i, a.cell_j, sum(b.z*kx.w*ky.w)/sum(kx.w*ky.w) AS z FROM gd a, kw kx, kw ky, gn b WHERE b.cell_i=a.cell_i+kx.o AND b.cell_j=a.cell_j+ky.o AND b.z IS NOT NULL GROUP BY 1,2 HAVING sum(kx.w*ky.w)>1E-6", GRID_SQL, SMOOTH_SQL, "gn AS (SELECT cell_i, cell_j, CASE WHEN mask_class<>1 THEN z END AS z FROM gd)"), floats="z")
def j02(spark, sf):
    f = grid(spark, sf).select("cell_i", "cell_j", F.when(F.col("mask_class") != 1, F.col("z")).alias("z"))
    return grids.smooth(f, ["z"], 1.0).where(F.col("z").isNotNull())


@query("J03_flux_divergence", with_pts("SELECT cell_i, cell_j, CASE WHEN H>=700 THEN dqx_dx+dqy_dy END AS divergence FROM gq", GRID_SQL, 'qq AS (SELECT *, "H"*vx AS qx, "H"*vy AS qy FROM gd)', grad_sql("qq", "qx qy", "gq")), floats="divergence", digits=5)
def j03(spark, sf):
    return grids.flux_divergence(grid(spark, sf), SIZE, min_thickness=700.0).select("cell_i", "cell_j", "divergence")


@query("J04_velocity_divergence", with_pts("SELECT cell_i, cell_j, (dvx_dx+dvy_dy)*1E3 AS div3 FROM gq", GRID_SQL, grad_sql("gd", "vx vy", "gq")), floats="div3")
def j04(spark, sf):
    d = grids.velocity_divergence(grid(spark, sf).select("cell_i", "cell_j", "vx", "vy"), SIZE)
    return d.select("cell_i", "cell_j", (F.col("divergence") * 1e3).alias("div3"))


SCALES = (0.8, 1.2, 2.0)


def kernel_sql(sigma: float) -> str:
    """Smoothed velocities at one scale, and their gradients."""
    w, tag = grids.gaussian_weights(sigma), str(sigma).replace(".", "")
    values = ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w))
    mean = lambda c: f"sum(b.{c}*kx.w*ky.w)/sum(kx.w*ky.w) AS {c}"
    smooth = (
        f"sm{tag} AS (SELECT a.cell_i, a.cell_j, {mean('vx')}, {mean('vy')} FROM gd a, (VALUES {values}) kx(o, w), (VALUES {values}) ky(o, w), gd b "
        f"WHERE b.cell_i=a.cell_i+kx.o AND b.cell_j=a.cell_j+ky.o GROUP BY 1,2)"
    )
    return smooth + ", " + grad_sql(f"sm{tag}", "vx vy", f"sg{tag}")


SWEEP_SQL = " UNION ALL ".join(
    f"SELECT {s!r}::DOUBLE AS sigma, count(dvx_dx+dvy_dy) AS n, stddev_pop(dvx_dx+dvy_dy)*1E3 AS spread3 FROM {t}" for s, t in [(0.0, "gq"), *[(s, f"sg{str(s).replace('.', '')}") for s in SCALES]]
)


@query("J04_smoothing_sweep", with_pts(SWEEP_SQL, GRID_SQL, grad_sql("gd", "vx vy", "gq"), *[kernel_sql(s) for s in SCALES]), floats="spread3")
def j04_sweep(spark, sf):
    s = grids.divergence_sweep(cut(grid(spark, sf).select("cell_i", "cell_j", "vx", "vy")), SIZE, [0.0, *SCALES])
    return s.groupBy("sigma").agg(F.count("divergence").alias("n"), (F.stddev_pop("divergence") * 1e3).alias("spread3"))


@query("J05_slope_magnitude", with_pts("SELECT floor(cell_i/4)::BIGINT AS bi, floor(cell_j/4)::BIGINT AS bj, count(*) AS n, median(sqrt(dz_dx*dz_dx+dz_dy*dz_dy))*1E3 AS slope3 FROM gq GROUP BY 1,2", GRID_SQL, grad_sql("gd", "z", "gq")), floats="slope3")
def j05(spark, sf):
    s = grids.slope_magnitude(grid(spark, sf).select("cell_i", "cell_j", "z"), SIZE)
    s = s.withColumn("bi", F.floor(F.col("cell_i") / 4)).withColumn("bj", F.floor(F.col("cell_j") / 4)).withColumn("slope3", F.col("slope") * 1e3)
    # Null slopes of isolated cells stay out of the median and are counted apart.
    return group_quantiles(s, ["bi", "bj"], "slope3", {"_m": 0.5}).drop("n").join(s.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n")), ["bi", "bj"]).withColumnRenamed("_m", "slope3")


@query("J06_advection", with_pts("SELECT cell_i, cell_j, vx*dz_dx+vy*dz_dy AS advection FROM gq", GRID_SQL, grad_sql("gd", "z", "gq")), floats="advection")
def j06(spark, sf):
    return grids.advection(grid(spark, sf), SIZE).select("cell_i", "cell_j", "advection")


@query("J07_along_flow_slope", with_pts("SELECT cell_i, cell_j, 1000*(dbed_dx*vx+dbed_dy*vy)/sqrt(vx*vx+vy*vy) AS flow_slope FROM gq WHERE bed<0", GRID_SQL, grad_sql("gd", "bed", "gq")), floats="flow_slope", digits=5)
def j07(spark, sf):
    g = grid(spark, sf)
    return grids.along_flow_slope(g, SIZE).where(F.col("bed") < 0).select("cell_i", "cell_j", "flow_slope")


LINE_SQL = """lv AS (SELECT "year", avg(x) AS vx0, avg(y) AS vy0, pc, 2000.0E0+(pc%3)*800 AS radius, pc%4<>0 AS matched FROM pts GROUP BY "year", beam, pc),
 gc AS (SELECT cell_i, cell_j, (cell_i+0.5E0)*2500 AS x, (cell_j+0.5E0)*2500 AS y FROM gd),
 zn AS (SELECT cell_i, cell_j, "year", max(radius) AS radius, min(sqrt((x-vx0)*(x-vx0)+(y-vy0)*(y-vy0))) AS distance, CASE WHEN bool_or(matched) THEN 2 ELSE 3 END AS support FROM gc, lv WHERE (x-vx0)*(x-vx0)+(y-vy0)*(y-vy0)<=radius*radius GROUP BY 1,2,3)"""


def zones(spark, sf):
    """Around the lines of every beam and supplier."""
    lines = points(spark, sf).groupBy("year", "beam", "pc").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    lines = lines.withColumn("radius", F.lit(2000.0) + (F.col("pc") % 3) * 800).withColumn("matched", F.col("pc") % 4 != 0)
    cells = grid(spark, sf).select("cell_i", "cell_j", ((F.col("cell_i") + 0.5) * SIZE).alias("x"), ((F.col("cell_j") + 0.5) * SIZE).alias("y"))
    return fronts.transition_zones(cells, lines, 3600.0)


@query("J09_transition_zones", with_pts('SELECT cell_i, cell_j, "year", radius, distance, support FROM zn', GRID_SQL, LINE_SQL), floats="distance", digits=4)
def j09(spark, sf):
    return zones(spark, sf)


@query("B07_space_time_state", with_pts('SELECT state, support, count(*) AS n, sum(tr) AS radius_sum FROM (SELECT CASE WHEN z.support IS NOT NULL THEN 2 WHEN e.hr IS NOT NULL THEN 0 WHEN mask_class=2 THEN 1 WHEN mask_class=3 THEN 3 ELSE 0 END AS state, CASE WHEN z.support IS NOT NULL THEN z.support WHEN e.hr IS NOT NULL THEN 4 WHEN mask_class IN (2,3) THEN 1 ELSE 0 END AS support, coalesce(z.radius, e.hr, 0) AS tr FROM pts LEFT JOIN zn z ON z.cell_i=floor(x/2500) AND z.cell_j=floor(y/2500) AND z."year"=pts."year" LEFT JOIN (SELECT cell_i, cell_j, max(radius) AS hr FROM zn GROUP BY 1,2) e ON e.cell_i=floor(x/2500) AND e.cell_j=floor(y/2500)) GROUP BY 1,2', GRID_SQL, LINE_SQL))
def b07(spark, sf):
    p = points(spark, sf).withColumn("cell_i", spatial.cell("x", SIZE)).withColumn("cell_j", spatial.cell("y", SIZE)).select("cell_i", "cell_j", "year", "mask_class")
    c = fronts.classify_state(p, cut(zones(spark, sf)))
    return c.groupBy("state", "support").agg(F.count(F.lit(1)).alias("n"), F.sum("transition_radius").alias("radius_sum"))


GATE_SQL = """gt AS (SELECT pc AS gate, min(x) AS x0, max(x) AS x1, avg(y) AS y0, avg(y)+5000 AS y1 FROM pts GROUP BY pc),
 gs AS (SELECT gate, x0+(k+0.5E0)/120*(x1-x0) AS px, y0+(k+0.5E0)/120*(y1-y0) AS py, sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS ln, -(y1-y0)/sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS nx, (x1-x0)/sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS ny FROM gt, (SELECT unnest(range(0,120)) AS k))"""


@query("J10_gate_discharge", with_pts('SELECT gate, count(*) AS n_samples, abs(sum("H"*(vx*nx+vy*ny)*ln/120)*917.0E0/1E12) AS discharge_gt FROM gs JOIN gd ON cell_i=round_even((px-1250.0E0)/2500,0)::BIGINT AND cell_j=round_even((py-1250.0E0)/2500,0)::BIGINT GROUP BY gate', GRID_SQL, GATE_SQL), floats="discharge_gt", digits=5)
def j10(spark, sf):
    g = points(spark, sf).groupBy(F.col("pc").alias("gate")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("y0"), (F.avg("y") + 5000).alias("y1"))
    return grids.gate_discharge(g, grid(spark, sf), origin=(1250.0, 1250.0), step=SIZE)


WKT_SQL = """ln AS (SELECT mask_class AS shelf, "year" AS epoch, bx, avg(x) AS x, 40000.0E0+mask_class*4000+avg(disc)*20000 AS y FROM (SELECT *, floor(x/10000) AS bx FROM pts) GROUP BY mask_class, "year", bx),
 sgs AS (SELECT shelf, epoch, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ln WINDOW w AS (PARTITION BY shelf, epoch ORDER BY bx)),
 sgl AS (SELECT *, sqrt(pow(x2-x,2)+pow(y2-y,2)) AS l FROM sgs WHERE x2 IS NOT NULL),
 cum AS (SELECT *, sum(l) OVER (PARTITION BY shelf, epoch ORDER BY x) AS t1, sum(l) OVER (PARTITION BY shelf, epoch ORDER BY x)-l AS t0, sum(l) OVER (PARTITION BY shelf, epoch) AS tot FROM sgl),
 den AS (SELECT shelf, epoch, k, x+(k*tot/n-t0)/l*(x2-x) AS x, y+(k*tot/n-t0)/l*(y2-y) AS y FROM (SELECT *, greatest(ceil(tot/2000),1) AS n FROM cum), (SELECT unnest(range(0,400)) AS k) WHERE k<=n AND ((k*tot/n>=t0-1E-9*tot/n AND k*tot/n<t1-1E-9*tot/n) OR (k=n AND abs(t1-tot)<1E-6)))"""


def lines(spark, sf):
    """Line text per shelf and year, made from mean positions along x."""
    v = points(spark, sf).groupBy(F.col("mask_class").alias("shelf"), F.col("year").alias("epoch"), F.floor(F.col("x") / 10000).alias("bx")).agg(
        F.avg("x").alias("x"), (F.lit(40000.0) + F.first("mask_class") * 4000 + F.avg("disc") * 20000).alias("y"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bx", "x", "y"))), lambda e: F.concat_ws(" ", e["x"], e["y"])), ", ")
    return v.groupBy("shelf", "epoch").agg(F.concat(F.lit("LINESTRING ("), text, F.lit(")")).alias("wkt"))


@query("J11_line_densification", with_pts("SELECT shelf, epoch, k::INT AS k, x, y FROM den", WKT_SQL), floats="x y", digits=3)
def j11(spark, sf):
    return fronts.densify(lines(spark, sf), ["shelf", "epoch"], 2000.0).drop("part")


FRONT_SQL = """fv AS (SELECT shelf, epoch+0.5E0 AS epoch, x, y, y/2 AS df FROM den),
 rf AS (SELECT shelf, min((x,y)) AS xy FROM fv GROUP BY shelf, round_even(x/2000,0), round_even(y/2000,0)),
 sh AS (SELECT * FROM (SELECT pa,pb,pc,pd, pts.x, pts.y, t_year, rf.shelf, row_number() OVER (PARTITION BY pa,pb,pc,pd ORDER BY (pts.x-xy[1])*(pts.x-xy[1])+(pts.y-xy[2])*(pts.y-xy[2]), rf.shelf, xy[1], xy[2]) AS k FROM pts JOIN rf ON (pts.x-xy[1])*(pts.x-xy[1])+(pts.y-xy[2])*(pts.y-xy[2])<=20000.0E0*20000) WHERE k=1),
 ep2 AS (SELECT sh.*, e.epoch, abs(t_year-e.epoch) AS gap, row_number() OVER (PARTITION BY pa,pb,pc,pd ORDER BY round(abs(t_year-e.epoch),9), e.epoch) AS r FROM sh JOIN (SELECT DISTINCT shelf, epoch FROM fv) e ON e.shelf=sh.shelf),
 ok AS (SELECT * FROM ep2 WHERE r=1),
 fr AS (SELECT * FROM (SELECT ok.*, sqrt((ok.x-fv.x)*(ok.x-fv.x)+(ok.y-fv.y)*(ok.y-fv.y)) AS fd, df-ok.y/2 AS margin, row_number() OVER (PARTITION BY pa,pb,pc,pd ORDER BY (ok.x-fv.x)*(ok.x-fv.x)+(ok.y-fv.y)*(ok.y-fv.y), fv.x, fv.y) AS q FROM ok JOIN fv ON fv.shelf=ok.shelf AND fv.epoch=ok.epoch AND (ok.x-fv.x)*(ok.x-fv.x)+(ok.y-fv.y)*(ok.y-fv.y)<=15000.0E0*15000 WHERE gap<=0.45E0) WHERE q=1),
 fres AS (SELECT pts.pa, ok.shelf, CASE WHEN ok.shelf IS NULL THEN 'no_shelf' WHEN ok.gap>0.45E0 THEN 'epoch_gap' WHEN fr.fd IS NULL THEN 'no_front' WHEN margin<0 THEN 'seaward' ELSE 'kept' END AS reason, margin FROM pts LEFT JOIN ok USING (pa,pb,pc,pd) LEFT JOIN fr USING (pa,pb,pc,pd))"""


def front_result(spark, sf):
    v = fronts.densify(lines(spark, sf), ["shelf", "epoch"], 2000.0).select("shelf", (F.col("epoch") + 0.5).alias("epoch"), "x", "y", (F.col("y") / 2).alias("df"))
    p = points(spark, sf).select(*IDS, "x", "y", "t_year", (F.col("y") / 2).alias("dg"))
    return fronts.classify_front(p, cut(v), ids=IDS, distance="dg", front_distance="df", assignment_max=20_000.0, max_search=15_000.0, max_gap=0.45)


@query("B08_front_classifier", with_pts("SELECT shelf, reason, count(*) AS n, sum(margin) AS margin_sum FROM fres GROUP BY 1,2", WKT_SQL, FRONT_SQL), floats="margin_sum", digits=2)
def b08(spark, sf):
    r = front_result(spark, sf)
    return r.groupBy("shelf", fronts.front_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("margin").alias("margin_sum"))


@query("D47_front_counters", with_pts("SELECT b AS buffer, count(margin) AS n_tested, count(*) FILTER (margin>=b) AS n_kept FROM fres, (VALUES (0.0E0),(2000.0E0),(5000.0E0),(10000.0E0)) v(b) GROUP BY b", WKT_SQL, FRONT_SQL))
def d47(spark, sf):
    return fronts.front_counters(front_result(spark, sf))[1]


@query("J12_points_to_matrix", with_pts("SELECT floor(y/20000)::BIGINT AS cell_j, " + ", ".join(f"avg(CASE WHEN floor(x/20000)={i} THEN h END) AS c{i}" for i in range(6)) + " FROM pts GROUP BY 1"), floats="c0 c1 c2 c3 c4 c5")
def j12(spark, sf):
    g = points(spark, sf).groupBy(spatial.cell("x", 20000).alias("cell_i"), spatial.cell("y", 20000).alias("cell_j")).agg(F.avg("h").alias("v"))
    m = grids.to_matrix(g, "v", range(6))
    return m.select("cell_j", *[F.col(f"`{i}`").alias(f"c{i}") for i in range(6)])


@query("J13_layer_fusion", with_pts('SELECT cell_i, cell_j, CASE WHEN mask_class=3 THEN z-"H" END AS draft, CASE WHEN mask_class=3 THEN greatest(z-"H"-bed,0) END AS water_column FROM gd', GRID_SQL), floats="draft water_column")
def j13(spark, sf):
    g = cut(grid(spark, sf))
    layer = lambda c: g.select("cell_i", "cell_j", F.col(c).cast("double").alias("value"))
    f = grids.fuse_layers({"surface": layer("z"), "thickness": layer("H"), "bed": layer("bed"), "mask": layer("mask_class")}, F.col("mask") == 3)
    return f.select("cell_i", "cell_j", "draft", "water_column")


@query("J14_melt_grid", with_pts("SELECT cell_i, cell_j, 0.5E0 - (bed/1000)*(1027.0E0/110.0E0) - dqx_dx - dqy_dy AS melt FROM gq WHERE mask_class=3", GRID_SQL, 'qq AS (SELECT *, "H"*vx AS qx, "H"*vy AS qy FROM gd)', grad_sql("qq", "qx qy", "gq")), floats="melt", digits=5)
def j14(spark, sf):
    """Eulerian melt: surface balance less thickening less flux divergence, floating cells only."""
    g = grids.flux_divergence(grid(spark, sf), SIZE, min_thickness=0.0).join(grid(spark, sf).select("cell_i", "cell_j", "bed", "mask_class"), ["cell_i", "cell_j"])
    on = F.col("mask_class") == 3
    m = basal_melt(thickness_rate(F.col("bed") / 1000, on), F.col("divergence"), F.lit(0.5), on)
    return g.where(on).select("cell_i", "cell_j", m.alias("melt"))


@query("B03_polygon_roi", with_pts("SELECT mask_class, count(*) AS n FROM pts WHERE (SELECT count(*) FROM eg WHERE (y1>pts.y)<>(y2>pts.y) AND pts.x < x1+(pts.y-y1)*(x2-x1)/(y2-y1))%2=1 GROUP BY mask_class", "ce AS (SELECT avg(x) AS mx, avg(y) AS my, max(x)-min(x) AS w FROM pts)", f"vt AS (SELECT k, mx+w*(0.3E0+0.12E0*(k%3))*cos(k*{2 * math.pi / 24!r}) AS x, my+w*(0.3E0+0.12E0*(k%3))*sin(k*{2 * math.pi / 24!r}) AS y FROM ce, (SELECT unnest(range(0,24)) AS k))", "eg AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vt a JOIN vt b ON b.k=(a.k+1)%24)"))
def b03(spark, sf):
    """A star around the middle of the points."""
    p = points(spark, sf)
    c = p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.max("x") - F.min("x")).alias("w"))

    def at(k):
        r = F.col("w") * (F.lit(0.3) + F.lit(0.12) * (k % 3))
        return F.col("mx") + r * F.cos(k * F.lit(2 * math.pi / 24)), F.col("my") + r * F.sin(k * F.lit(2 * math.pi / 24))

    ring = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23))))
    (x1, y1), (x2, y2) = at(F.col("k")), at((F.col("k") + 1) % 24)
    edges = ring.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    inside = grids.in_polygon(p.select(*IDS, "x", "y", "mask_class"), edges, 5000.0, ids=IDS)
    return inside.groupBy("mask_class").agg(F.count(F.lit(1)).alias("n"))


@query("B04_mask_classes", with_pts("SELECT m.mask_class AS pixel_class, count(*) AS n FROM pts JOIN (SELECT cell_i, cell_j, mask_class FROM gd) m ON cell_i=round_even((x-1250.0E0)/2500,0)::BIGINT AND cell_j=round_even((y-1250.0E0)/2500,0)::BIGINT WHERE m.mask_class IN (1,2,3,4) GROUP BY 1", GRID_SQL))
def b04(spark, sf):
    m = grid(spark, sf).select("cell_i", "cell_j", F.col("mask_class").alias("pixel_class"))
    c = grids.classify_by_mask(points(spark, sf).select("x", "y"), m, origin=(1250.0, 1250.0), step=SIZE, limits=(0, 40, 0, 40), keep=[1, 2, 3, 4], value="pixel_class")
    return c.groupBy("pixel_class").agg(F.count(F.lit(1)).alias("n"))


def velocity(spark, sf):
    """A field over 5 km cells, complete over the middle of the domain, that gains a tenth of its speed in two years."""
    g = points(spark, sf).groupBy(spatial.cell("x", 5000).alias("cell_i"), spatial.cell("y", 5000).alias("cell_j"))
    mean = g.agg((F.avg("disc") * 20000).alias("vx"), (F.avg("tax") * 5000 - 225).alias("vy"))
    timed = mean.withColumn("epoch", F.explode(F.array(F.lit(1996.5), F.lit(2000.5))))
    gain = 1 + (F.col("epoch") - 1998.5) / 20
    return timed.withColumn("vx", F.col("vx") * gain).withColumn("vy", F.col("vy") * gain)


def parcels(spark, sf):
    c = centroids(spark, sf)
    return c.select(((F.col("ci") * 1000) + F.col("cj")).alias("parcel"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def epochs(spark, sf):
    """Mid-years of all points: as many numbers as there are years."""
    return sorted(r.year + 0.5 for r in points(spark, sf).select("year").distinct().collect())


@query("I29_trajectories")
def i29(spark, sf):
    return flow.trajectories(parcels(spark, sf), velocity(spark, sf), epochs(spark, sf), 1998.5, ids=["parcel"], origin=(2500.0, 2500.0), step=5000.0)


@query("I30_lagrangian_rate")
def i30(spark, sf):
    t = flow.trajectories(parcels(spark, sf), velocity(spark, sf), epochs(spark, sf), 1998.5, ids=["parcel"], origin=(2500.0, 2500.0), step=5000.0)
    p = points(spark, sf).select("x", "y", "h", (F.col("year") + 0.5).alias("epoch"))
    return flow.lagrangian_rates(cut(t), p, ids=["parcel"], radius=5000.0)


@query("I31_windowed_lagrangian")
def i31(spark, sf):
    """Three-year windows, kept apart by shelf."""
    t = flow.trajectories(parcels(spark, sf), velocity(spark, sf), epochs(spark, sf), 1998.5, ids=["parcel"], origin=(2500.0, 2500.0), step=5000.0)
    shelves = F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("shelf")
    starts = F.filter(F.array(*[F.lit(e - 0.5) for e in epochs(spark, sf)[:-2]]), lambda s: (F.col("epoch") >= s) & (F.col("epoch") < s + 3))
    moved = cut(t.select("*", shelves).withColumn("window_start", F.explode(starts)))
    p = points(spark, sf).select("x", "y", "h", (F.col("year") + 0.5).alias("epoch"), F.when(F.col("pc") % 2 == 0, "even").otherwise("odd").alias("shelf"))
    return flow.lagrangian_rates(moved, p, ids=["parcel"], by=["shelf"], windows=["window_start"], radius=5000.0, min_epochs=3)


@query(
    "D33_layer_metrics",
    with_pts("""SELECT ci, "year", sum(w*td)/sum(w) AS thermal_driving, sqrt(pow(sum(w*u)/sum(w),2)+pow(sum(w*v)/sum(w),2)) AS speed_mean, sum(w*greatest(td,0))*1027.0E0*3990.0E0/1E9 AS heat9, sum(CASE WHEN th>=0 AND sa>=34.5E0 THEN w ELSE 0 END) AS warm_thickness FROM (SELECT *, CASE WHEN depth BETWEEN 400 AND 1000 THEN greatest(coalesce((depth+dn)/2, least(depth+(depth-up)/2,1000.0E0))-coalesce((depth+up)/2, greatest(depth-(dn-depth)/2,0.0E0)),0) END AS w FROM
     (SELECT *, lag(depth) OVER (PARTITION BY ci, "year" ORDER BY depth) AS up, lead(depth) OVER (PARTITION BY ci, "year" ORDER BY depth) AS dn FROM (SELECT floor(x/10000)::BIGINT AS ci, "year", 50.0E0+floor(y/5000)*50 AS depth, avg(disc)*40 AS td, avg(tax)*10 AS u, avg(qty) AS v, avg(disc)*100-5 AS th, 34.0E0+avg(tax)*12 AS sa FROM pts GROUP BY 1,2,3))) GROUP BY 1,2"""),
    floats="thermal_driving speed_mean heat9 warm_thickness", digits=5,
)
def d33(spark, sf):
    p = points(spark, sf).groupBy(spatial.cell("x", 10000).alias("ci"), "year", (F.lit(50.0) + F.floor(F.col("y") / 5000) * 50).alias("depth")).agg(
        (F.avg("disc") * 40).alias("thermal_driving"), (F.avg("tax") * 10).alias("u"), F.avg("qty").alias("v"), (F.avg("disc") * 100 - 5).alias("theta"), (F.avg("tax") * 12 + 34.0).alias("salinity"))
    m = mass.layer_metrics(p, ["ci", "year"])
    return m.select("ci", "year", "thermal_driving", "speed_mean", (F.col("heat_content") / 1e9).alias("heat9"), "warm_thickness")


