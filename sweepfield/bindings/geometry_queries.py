"""Column functions on whole tables."""


from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rigid as t
from ..operators import filters
from .registry import LATTICE, TIMELINE, VECTORS, lattice, longs, query, r6, timeline, vectors

SPOTS = f"WITH {LATTICE}, s AS (SELECT DISTINCT x, y - 4.5 AS y, z - 3.5 AS z FROM pts)"


def spots(spark, sf):
    """Distinct lattice positions around an off-lattice origin."""
    return lattice(spark, sf).select("x", (F.col("y") - 4.5).alias("y"), (F.col("z") - 3.5).alias("z")).distinct()


@query("geom_polar", SPOTS + """
SELECT x,y,z, round(sqrt(x*x+y*y+z*z),6) AS rho, round(atan2(sqrt(x*x+y*y),z),6) AS theta,
 round((1.5*pi()-atan2(y,x)) - 2*pi()*floor((1.5*pi()-atan2(y,x))/(2*pi())),6) AS phi_wrapped, round(atan2(y,x)+pi()/2,6) AS phi_ray,
 x AS back_x, y AS back_y, z AS back_z FROM s""")
def geom_polar(spark, sf):
    w, ray = g.polar_wrapped(g.xyz()), g.polar_ray(g.xyz())
    back = g.cartesian_from_ray(ray)
    return spots(spark, sf).select("x", "y", "z", r6(w.rho).alias("rho"), r6(w.theta).alias("theta"),
                                   r6(w.phi).alias("phi_wrapped"), r6(ray.phi).alias("phi_ray"),
                                   *(r6(c).alias("back_" + a) for a, c in zip("xyz", back)))


@query("geom_polar_scaled", SPOTS + """, p AS (SELECT x,y,z, sqrt(x*x+y*y+z*z) AS r, atan2(y,x)+pi()/2 AS phi, atan2(sqrt(x*x+y*y),z) AS th FROM s)
SELECT x,y,z, round(ln(r)*0.0675/(4.0*ln((1+0.0675)/(1-0.0675))),6) AS log_r, round(phi/0.5,6) AS h,
 round(r*sin(th)*cos(phi),6) AS sx, round(r*sin(th)*sin(phi),6) AS sy, round(r*cos(th),6) AS sz FROM p""")
def geom_polar_scaled(spark, sf):
    p = g.polar_ray(g.xyz())
    raw = g.cartesian_spherical(p)
    return spots(spark, sf).select("x", "y", "z", r6(g.log_range(p.rho, 0.0675, 4.0)).alias("log_r"),
                                   r6(g.squeeze_phi(p.phi, 0.5)).alias("h"),
                                   *(r6(c).alias("s" + a) for a, c in zip("xyz", raw)))


@query("geom_normal_scores", f"""WITH {VECTORS}, n AS (SELECT *, sqrt(x*x+y*y+z*z) AS r FROM vec), a AS (SELECT id, r*10 AS rho, z/r AS nz, abs(f) AS s,
 acos(least(abs(z/r),1.0)) AS ang FROM n)
SELECT id, round(acos(abs(greatest(least(nz,1.0),-1.0))),6) AS vert,
 round(least(CASE WHEN ang>5*pi()/12 THEN s*0.2/(pi()/2-5*pi()/12)*(pi()/2-ang) ELSE s*(0.2+0.8*exp(-0.01*(rho-2)*(rho-2))) END, 1.0),6) AS quality,
 round(s*(1.5-exp(-(rho/5)*(rho/5))),6) AS ranged FROM a""")
def geom_normal_scores(spark, sf):
    v = vectors(spark, sf).withColumn("r", g.xyz().norm())
    nz, rho, s = F.col("z") / F.col("r"), F.col("r") * 10, F.abs("f")
    ang = g.incidence(g.Vec.of(0.0, 0.0, 1.0), g.xyz())
    return v.select("id", r6(g.verticality(nz)).alias("vert"), r6(g.normal_quality(s, rho, ang)).alias("quality"),
                    r6(g.range_score(s, rho)).alias("ranged"))


@query("geom_planes", f"""WITH {VECTORS}, q AS (SELECT a.id, a.x x0,a.y y0,a.z z0, b.x x1,b.y y1,b.z z1, c.x x2,c.y y2,c.z z2, a.f AS f
 FROM vec a JOIN vec b ON b.id=a.id+1 JOIN vec c ON c.id=a.id+2),
n AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz FROM q),
u AS (SELECT *, nx/sqrt(nx*nx+ny*ny+nz*nz) AS a, ny/sqrt(nx*nx+ny*ny+nz*nz) AS b, nz/sqrt(nx*nx+ny*ny+nz*nz) AS c FROM n)
SELECT id, round(a,6) AS a, round(b,6) AS b, round(c,6) AS c, round(a*x0+b*y0+c*z0,6) AS d,
 round(abs(a*0.1+b*0.2+c*0.3-(a*x0+b*y0+c*z0)),6) AS dist, abs(a*0.1+b*0.2+c*0.3-(a*x0+b*y0+c*z0)) < 0.15 AS inside,
 round((a*0.1+b*0.2+c*0.3-(a*x0+b*y0+c*z0))*(a*0.1+b*0.2+c*0.3-(a*x0+b*y0+c*z0)),6) AS sq FROM u""")
def geom_planes(spark, sf):
    v = vectors(spark, sf)
    b = v.select((F.col("id") - 1).alias("id"), *(F.col(a).alias(a + "1") for a in "xyz"))
    c = v.select((F.col("id") - 2).alias("id"), *(F.col(a).alias(a + "2") for a in "xyz"))
    pl = g.plane_from_points(g.xyz(), g.Vec.of("x1", "y1", "z1"), g.Vec.of("x2", "y2", "z2"))
    probe = g.Vec.of(0.1, 0.2, 0.3)
    return v.join(b, "id").join(c, "id").select(
        "id", *(r6(k).alias(n) for n, k in zip("abcd", pl)), r6(g.plane_distance(pl, probe)).alias("dist"),
        g.in_plane(pl, probe, 0.15).alias("inside"), r6(g.plane_sq_distance(pl, probe)).alias("sq"))


@query("geom_rigid", f"""WITH {TIMELINE}
SELECT event_id, round(cos(yaw),6) AS r00, round(-sin(yaw),6) AS r01, round(sin(yaw),6) AS r10, round(cos(yaw),6) AS r11,
 round(cos(yaw)*1-sin(yaw)*2+px,6) AS wx, round(sin(yaw)*1+cos(yaw)*2+py,6) AS wy, 3.0 AS wz,
 round(cos(yaw),6) AS i00, round(-(cos(yaw)*px+sin(yaw)*py),6) AS i_t0, 1.0 AS loop_x, 2.0 AS loop_y,
 round(cos(2*yaw),6) AS c00, round(cos(yaw)*px-sin(yaw)*py+px,6) AS c_t0 FROM ev""")
def geom_rigid(spark, sf):
    r = t.rigid_from_quaternion(("qx", "qy", "qz", "qw"), g.Vec.of("px", "py", "pz"))
    p = g.Vec.of(1.0, 2.0, 3.0)
    w, inv = r.apply(p), r.inverse()
    loop, twice = inv.apply(w), r.then(r)
    return timeline(spark, sf).select(
        "event_id", r6(r.r0.x).alias("r00"), r6(r.r0.y).alias("r01"), r6(r.r1.x).alias("r10"), r6(r.r1.y).alias("r11"),
        *(r6(c).alias("w" + a) for a, c in zip("xyz", w)), r6(inv.r0.x).alias("i00"), r6(inv.t.x).alias("i_t0"),
        r6(loop.x).alias("loop_x"), r6(loop.y).alias("loop_y"), r6(twice.r0.x).alias("c00"), r6(twice.t.x).alias("c_t0"))


@query("geom_euler", """
WITH e AS (SELECT event_id, value/100 AS a, value/200 AS b, value/300 AS c FROM events)
SELECT event_id, round(cos(c)*cos(b),6) AS r00, round(cos(c)*sin(b)*sin(a)-sin(c)*cos(a),6) AS r01, round(cos(c)*sin(b)*cos(a)+sin(c)*sin(a),6) AS r02,
 round(-sin(b),6) AS r20, round(cos(b)*sin(a),6) AS r21, round(cos(b)*cos(a),6) AS r22 FROM e""")
def geom_euler(spark, sf):
    v = F.col("value")
    r = t.rigid_from_euler(v / 100, v / 200, v / 300, g.Vec.of(0.0, 0.0, 0.0), degrees=False)
    cols = r.columns()
    return timeline(spark, sf).select("event_id", *(r6(cols[k]).alias(k) for k in ("r00", "r01", "r02", "r20", "r21", "r22")))


@query("geom_ramps", """
WITH d AS (SELECT DISTINCT l_discount AS v, l_tax AS w FROM lineitem)
SELECT v, w, round(least(greatest((v-w-0.05)/0.10,0),1),6) AS movable, round(least(greatest((abs(v-w)-0.15)/(-0.10),0),1),6) AS still,
 round(CASE WHEN v<=0.05 THEN 0 WHEN v<0.08 THEN v*pow(1-pow((v-0.08)/0.03,2),2) ELSE v END,6) AS hysteresis,
 round(CASE WHEN v>0.01 THEN 0.5*(v+1) ELSE v END,6) AS lifted, round(exp(-(v*v)/(2*0.05*0.05+1e-9)),6) AS gauss,
 round(1/(1+exp(-v)),6) AS sig, round(greatest(v,0)-v*w+ln(1+exp(-abs(v))),6) AS bce, CAST(floor(w*255) AS BIGINT) AS byte,
 round(exp(v)/(exp(v)+exp(w)+1),6) AS soft, round(v/(w+1e-6),4) AS balance FROM d""")
def geom_ramps(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_discount").alias("v"), F.col("l_tax").alias("w")).distinct()
    v, w = F.col("v"), F.col("w")
    return d.select("v", "w", r6(g.movable_ramp(v - w)).alias("movable"), r6(g.still_ramp(v - w)).alias("still"),
                    r6(g.soft_hysteresis("v")).alias("hysteresis"), r6(g.lift_positive("v")).alias("lifted"),
                    r6(g.gaussian_weight(v * v, 0.05)).alias("gauss"), r6(g.sigmoid("v")).alias("sig"),
                    r6(g.logit_cross_entropy("v", "w")).alias("bce"), g.to_byte("w").cast("long").alias("byte"),
                    r6(g.softmax(F.array("v", "w", F.lit(0.0)))[0]).alias("soft"), F.round(g.balance_factor("v", "w"), 4).alias("balance"))


@query("geom_cells", """
SELECT CAST(floor((l_quantity-25)/0.5) AS BIGINT) AS cx, CAST(floor((round(l_discount*100)-5)/2) AS BIGINT) AS cy, count(*) AS n FROM lineitem GROUP BY ALL""")
def geom_cells(spark, sf):
    p = lattice(spark, sf)
    return p.groupBy(g.cell(F.col("x") - 25, 0.5).alias("cx"), g.cell(F.col("y") - 5, 2).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query("geom_face_sensor", f"""WITH {VECTORS}, n AS (SELECT *, y AS nx, z AS ny, x AS nz FROM vec)
SELECT id, round(CASE WHEN nx*x+ny*y+nz*z>0 THEN -nx ELSE nx END,6) AS nx, round(CASE WHEN nx*x+ny*y+nz*z>0 THEN -nz ELSE nz END,6) AS nz FROM n""")
def geom_face_sensor(spark, sf):
    n = g.face_sensor(g.Vec.of("y", "z", "x"), g.xyz())
    return vectors(spark, sf).select("id", r6(n.x).alias("nx"), r6(n.z).alias("nz"))


@query("filter_points", f"""WITH {LATTICE}
SELECT session, count(*) FILTER (sqrt(y*y+z*z) > 1e-6) AS off_axis, count(*) FILTER (label IN (0,1,2,3)) AS mapped,
 count(*) FILTER (price/100000 > 0.1) AS above, count(*) FILTER (label >= 3) AS not_below,
 count(*) FILTER ((x-20)*(x-20)+(y-5)*(y-5)+(z-4)*(z-4) < 100) AS ball, count(*) FILTER (z BETWEEN 2 AND 5) AS band,
 count(*) FILTER (abs(z-1) > 0.2 AND label > 1.5) AS off_ground FROM pts GROUP BY session""")
def filter_points(spark, sf):
    p = lattice(spark, sf).withColumns({"score": F.col("price") / 100000})
    axis = p.select("session", F.col("y").alias("x"), F.col("z").alias("y"), F.col("z"))
    floor = g.Plane(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    parts = {
        "off_axis": filters.drop_sensor_origin(axis), "mapped": filters.mapped_categories(p, "label"),
        "above": filters.score_above(p), "not_below": filters.score_not_below(p, 3, "label"),
        "ball": filters.ball_crop(p, (20, 5, 4), 10.0), "band": filters.height_band(p, 2, 5),
        "off_ground": filters.off_ground(p, floor, 0.2, "label")}
    kinds = None
    for name, df in parts.items():
        part = df.select("session", F.lit(name).alias("kind"))
        kinds = part if kinds is None else kinds.unionByName(part)
    return kinds.groupBy("session").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in parts))


@query("filter_crop_to_frame", f"""WITH {LATTICE}, b AS (SELECT frame, min(x)-1 AS lx, max(x)+1 AS hx, min(y)-1 AS ly, max(y)+1 AS hy, min(z)-1 AS lz, max(z)+1 AS hz
  FROM (SELECT frame+1 AS frame, x, y, z FROM pts) GROUP BY frame)
SELECT frame, count(*) AS n FROM pts JOIN b USING (frame) WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY frame""")
def filter_crop_to_frame(spark, sf):
    p = lattice(spark, sf)
    box = filters.frame_bounds(p.withColumn("frame", F.col("frame") + 1), ["frame"], 1.0)
    return filters.crop_to_bounds(p, box, ["frame"]).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("label_remap", f"""WITH {LATTICE} SELECT CAST(CASE WHEN label<=2 THEN 1 WHEN label<=4 THEN 2 ELSE -1 END AS BIGINT) AS label, count(*) AS n FROM pts GROUP BY ALL""")
def label_remap(spark, sf):
    p = filters.label_fallback(lattice(spark, sf).withColumn("cat", F.col("label")))
    lookup = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("label")).distinct().where("label <= 4")
    lookup = lookup.withColumn("mapped", F.when(F.col("label") <= 2, 1).otherwise(2))
    out = filters.remap_labels(p, lookup).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return longs(out, "label")


@query("frame_indicators", f"""WITH {LATTICE} SELECT session, sum(CASE WHEN frame%3=0 THEN 1.0 ELSE 0 END) AS frame_0, sum(CASE WHEN frame%3=1 THEN 1.0 ELSE 0 END) AS frame_1,
 sum(CASE WHEN frame%3=2 THEN 1.0 ELSE 0 END) AS frame_2 FROM pts GROUP BY session""")
def frame_indicators(spark, sf):
    p = filters.frame_indicators(lattice(spark, sf).withColumn("age", F.col("frame") % 3), 3)
    return p.groupBy("session").agg(*(F.sum(f"frame_{k}").alias(f"frame_{k}") for k in range(3)))
