"""Voxel aggregation and map building on lattice points."""

from pyspark.sql import functions as F

from ..functions.geometry import Vec
from ..functions.rigid import axis_angle
from ..operators import mapping, voxels
from .registry import LATTICE, LATTICE_ID, lattice, longs, query, r6, rounded

DL = 4.0
KEY = "CAST(floor(x/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz"
BARY = f"""
WITH {LATTICE}, k AS (SELECT *, {KEY} FROM pts),
c AS (SELECT session,vx,vy,vz,label,count(*) AS n FROM k GROUP BY ALL),
m AS (SELECT session,vx,vy,vz, arg_max(label, n*100 - label) AS label FROM c GROUP BY ALL),
a AS (SELECT session,vx,vy,vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, round(avg(price),4) AS price, count(*) AS n FROM k GROUP BY ALL)
"""


@query("voxel_barycentre", BARY + """
SELECT a.session, a.vx, a.vy, a.vz, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, price, m.label, n
FROM a JOIN m USING (session,vx,vy,vz)""")
def voxel_barycentre(spark, sf):
    out = voxels.voxel_barycentre(lattice(spark, sf), DL, ["session"], ["price"], ["label"])
    return rounded(out, "x", "y", "z").withColumn("price", F.round("price", 4))


@query("voxel_barycentre_capped", BARY + """
SELECT session, vx, vy, vz, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, n FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY vx,vy,vz) AS rn FROM a) WHERE rn <= 20""")
def voxel_barycentre_capped(spark, sf):
    return rounded(voxels.voxel_barycentre_capped(lattice(spark, sf), DL, ["session"], 20), "x", "y", "z")


@query("voxel_two_labels", f"""
WITH {LATTICE}, k AS (SELECT *, l_partkey % 5 AS part, {KEY} FROM pts),
c AS (SELECT vx,vy,vz,label,count(*) AS n FROM k GROUP BY ALL), d AS (SELECT vx,vy,vz,part,count(*) AS n FROM k GROUP BY ALL)
SELECT vx,vy,vz, l.label, p.part FROM
 (SELECT vx,vy,vz, arg_max(label, n*100-label) AS label FROM c GROUP BY ALL) l
 JOIN (SELECT vx,vy,vz, arg_max(part, n*100-part) AS part FROM d GROUP BY ALL) p USING (vx,vy,vz)""")
def voxel_two_labels(spark, sf):
    pts = lattice(spark, sf).withColumn("part", F.col("id.l_partkey") % 5)
    return voxels.voxel_barycentre(pts, DL, labels=["label", "part"]).select("vx", "vy", "vz", "label", "part")


@query("voxel_medoid", f"""
WITH {LATTICE}, k AS (SELECT *, {KEY} FROM pts), r AS (SELECT *, row_number() OVER (PARTITION BY session,vx,vy,vz ORDER BY
  (x-(vx+0.5)*4)*(x-(vx+0.5)*4)+(y-(vy+0.5)*4)*(y-(vy+0.5)*4)+(z-(vz+0.5)*4)*(z-(vz+0.5)*4), {LATTICE_ID}) AS rn FROM k)
SELECT session,vx,vy,vz,x,y,z,label,price FROM r WHERE rn=1""")
def voxel_medoid(spark, sf):
    return voxels.voxel_medoid(lattice(spark, sf), DL, ["session"]).select(
        "session", "vx", "vy", "vz", "x", "y", "z", "label", "price")


SPHERES = f"""
WITH {LATTICE}, o AS (SELECT unnest([-1,0,1]) AS d), k AS (SELECT *, {KEY} FROM pts),
s AS (SELECT session, frame, x,y,z, vx+a.d AS vx, vy+b.d AS vy, vz+c.d AS vz FROM k, o a, o b, o c),
m AS (SELECT * FROM s WHERE (x-(vx+0.5)*4)*(x-(vx+0.5)*4)+(y-(vy+0.5)*4)*(y-(vy+0.5)*4)+(z-(vz+0.5)*4)*(z-(vz+0.5)*4) < 36)
"""


@query("voxel_spheres", SPHERES + """
SELECT session,vx,vy,vz, round(avg(x),6) AS x, round(avg(y),6) AS y, round(avg(z),6) AS z, count(*) AS n FROM m
GROUP BY session,vx,vy,vz HAVING floor(avg(x)/4)=vx AND floor(avg(y)/4)=vy AND floor(avg(z)/4)=vz""")
def voxel_spheres(spark, sf):
    return rounded(voxels.sphere_barycentre(lattice(spark, sf), DL, ["session"]), "x", "y", "z")


# Turned about the vertical by 0.3 per session and set back; the SQL does the same in the turned grid.
@query("voxel_turned", f"""WITH {LATTICE}, r AS (SELECT session, cos(0.3*session+0.05)*(x+0.011) - sin(0.3*session+0.05)*(y+0.007) AS u, sin(0.3*session+0.05)*(x+0.011) + cos(0.3*session+0.05)*(y+0.007) AS v, z+0.003 AS z FROM pts),
g AS (SELECT session, CAST(floor(u/4) AS BIGINT) AS vx, CAST(floor(v/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz, avg(u) AS u, avg(v) AS v, avg(z) AS z, count(*) AS n FROM r GROUP BY ALL)
SELECT session, vx, vy, vz, n, round(cos(0.3*session+0.05)*u + sin(0.3*session+0.05)*v, 6) AS x, round(cos(0.3*session+0.05)*v - sin(0.3*session+0.05)*u, 6) AS y, round(z, 6) AS z FROM g""")
def voxel_turned(spark, sf):
    p = lattice(spark, sf).withColumns({"x": F.col("x") + 0.011, "y": F.col("y") + 0.007, "z": F.col("z") + 0.003})
    turn = axis_angle(Vec.of(0.0, 0.0, 1.0), F.col("session") * 0.3 + 0.05)
    out = voxels.turned_voxel_barycentre(p, DL, ["session"], 7, turn=turn)
    return rounded(out.select("session", "vx", "vy", "vz", "n", "x", "y", "z"), "x", "y", "z")


# However the grid is turned, its voxels hold all points, and their weighted mean is that of the points.
@query("voxel_turned_mass", f"WITH {LATTICE} SELECT session, count(*) AS n, round(avg(x),6) AS x, round(avg(y),6) AS y, round(avg(z),6) AS z FROM pts GROUP BY session")
def voxel_turned_mass(spark, sf):
    out = voxels.turned_voxel_barycentre(lattice(spark, sf), DL, ["session"], 7)
    return out.groupBy("session").agg(F.sum("n").alias("n"), *(r6(F.sum(F.col(a) * F.col("n")) / F.sum("n")).alias(a) for a in "xyz"))


def scored(spark, sf):
    """Lattice points with a score and a normal within a narrow cone."""
    pts = lattice(spark, sf)
    n = F.sqrt(F.lit(1.0) + F.col("y") * F.col("y") / 400 + F.col("z") * F.col("z") / 400)
    return pts.select("*", (F.col("label") / 8).alias("score"), (F.col("y") / 20 / n).alias("nx"),
                      (F.col("z") / 20 / n).alias("ny"), (1 / n).alias("nz"))


SCORED = LATTICE + """,
sc AS (SELECT *, label/8.0 AS score, y/20/sqrt(1+y*y/400+z*z/400) AS nx, z/20/sqrt(1+y*y/400+z*z/400) AS ny,
  1/sqrt(1+y*y/400+z*z/400) AS nz FROM pts)"""


@query("map_first_hit", f"""
WITH {SCORED}, k AS (SELECT *, {KEY} FROM sc),
f AS (SELECT *, row_number() OVER (PARTITION BY vx,vy,vz ORDER BY frame, {LATTICE_ID}) AS a,
  row_number() OVER (PARTITION BY vx,vy,vz ORDER BY -score, frame, {LATTICE_ID}) AS b, count(*) OVER (PARTITION BY vx,vy,vz) AS hits FROM k)
SELECT p.vx,p.vy,p.vz,p.x,p.y,p.z,p.frame AS first_frame, round(q.nx,6) AS nx, round(q.ny,6) AS ny, round(q.nz,6) AS nz, CAST(q.score AS DOUBLE) AS score, q.frame AS normal_frame, p.hits
FROM f p JOIN f q USING (vx,vy,vz) WHERE p.a=1 AND q.b=1""")
def map_first_hit(spark, sf):
    out = mapping.first_hit_map(scored(spark, sf), DL, "frame")
    return rounded(out, "nx", "ny", "nz").select(
        "vx", "vy", "vz", "x", "y", "z", F.col("frame_idx").alias("first_frame"), "nx", "ny", "nz", "score", "normal_frame", "hits")


@query("map_barycentre", SPHERES.replace(LATTICE, SCORED) + f""",
c AS (SELECT vx,vy,vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM m
 GROUP BY vx,vy,vz HAVING floor(avg(x)/4)=vx AND floor(avg(y)/4)=vy AND floor(avg(z)/4)=vz),
o1 AS (SELECT *, {KEY}, row_number() OVER (PARTITION BY floor(x/4),floor(y/4),floor(z/4) ORDER BY frame, {LATTICE_ID}) AS rn FROM sc),
o2 AS (SELECT *, coalesce(max(score) OVER (PARTITION BY vx,vy,vz ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cur FROM o1),
o3 AS (SELECT *, max(CASE WHEN score > cur+0.1 THEN rn END) OVER (PARTITION BY vx,vy,vz) AS start FROM o2),
nn AS (SELECT vx,vy,vz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM o3 WHERE rn >= start AND score > cur-0.1 GROUP BY ALL),
sm AS (SELECT vx,vy,vz,max(score) AS score FROM o1 GROUP BY ALL)
SELECT vx,vy,vz, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, n AS count, CAST(score AS DOUBLE) AS score,
 round(sx/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6),6) AS nx, round(sy/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6),6) AS ny, round(sz/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6),6) AS nz
FROM c JOIN nn USING (vx,vy,vz) JOIN sm USING (vx,vy,vz)""")
def map_barycentre(spark, sf):
    out = mapping.barycentre_map(scored(spark, sf), DL, frame="frame")
    return rounded(out, "x", "y", "z", "nx", "ny", "nz")


@query("map_merge_on_base", f"""
WITH {SCORED}, b AS (SELECT * FROM sc WHERE session < 4), k AS (SELECT *, {KEY}, CASE WHEN session < 4 THEN -1 ELSE frame END AS fr FROM sc),
f AS (SELECT *, row_number() OVER (PARTITION BY vx,vy,vz ORDER BY fr, {LATTICE_ID}) AS a FROM k)
SELECT vx,vy,vz,x,y,z, CAST(fr AS BIGINT) AS first_frame FROM f WHERE a=1""")
def map_merge_on_base(spark, sf):
    pts = scored(spark, sf)
    out = mapping.first_hit_map(pts.where("session >= 4"), DL, "frame", base=pts.where("session < 4"))
    return out.select("vx", "vy", "vz", "x", "y", "z", F.col("frame_idx").alias("first_frame"))


# A base map of four sessions, then the other four merged into it. Base normals count as often as their points and come first.
@query("map_merge_barycentre_base", f"""WITH {SCORED}, dd AS (SELECT unnest([-1,0,1]) AS d), k AS (SELECT *, {KEY} FROM sc),
m AS (SELECT * FROM (SELECT session < 4 AS old, frame, x,y,z, vx+a.d AS vx, vy+b.d AS vy, vz+c.d AS vz FROM k, dd a, dd b, dd c) WHERE (x-(vx+0.5)*4)*(x-(vx+0.5)*4)+(y-(vy+0.5)*4)*(y-(vy+0.5)*4)+(z-(vz+0.5)*4)*(z-(vz+0.5)*4) < 36),
bc AS (SELECT vx,vy,vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM m WHERE old GROUP BY vx,vy,vz HAVING floor(avg(x)/4)=vx AND floor(avg(y)/4)=vy AND floor(avg(z)/4)=vz),
p1 AS (SELECT *, row_number() OVER (PARTITION BY vx,vy,vz ORDER BY frame, {LATTICE_ID}) AS rn FROM k WHERE session < 4),
p2 AS (SELECT *, coalesce(max(score) OVER (PARTITION BY vx,vy,vz ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cur FROM p1),
p3 AS (SELECT *, max(CASE WHEN score > cur+0.1 THEN rn END) OVER (PARTITION BY vx,vy,vz) AS start FROM p2),
pn AS (SELECT vx,vy,vz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM p3 WHERE rn >= start AND score > cur-0.1 GROUP BY ALL), ps AS (SELECT vx,vy,vz,max(score) AS score FROM p1 GROUP BY ALL),
base AS (SELECT vx,vy,vz,x,y,z,n,score, sx/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6) AS nx, sy/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6) AS ny, sz/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6) AS nz FROM bc JOIN pn USING (vx,vy,vz) JOIN ps USING (vx,vy,vz)),
w AS (SELECT vx,vy,vz,x,y,z,1.0 AS w FROM m WHERE NOT old UNION ALL SELECT vx,vy,vz,x,y,z,n FROM base),
c AS (SELECT vx,vy,vz, sum(x*w)/sum(w) AS x, sum(y*w)/sum(w) AS y, sum(z*w)/sum(w) AS z, CAST(sum(w) AS BIGINT) AS n FROM w GROUP BY vx,vy,vz HAVING floor(sum(x*w)/sum(w)/4)=vx AND floor(sum(y*w)/sum(w)/4)=vy AND floor(sum(z*w)/sum(w)/4)=vz),
o1 AS (SELECT vx,vy,vz,score,nx,ny,nz, row_number() OVER (PARTITION BY vx,vy,vz ORDER BY frame, {LATTICE_ID}) AS rn FROM k WHERE session >= 4 UNION ALL SELECT vx,vy,vz,score,nx*n,ny*n,nz*n, 0 FROM base),
o2 AS (SELECT *, coalesce(max(score) OVER (PARTITION BY vx,vy,vz ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cur FROM o1),
o3 AS (SELECT *, max(CASE WHEN score > cur+0.1 THEN rn END) OVER (PARTITION BY vx,vy,vz) AS start FROM o2),
nn AS (SELECT vx,vy,vz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM o3 WHERE rn >= start AND score > cur-0.1 GROUP BY ALL), sm AS (SELECT vx,vy,vz,max(score) AS score FROM o1 GROUP BY ALL)
SELECT vx,vy,vz, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, n AS count, CAST(score AS DOUBLE) AS score,
 round(sx/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6),6) AS nx, round(sy/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6),6) AS ny, round(sz/(sqrt(sx*sx+sy*sy+sz*sz)+1e-6),6) AS nz FROM c JOIN nn USING (vx,vy,vz) JOIN sm USING (vx,vy,vz)""")
def map_merge_barycentre_base(spark, sf):
    pts = scored(spark, sf)
    base = mapping.barycentre_map(pts.where("session < 4"), DL, frame="frame")
    return rounded(mapping.barycentre_map(pts.where("session >= 4"), DL, base, "frame", min_score=-1.5),
                   "x", "y", "z", "nx", "ny", "nz")


@query("raster_occupancy", f"""
WITH {LATTICE}, h AS (SELECT DISTINCT session, CAST(floor(x/2) AS BIGINT) AS px, CAST(floor(y/2) AS BIGINT) AS py FROM pts WHERE z BETWEEN 2 AND 5),
b AS (SELECT session, min(px) x0, max(px) x1, min(py) y0, max(py) y1 FROM h GROUP BY session),
rr AS (SELECT session, unnest(generate_series(x0,x1)) AS px, y0, y1 FROM b),
d AS (SELECT session, px, unnest(generate_series(y0,y1)) AS py FROM rr)
SELECT d.session, d.px, d.py, CAST(h.px IS NOT NULL AS BIGINT) AS occupied FROM d LEFT JOIN h USING (session,px,py)""")
def raster_occupancy(spark, sf):
    return longs(voxels.occupancy_raster(lattice(spark, sf), 2.0, 2, 5, ["session"]), "occupied")


@query("voxel_occupied_pixels", f"""
WITH {LATTICE} SELECT DISTINCT session, CAST(floor(x/2) AS BIGINT) AS px, CAST(floor(y/2) AS BIGINT) AS py FROM pts""")
def voxel_occupied_pixels(spark, sf):
    return voxels.occupied_pixels(lattice(spark, sf), 2.0, ["session"])


@query("voxel_class_frequency", f"""
WITH {LATTICE}, g AS (SELECT session, frame, label, count(*) AS n FROM pts GROUP BY GROUPING SETS ((label),(session,label),(session,frame,label)))
SELECT coalesce(session,-1) AS session, coalesce(frame,-1) AS frame, label, n, round(n / sum(n) OVER (PARTITION BY session, frame), 6) AS share FROM g""")
def voxel_class_frequency(spark, sf):
    return rounded(voxels.class_frequency(lattice(spark, sf), ["session", "frame"]), "share").fillna(-1, ["session", "frame"])


@query("cloud_union", """
SELECT l_quantity AS x, round(l_discount*100) AS y, round(l_tax*100) AS z, CAST(l_linenumber AS BIGINT) AS label, 'line' AS src FROM lineitem
UNION ALL SELECT CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(label AS BIGINT), 'vec' FROM embeddings""")
def cloud_union(spark, sf):
    from .registry import vectors

    cols = ["x", "y", "z", "label"]
    return lattice(spark, sf).select(*cols, F.lit("line").alias("src")).unionByName(
        vectors(spark, sf).select(*cols, F.lit("vec").alias("src")))


@query("cloud_masks", f"""
WITH {LATTICE} SELECT session, count(*) FILTER (x>25 AND y>5) AS both_masks, count(*) FILTER (NOT (x>25)) AS complement,
 count(*) FILTER (x>25 OR y>5) AS either FROM pts GROUP BY session""")
def cloud_masks(spark, sf):
    a, b = F.col("x") > 25, F.col("y") > 5
    return lattice(spark, sf).groupBy("session").agg(
        F.count_if(a & b).alias("both_masks"), F.count_if(~a).alias("complement"), F.count_if(a | b).alias("either"))
