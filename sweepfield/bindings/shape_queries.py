"""Moments, normals, planes and registration."""


from pyspark.sql import functions as F

from ..operators import planes as pl
from ..operators import shape as sh
from .registry import LATTICE, VECTORS, lattice, query, r6, rounded, vectors

CLOUD = f"""WITH {VECTORS}, m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS cxx, covar_pop(x,y) AS cxy, covar_pop(x,z) AS cxz,
 var_pop(y) AS cyy, covar_pop(y,z) AS cyz, var_pop(z) AS czz FROM vec GROUP BY label),
q AS (SELECT *, (cxx+cyy+czz)/3 AS q, cxy*cxy+cxz*cxz+cyz*cyz AS p1 FROM m),
p AS (SELECT *, sqrt((pow(cxx-q,2)+pow(cyy-q,2)+pow(czz-q,2)+2*p1)/6) AS p FROM q),
d AS (SELECT *, acos(greatest(-1.0,least(1.0,(((cxx-q)/p)*((cyy-q)/p*((czz-q)/p)-(cyz/p)*(cyz/p))-(cxy/p)*((cxy/p)*((czz-q)/p)-(cyz/p)*(cxz/p))+(cxz/p)*((cxy/p)*(cyz/p)-((cyy-q)/p)*(cxz/p)))/2)))/3 AS phi FROM p),
e AS (SELECT *, q+2*p*cos(phi) AS l2, q+2*p*cos(phi+2*pi()/3) AS l0 FROM d)"""


# The SQL side gets the eigenvalues from the cubic formula, not from a solver.
@query("pca_local", CLOUD + """ SELECT label, n, round(mx,6) AS mx, round(my,6) AS my, round(mz,6) AS mz, round(cxx,6) AS cxx, round(cxy,6) AS cxy, round(l0,6) AS l0, round(3*q-l0-l2,6) AS l1, round(l2,6) AS l2,
 round((3*q-2*l0-l2)/(l2+1e-9),6) AS planarity, round(1-(3*q-l0-l2)/(l2+1e-9),6) AS linearity FROM e""")
def pca_local(spark, sf):
    from ..functions.geometry import eigen_ratios

    out = sh.local_pca(vectors(spark, sf), ["label"], 4)
    ratios = eigen_ratios("l0", "l1", "l2")
    out = out.withColumns({k: ratios[k] for k in ("planarity", "linearity")})
    names = ["mx", "my", "mz", "cxx", "cxy", "l0", "l1", "l2", "planarity", "linearity"]
    return rounded(out, *names).select("label", "n", *names)


# In its own frame a group has the eigenvalues as variances and zero means.
@query("pca_group_frame", CLOUD + " SELECT label, round(l0,6) AS vx, round(3*q-l0-l2,6) AS vy, round(l2,6) AS vz, 0.0 AS mean_x FROM e")
def pca_group_frame(spark, sf):
    out = sh.group_frame(vectors(spark, sf), ["label"])
    return out.groupBy("label").agg(*(r6(F.var_pop(a)).alias("v" + a) for a in "xyz"), F.abs(r6(F.avg("x"))).alias("mean_x"))


@query("plane_fit", CLOUD + " SELECT label, n, round(sqrt(l0),6) AS rms FROM e ORDER BY n DESC, label LIMIT 5")
def plane_fit(spark, sf):
    return rounded(sh.fit_planes(vectors(spark, sf), ["label"], 10, 5), "rms").select("label", "n", "rms")


@query("pca_angular_resolution", f"""WITH {LATTICE}, t AS (SELECT frame, atan2(sqrt(x*x+y*y), z-4.5) AS th FROM pts)
SELECT frame, round(min(th),6) AS min_theta, round(max(th),6) AS max_theta, round((max(th)-min(th))/31,6) AS angle_res FROM t GROUP BY frame""")
def pca_angular_resolution(spark, sf):
    p = lattice(spark, sf).withColumn("z", F.col("z") - 4.5)
    return rounded(sh.angular_resolution(p, ["frame"], 32), "min_theta", "max_theta", "angle_res")


@query("pca_frame_normals")
def pca_frame_normals(spark, sf):
    v = vectors(spark, sf).select("label", "id", *((F.col(a) * 10 + b).alias(a) for a, b in zip("xyz", (5, 5, 0))))
    out = sh.frame_normals(v, ["label"], 8, outlier_jump=0.5)
    return rounded(out, "nx", "ny", "nz", "planarity", "linearity", "score").select("id", "nx", "ny", "nz", "planarity", "linearity", "score")


def _normals(spark, sf):
    v = vectors(spark, sf)
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return v.select("*", *((F.col(a) / n).alias("n" + a) for a in "xyz"))


NORMALS = f"""WITH {VECTORS}, nv AS (SELECT *, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM vec),
b AS (SELECT CAST(floor(nx/0.25) AS BIGINT) AS bx, CAST(floor(ny/0.25) AS BIGINT) AS "by", CAST(floor(nz/0.25) AS BIGINT) AS bz, count(*) AS n FROM nv GROUP BY ALL),
o AS (SELECT generate_series AS i FROM generate_series(-2,2)), w AS (SELECT a.i AS i, c.i AS j, d.i AS k, exp(-(a.i*a.i+c.i*c.i+d.i*d.i)/(2+1e-6)) AS w FROM o a, o c, o d),
s AS (SELECT b.bx, b."by", b.bz, any_value(b.n) AS n, sum(c.n*w.w)/(SELECT sum(w) FROM w) AS smooth FROM b, w, b c WHERE c.bx=b.bx+w.i AND c."by"=b."by"+w.j AND c.bz=b.bz+w.k GROUP BY ALL)"""


@query("pca_normal_histogram", NORMALS + """ SELECT bx, "by", bz, n, round(smooth,6) AS smooth FROM s""")
def pca_normal_histogram(spark, sf):
    return rounded(sh.normal_histogram(_normals(spark, sf), [], 0.25), "smooth")


@query("pca_dominant_normals", NORMALS + """, lim AS (SELECT quantile_cont(smooth,0.8) AS q FROM s) SELECT id, CASE WHEN smooth > q + 1e-12 THEN 1.0 ELSE 0.0 END AS weight FROM nv
 JOIN s ON s.bx=floor(nx/0.25) AND s."by"=floor(ny/0.25) AND s.bz=floor(nz/0.25), lim""")
def pca_dominant_normals(spark, sf):
    v = _normals(spark, sf).withColumn("g", F.lit(0))
    return sh.dominant_normal_weights(v, ["g"], 0.25).select("id", "weight")


@query("pca_normals_orientation", NORMALS + """, lim AS (SELECT quantile_cont(smooth,0.8) AS q FROM s), t AS (SELECT (bx+0.5)*0.25 AS x, ("by"+0.5)*0.25 AS y, (bz+0.5)*0.25 AS z FROM s, lim WHERE smooth > q + 1e-12)
SELECT count(*) AS bins, round(avg(x*x)+avg(y*y)+avg(z*z),6) AS trace FROM t""")
def pca_normals_orientation(spark, sf):
    out = sh.normals_orientation(_normals(spark, sf).withColumn("g", F.lit(0)), ["g"], 0.25)
    return out.select("bins", r6(F.col("l0") + F.col("l1") + F.col("l2")).alias("trace"))


@query("plane_ground_height", f"""WITH {LATTICE}, p AS (SELECT session, frame, z+price/1048576.0::DOUBLE AS z FROM pts), l AS (SELECT session, frame, min(z) AS z0 FROM p GROUP BY ALL)
SELECT session, frame, round(quantile_cont(z,0.5),6) AS ground_z FROM p JOIN l USING (session,frame) WHERE z < z0+0.05 GROUP BY ALL""")
def plane_ground_height(spark, sf):
    p = lattice(spark, sf).withColumn("z", F.col("z") + F.col("price") / 1048576.0)
    return rounded(pl.ground_height(p, ["session", "frame"]), "ground_z")


# All points with a tax below five percent lie in one plane, far larger than any other.
@query("plane_ransac", f"WITH {LATTICE} SELECT session, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d, count(*) FILTER (z<5) AS votes FROM pts GROUP BY session")
def plane_ransac(spark, sf):
    p = lattice(spark, sf).withColumn("z", F.when(F.col("z") < 5, 0.0).otherwise(F.col("z")))
    out = pl.ransac_plane(p, ["session"], 0.1, seed=3)
    return out.select("session", F.abs(r6("c")).alias("c"), F.abs(r6("d")).alias("d"), "votes")


@query("plane_ground_points", f"WITH {LATTICE} SELECT session, count(*) FILTER (z<5) AS n, 0.0::DOUBLE AS z_max FROM pts GROUP BY session")
def plane_ground_points(spark, sf):
    p = lattice(spark, sf).withColumns({"z": F.when(F.col("z") < 5, 0.0).otherwise(F.col("z")), "nz": F.when(F.col("z") < 5, 1.0).otherwise(0.0)})
    out = pl.extract_ground(p, ["session"], remove_dist=0.15)
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("z_max"))


@query("normal_errors", f"""WITH {VECTORS} SELECT label, round(sqrt(avg(pow(acos(least(abs(x*y+y*z+z*x)/(sqrt(x*x+y*y+z*z)*sqrt(x*x+y*y+z*z)+1e-6),1.0)),2))),6) AS rmse, count(*) AS n FROM vec GROUP BY label""")
def normal_errors(spark, sf):
    v = vectors(spark, sf)
    pairs = v.select("label", *(F.col(a).alias("n" + a) for a in "xyz"), F.col("y").alias("gx"), F.col("z").alias("gy"), F.col("x").alias("gz"))
    return rounded(sh.normal_errors(pairs, ["label"]), "rmse")


MATCH = f"""WITH {VECTORS}, m AS (SELECT *, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM vec),
p AS (SELECT label AS fr, id, x+0.011 AS x, y-0.007 AS y, z+0.005 AS z FROM vec),
d AS (SELECT p.fr, p.id, p.x,p.y,p.z, m.x AS mx,m.y AS my,m.z AS mz, m.nx,m.ny,m.nz, (p.x-m.x)*(p.x-m.x)+(p.y-m.y)*(p.y-m.y)+(p.z-m.z)*(p.z-m.z) AS d2 FROM p, m),
h AS (SELECT *, abs((mx-x)*nx+(my-y)*ny+(mz-z)*nz) AS planar FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2) AS rn FROM d) WHERE rn=1 AND d2<0.0025),
k AS (SELECT * FROM h WHERE planar < 0.02)"""


def matches(spark, sf):
    m = _normals(spark, sf).withColumnRenamed("id", "map_id").drop("label", "f")
    p = vectors(spark, sf).select(F.col("label").alias("fr"), "id", (F.col("x") + 0.011).alias("x"), (F.col("y") - 0.007).alias("y"), (F.col("z") + 0.005).alias("z"))
    return sh.matched_points(p, m, 0.05, 0.02)


@query("registration_residuals", MATCH + " SELECT fr, round(sqrt(avg(d2)),6) AS rms, round(sqrt(avg(planar*planar)),6) AS planar_rms, count(*) AS n FROM k GROUP BY fr")
def registration_residuals(spark, sf):
    return rounded(sh.registration_residuals(matches(spark, sf), ["fr"]), "rms", "planar_rms")


@query("registration_sums", MATCH + """ SELECT fr, round(sum((y*nz-z*ny)*(y*nz-z*ny)),6) AS a00, round(sum((y*nz-z*ny)*nx),6) AS a03, round(sum(nx*nx),6) AS a33, round(sum(nz*nz),6) AS a55,
 round(sum(nx*(nx*(mx-x)+ny*(my-y)+nz*(mz-z))),6) AS b3, round(sum((x*ny-y*nx)*(nx*(mx-x)+ny*(my-y)+nz*(mz-z))),6) AS b2 FROM k GROUP BY fr""")
def registration_sums(spark, sf):
    out = sh.point_to_plane_sums(matches(spark, sf), ["fr"])
    return rounded(out, "a00", "a03", "a33", "a55", "b3", "b2").select("fr", "a00", "a03", "a33", "a55", "b3", "b2")


# The solution put back into the normal equations gives their right sides, which SQL can sum.
@query("registration_step", MATCH + """, e AS (SELECT *, nx*(mx-x)+ny*(my-y)+nz*(mz-z) AS g FROM k)
SELECT fr, round(sum((y*nz-z*ny)*g),4) AS b0, round(sum((z*nx-x*nz)*g),4) AS b1, round(sum((x*ny-y*nx)*g),4) AS b2, round(sum(nx*g),4) AS b3, round(sum(ny*g),4) AS b4, round(sum(nz*g),4) AS b5 FROM e GROUP BY fr""")
def registration_step(spark, sf):
    m = matches(spark, sf)
    both = sh.point_to_plane_step(m, ["fr"]).join(sh.point_to_plane_sums(m, ["fr"]).drop(*(f"b{i}" for i in range(6))), "fr")
    x = ("rx", "ry", "rz", "tx", "ty", "tz")
    back = {f"b{i}": F.round(sum((F.col(f"a{min(i, j)}{max(i, j)}") * F.col(x[j]) for j in range(1, 6)), F.col(f"a0{i}") * F.col(x[0])), 4) for i in range(6)}
    return both.select("fr", *(c.alias(n) for n, c in back.items()))


# Lattice voxels at z = 0 and at z = 8 are two separate flat pieces.
SEGMENT = f"""WITH {LATTICE}, s AS (SELECT DISTINCT x, y, CASE WHEN z<4 THEN 0.0 ELSE 8.0 END AS z FROM pts)
SELECT z AS height, count(*) AS n FROM s GROUP BY z"""


@query("plane_segments", SEGMENT)
def plane_segments(spark, sf):
    p = lattice(spark, sf).select("x", "y", F.when(F.col("z") < 4, 0.0).otherwise(8.0).alias("z")).distinct()
    p = p.select((F.col("x") * 100000 + F.col("y") * 100 + F.col("z")).cast("long").alias("id"), "x", "y", "z",
                 F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    members, planes = pl.segment_voxels(p, 1.0)
    return planes.select(F.abs(F.round("d")).alias("height"), "n")


@query("plane_scan_segments", SEGMENT.replace("AS height", "AS height"))
def plane_scan_segments(spark, sf):
    p = lattice(spark, sf).select("x", "y", F.when(F.col("z") < 4, 0.0).otherwise(8.0).alias("z")).distinct()
    p = p.select((F.col("x") * 100000 + F.col("y") * 100 + F.col("z")).cast("long").alias("id"), "x", "y", "z",
                 F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"),
                 F.col("y").cast("long").alias("line"), F.col("x").cast("long").alias("column"), F.col("z").cast("int").alias("scan"))
    members, planes = pl.segment_scan(p, ["scan"])
    return planes.select(F.abs(F.round("d")).alias("height"), "n")
