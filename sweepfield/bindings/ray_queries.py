"""Ray evidence of a small fixed-pose scanner over a voxel map of the lattice."""


from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import voxels
from .registry import LATTICE, lattice, longs, query, rounded, table

DL, TH, PH = 4.0, 0.1, 0.2

# Map: voxel barycentres. Frames: one per line number; its pose is a shift along x.
SETUP = f"""WITH {LATTICE}, k AS (SELECT CAST(floor(x/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz, x,y,z FROM pts),
mp AS (SELECT vx*10000+vy*100+vz AS map_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, CASE WHEN (vx+vy+vz)%2=0 THEN 0.6 ELSE 0.0 END AS nx, 0.0 AS ny, CASE WHEN (vx+vy+vz)%2=0 THEN 0.8 ELSE 0.0 END AS nz0,
 CASE WHEN (vx+vy+vz)%2=0 THEN 0.0 ELSE 1.0 END AS ny0 FROM k GROUP BY vx,vy,vz),
fp AS (SELECT DISTINCT label AS frame, x-30.5 AS x, y-4.25 AS y, z-3.75 AS z FROM pts WHERE (x + 3*y + 5*z) % 7 <> label),
po AS (SELECT DISTINCT label AS frame, 30.5+label*0.25 AS t0, 4.25 AS t1, 3.75 AS t2 FROM pts),
w AS (SELECT frame, x+t0 AS x, y+t1 AS y, z+t2 AS z FROM fp JOIN po USING (frame)),
ok AS (SELECT DISTINCT frame, CAST(floor(x/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz FROM w),
mv AS (SELECT map_id, CAST(floor(x/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz FROM mp),
hit AS (SELECT DISTINCT frame, map_id FROM ok JOIN mv ON abs(ok.vx-mv.vx)<=1 AND abs(ok.vy-mv.vy)<=1 AND abs(ok.vz-mv.vz)<=1),
pl AS (SELECT frame, sqrt(x*x+y*y+z*z) AS rho, atan2(sqrt(x*x+y*y),z) AS theta, atan2(y,x)+pi()/2 AS phi FROM fp),
g AS (SELECT frame, min(theta)-0.05 AS th0, min(phi)-0.1 AS ph0 FROM pl GROUP BY frame),
fr AS (SELECT frame, floor((theta-th0)/0.1) AS i, floor((phi-ph0)/0.2) AS j, min(rho) - greatest(0.5, min(rho)*0.05) AS free FROM pl JOIN g USING (frame) GROUP BY ALL),
bd AS (SELECT frame, min(x)-0.5 AS lx, max(x)+0.5 AS hx, min(y)-0.5 AS ly, max(y)+0.5 AS hy, min(z)-0.5 AS lz, max(z)+0.5 AS hz FROM w GROUP BY frame)
"""


def setup(spark, sf):
    pts = lattice(spark, sf)
    even = F.pmod(F.col("vx") + F.col("vy") + F.col("vz"), F.lit(2)) == 0
    m = voxels.voxel_barycentre(pts, 4.0).select(
        (F.col("vx") * 10000 + F.col("vy") * 100 + F.col("vz")).alias("map_id"), "x", "y", "z",
        F.when(even, 0.6).otherwise(0.0).alias("nx"), F.when(even, 0.0).otherwise(1.0).alias("ny"), F.when(even, 0.8).otherwise(0.0).alias("nz"))
    seen = F.pmod(F.col("x") + 3 * F.col("y") + 5 * F.col("z"), F.lit(7.0)) != F.col("label")
    fp = pts.where(seen).select(F.col("label").alias("frame"), (F.col("x") - 30.5).alias("x"), (F.col("y") - 4.25).alias("y"), (F.col("z") - 3.75).alias("z")).distinct()
    po = pts.select(F.col("label").alias("frame")).distinct()
    one, zero = F.lit(1.0), F.lit(0.0)
    po = po.withColumns({f"r{i}{j}": one if i == j else zero for i in range(3) for j in range(3)} | {
        "t0": 30.5 + F.col("frame") * 0.25, "t1": F.lit(4.25), "t2": F.lit(3.75)})
    return fp, po, m


EVIDENCE = SETUP.replace("/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz FROM w)", "/0.5) AS BIGINT) AS vx, CAST(floor(y/0.5) AS BIGINT) AS vy, CAST(floor(z/0.5) AS BIGINT) AS vz FROM w)").replace(
    "/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz FROM mp)", "/0.5) AS BIGINT) AS vx, CAST(floor(y/0.5) AS BIGINT) AS vy, CAST(floor(z/0.5) AS BIGINT) AS vz FROM mp)") + """,
lc AS (SELECT frame, map_id, m.x-t0 AS x, m.y-t1 AS y, m.z-t2 AS z, nx, ny0 AS ny, nz0 AS nz FROM mp m CROSS JOIN po JOIN bd USING (frame)
 WHERE m.x BETWEEN lx AND hx AND m.y BETWEEN ly AND hy AND m.z BETWEEN lz AND hz),
lp AS (SELECT *, sqrt(x*x+y*y+z*z) AS rho, atan2(sqrt(x*x+y*y),z) AS theta, atan2(y,x)+pi()/2 AS phi FROM lc),
pass AS (SELECT lp.frame, map_id FROM lp JOIN g USING (frame) JOIN fr ON fr.frame=lp.frame AND fr.i=floor((theta-th0)/0.1) AND fr.j=floor((phi-ph0)/0.2)
 WHERE rho > 1.0 AND rho < free AND (abs(nz)>0.5 OR acos(least(abs((x*nx+y*ny+z*nz)/rho),1.0)) < 5*pi()/12)),
al AS (SELECT frame, map_id, max(o) AS o FROM (SELECT *, 1 AS o FROM hit UNION ALL SELECT *, 0 AS o FROM pass) GROUP BY ALL),
evd AS (SELECT map_id, count(*) AS count, CAST(sum(1-o) AS BIGINT) AS prob FROM al GROUP BY map_id)"""


def evidence(spark, sf, by=()):
    return ev.ray_evidence(*setup(spark, sf), ["frame"], TH, PH, 0.5, by)


@query("evidence_counts", EVIDENCE + " SELECT * FROM evd")
def evidence_counts(spark, sf):
    return evidence(spark, sf)


@query("evidence_occupied_hits", EVIDENCE + " SELECT * FROM hit")
def evidence_occupied_hits(spark, sf):
    from ..functions.rigid import move_points

    fp, po, m = setup(spark, sf)
    return ev.occupied_hits(move_points(fp, po, ["frame"]), m, ["frame"], 0.5)


@query("evidence_seen_through", EVIDENCE + " SELECT * FROM pass")
def evidence_seen_through(spark, sf):
    return ev.seen_through(*setup(spark, sf), ["frame"], TH, PH, 0.5)


@query("evidence_probability", EVIDENCE + """ SELECT map_id, count, prob, round(prob/(count+1e-6) - CASE WHEN count<3 THEN 2 ELSE 0 END,6) AS short_prob,
 round(1-prob/(count+1e-6) - CASE WHEN count<3 THEN 2 ELSE 0 END,6) AS long_prob FROM evd""")
def evidence_probability(spark, sf):
    return rounded(ev.movable_probabilities(evidence(spark, sf), 3), "short_prob", "long_prob")


@query("evidence_strongest", EVIDENCE + """, pf AS (SELECT frame, map_id, count(*) AS c, sum(1-o) AS p FROM al GROUP BY ALL)
SELECT map_id, round(max(p/(c+1e-6)),6) AS short_prob FROM pf GROUP BY map_id""")
def evidence_strongest(spark, sf):
    e = evidence(spark, sf, ["frame"])
    return rounded(ev.strongest_over_sessions(ev.movable_probabilities(e, 1, "zero")), "short_prob")


@query("evidence_clean_map", EVIDENCE + """ SELECT mp.map_id, round(mp.x,6) AS x FROM mp LEFT JOIN evd USING (map_id)
WHERE mp.z < 2 OR coalesce(CASE WHEN count<3 THEN 0 ELSE prob/(count+1e-6) END,0) < 0.5""")
def evidence_clean_map(spark, sf):
    fp, po, m = setup(spark, sf)
    probs = ev.movable_probabilities(ev.ray_evidence(fp, po, m, ["frame"], TH, PH, 0.5), 3, "zero")
    return rounded(ev.clean_map(m, probs, m.where("z < 2"), 0.5).select("map_id", "x"), "x")


@query("evidence_classes", EVIDENCE + """, pb AS (SELECT map_id, prob/(count+1e-6) - CASE WHEN count<3 THEN 2 ELSE 0 END AS s, 1-prob/(count+1e-6) - CASE WHEN count<3 THEN 2 ELSE 0 END AS l FROM evd)
SELECT mp.map_id, CAST(CASE WHEN mp.z<2 THEN 1 WHEN mp.x>40 THEN 2 WHEN l>0.6 THEN 3 WHEN s>0.7 THEN 4 ELSE 0 END AS BIGINT) AS classif FROM mp LEFT JOIN pb USING (map_id)""")
def evidence_classes(spark, sf):
    fp, po, m = setup(spark, sf)
    probs = ev.movable_probabilities(ev.ray_evidence(fp, po, m, ["frame"], TH, PH, 0.5), 3)
    return longs(ev.classify_map(m, probs, m.where("x > 40"), m.where("z < 2")).select("map_id", "classif"), "classif")


@query("evidence_classes_legacy", EVIDENCE + """, pb AS (SELECT map_id, CASE WHEN count<3 THEN 0 ELSE prob/(count+1e-6) END AS s FROM evd)
SELECT mp.map_id, CAST(CASE WHEN mp.z<2 THEN 1 WHEN s>0.7 THEN 3 WHEN s>0.2 THEN 4 WHEN mp.x>40 THEN 2 ELSE 0 END AS BIGINT) AS classif FROM mp LEFT JOIN pb USING (map_id)""")
def evidence_classes_legacy(spark, sf):
    from ..plans.annotation import legacy_classes

    fp, po, m = setup(spark, sf)
    probs = ev.movable_probabilities(ev.ray_evidence(fp, po, m, ["frame"], TH, PH, 0.5), 3, "zero")
    out = legacy_classes(m, probs, probs, m.where("z < 2"), m.where("x > 40"), 0.7, 0.2, swap_codes=True)
    return longs(out.select("map_id", "classif"), "classif")


@query("evidence_polar_image", SETUP + """, pw AS (SELECT frame, sqrt(x*x+y*y+z*z) AS rho, atan2(sqrt(x*x+y*y),z) AS theta, (1.5*pi()-atan2(y,x)) - 2*pi()*floor((1.5*pi()-atan2(y,x))/(2*pi())) AS phi, x*10000+y*100+z AS o FROM fp),
bx AS (SELECT frame, min(theta) AS a, max(theta) AS b, min(phi) AS c, max(phi) AS d FROM pw GROUP BY frame),
im AS (SELECT frame, floor(theta/0.1) AS i, floor(phi/0.2/0.1) AS j, arg_max(rho, o) AS rg FROM pw GROUP BY ALL),
lm AS (SELECT frame, map_id, mp.x-t0 AS x, mp.y-t1 AS y, mp.z-t2 AS z FROM mp CROSS JOIN po),
lw AS (SELECT *, sqrt(x*x+y*y+z*z) AS rho, atan2(sqrt(x*x+y*y),z) AS theta, (1.5*pi()-atan2(y,x)) - 2*pi()*floor((1.5*pi()-atan2(y,x))/(2*pi())) AS phi FROM lm),
ht AS (SELECT map_id, rg-rho AS gap FROM lw JOIN bx USING (frame) JOIN im ON im.frame=lw.frame AND im.i=floor(theta/0.1) AND im.j=floor(phi/0.2/0.1)
 WHERE theta>a AND theta<b AND phi>c AND phi<d AND rg>1.0 AND rg-rho > -0.15)
SELECT map_id, round(sum(least(greatest((gap-0.05)/0.10,0),1)),5) AS movable, round(sum(least(greatest((abs(gap)-0.15)/(-0.10),0),1)),5) AS still, count(*) AS count FROM ht GROUP BY map_id""")
def evidence_polar_image(spark, sf):
    fp, po, m = setup(spark, sf)
    fp = fp.withColumn("o", F.col("x") * 10000 + F.col("y") * 100 + F.col("z"))
    out = ev.polar_image_evidence(fp, po, m, ["frame"], theta_res=0.1, order="o")
    return out.select("map_id", F.round("movable", 5).alias("movable"), F.round("still", 5).alias("still"), "count")


# A scene that grows with the tables: sixteen scanners in a yard of orders, every other one turned.
YARD = """WITH fp AS (SELECT l_suppkey % 16 AS frame, (l_partkey % 401 - 200) / 10.0 + l_discount AS x, (l_orderkey % 397 - 198) / 10.0 + l_tax AS y, (l_quantity - 25) / 10.0 AS z FROM lineitem),
po AS (SELECT f AS frame, CASE WHEN f % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6 END AS c, CASE WHEN f % 2 = 0 THEN 0.0::DOUBLE ELSE 0.8 END AS s, f * 0.5::DOUBLE AS t0, f % 4 * 1.0::DOUBLE AS t1, 0.25::DOUBLE AS t2 FROM (SELECT DISTINCT frame AS f FROM fp)),
mp AS (SELECT o_orderkey AS map_id, (o_orderkey % 211 - 105) / 4.0 + o_totalprice / 1000000 AS x, (o_custkey % 199 - 99) / 4.0 + o_totalprice / 2000000 AS y, (o_orderkey % 50 - 25) / 12.0 + o_totalprice / 3000000 AS z,
 CASE o_orderkey % 3 WHEN 0 THEN 0.6 ELSE 0.0 END AS nx, CASE o_orderkey % 3 WHEN 1 THEN 1.0 ELSE 0.0 END AS ny, CASE o_orderkey % 3 WHEN 0 THEN 0.8 WHEN 2 THEN 1.0 ELSE 0.0 END AS nz FROM orders),
w AS (SELECT frame, c*x - s*y + t0 AS x, s*x + c*y + t1 AS y, z + t2 AS z FROM fp JOIN po USING (frame)),
pl AS (SELECT frame, sqrt(x*x+y*y+z*z) AS rho, atan2(sqrt(x*x+y*y),z) AS theta, atan2(y,x)+pi()/2 AS phi FROM fp),
g AS (SELECT frame, min(theta)-0.025 AS th0, min(phi)-0.05 AS ph0, max(theta)+0.05 AS th1, max(phi)+0.1 AS ph1, max(rho) AS far FROM pl GROUP BY frame),
fr AS (SELECT frame, floor((theta-th0)/0.05) AS i, floor((phi-ph0)/0.1) AS j, min(rho) - greatest(0.5, min(rho)*0.025) AS free FROM pl JOIN g USING (frame) GROUP BY ALL),
bd AS (SELECT frame, min(x)-0.5 AS lx, max(x)+0.5 AS hx, min(y)-0.5 AS ly, max(y)+0.5 AS hy, min(z)-0.5 AS lz, max(z)+0.5 AS hz FROM w GROUP BY frame),
lc AS (SELECT frame, map_id, c*(x-t0)+s*(y-t1) AS x, c*(y-t1)-s*(x-t0) AS y, z-t2 AS z, c*nx+s*ny AS nx, c*ny-s*nx AS ny, nz,
 pow(greatest(floor(x/8)*8-t0, t0-floor(x/8)*8-8, 0), 2) + pow(greatest(floor(y/8)*8-t1, t1-floor(y/8)*8-8, 0), 2) AS gap FROM mp CROSS JOIN po JOIN bd USING (frame) WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz),
lp AS (SELECT *, sqrt(x*x+y*y+z*z) AS rho, atan2(sqrt(x*x+y*y),z) AS theta, atan2(y,x)+pi()/2 AS phi FROM lc),
mf AS (SELECT frame, max(free) AS farthest FROM fr GROUP BY frame),
cd AS (SELECT frame, map_id, rho, gap <= farthest*farthest AS near, floor((theta-th0)/0.05) AS i, floor((phi-ph0)/0.1) AS j FROM lp JOIN g USING (frame) JOIN mf USING (frame) WHERE rho > 1.0 AND rho < far AND theta BETWEEN th0 AND th1 AND phi BETWEEN ph0 AND ph1
 AND (abs(nz)>0.5 OR acos(least(abs((x*nx+y*ny+z*nz)/rho),1.0)) < 5*pi()/12)),
sc AS (SELECT frame, floor(i / 8) AS si, floor(j / 8) AS sj, max(free) AS most FROM fr GROUP BY ALL),
tj AS (SELECT cd.*, coalesce(rho < most, false) AS ahead, coalesce(rho < free, false) AS through FROM cd LEFT JOIN fr USING (frame, i, j) LEFT JOIN sc ON sc.frame = cd.frame AND si = floor(cd.i / 8) AND sj = floor(cd.j / 8))"""


def yard(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    fp = line.select((F.col("l_suppkey") % 16).alias("frame"), ((F.col("l_partkey") % 401 - 200) / 10.0 + F.col("l_discount")).alias("x"),
                     ((F.col("l_orderkey") % 397 - 198) / 10.0 + F.col("l_tax")).alias("y"), ((F.col("l_quantity") - 25) / 10.0).alias("z"))
    f, turned = F.col("frame"), F.col("frame") % 2 != 0
    c, s = F.when(turned, 0.6).otherwise(1.0), F.when(turned, 0.8).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = {"r00": c, "r01": -s, "r02": zero, "r10": s, "r11": c, "r12": zero, "r20": zero, "r21": zero, "r22": one}
    po = fp.select("frame").distinct().withColumns(turn | {"t0": f * 0.5, "t1": (f % 4).cast("double"), "t2": F.lit(0.25)})
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    m = orders.select(k.alias("map_id"), ((k % 211 - 105) / 4.0 + price / 1000000).alias("x"), ((F.col("o_custkey") % 199 - 99) / 4.0 + price / 2000000).alias("y"),
                      ((k % 50 - 25) / 12.0 + price / 3000000).alias("z"), F.when(k % 3 == 0, 0.6).otherwise(0.0).alias("nx"),
                      F.when(k % 3 == 1, 1.0).otherwise(0.0).alias("ny"), F.when(k % 3 == 0, 0.8).when(k % 3 == 2, 1.0).otherwise(0.0).alias("nz"))
    return fp, po, m


@query("evidence_yard", YARD + """, hf AS (SELECT DISTINCT frame, floor(x/0.5) AS vx, floor(y/0.5) AS vy, floor(z/0.5) AS vz FROM w), hm AS (SELECT floor(x/0.5) AS vx, floor(y/0.5) AS vy, floor(z/0.5) AS vz, min(map_id) AS map_id FROM mp GROUP BY ALL),
nb AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM (SELECT unnest([-1,0,1]) AS i) a, (SELECT unnest([-1,0,1]) AS i) b, (SELECT unnest([-1,0,1]) AS i) c),
hb AS (SELECT DISTINCT frame, vx+dx AS vx, vy+dy AS vy, vz+dz AS vz FROM hf, nb),
al AS (SELECT frame, map_id, max(o) AS o FROM (SELECT frame, map_id, 1 AS o FROM hb JOIN hm USING (vx, vy, vz) UNION ALL SELECT frame, map_id, 0 AS o FROM tj WHERE through) GROUP BY ALL)
SELECT map_id, count(*) AS count, CAST(sum(1-o) AS BIGINT) AS prob FROM al GROUP BY map_id""")
def evidence_yard(spark, sf):
    return ev.ray_evidence(*yard(spark, sf), ["frame"], 0.05, 0.1, 0.5)


@query("evidence_pruning", YARD + """ SELECT frame, count(*) FILTER (near) AS n_frustum, count(*) FILTER (ahead) AS n_sector, count(*) FILTER (through) AS n_through FROM tj GROUP BY frame""")
def evidence_pruning(spark, sf):
    """How many map points of the tiles in reach each level of the range image leaves."""
    return ev.pruning(*yard(spark, sf), ["frame"], 0.05, 0.1, 0.5)
