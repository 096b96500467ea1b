"""Distance joins on continuous points, and label transfer from a voxel map."""

from pyspark.sql import functions as F

from ..operators import neighbors as nb
from ..operators import voxels
from .registry import LATTICE, VECTORS, lattice, query, r6, rounded, table, vectors

R = 0.1
PAIRS = f"""WITH {VECTORS}, pr AS (SELECT q.label, q.id AS q_id, s.id AS s_id, s.label AS s_label, s.f, q.x qx, q.y qy, q.z qz, s.x sx, s.y sy, s.z sz,
 (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z) AS d2 FROM vec q, vec s)"""


def both(spark, sf):
    v = vectors(spark, sf)
    return v.withColumnRenamed("id", "q_id"), v.withColumnRenamed("id", "s_id")


@query("radius_join_grouped", PAIRS + f"""
SELECT label, q_id, s_id, round(d2,6) AS d2, rank FROM (
 SELECT label, q_id, s_id, d2, row_number() OVER (PARTITION BY q_id ORDER BY d2, s_id) AS rank FROM pr WHERE label=s_label AND d2 < {R}*{R})""")
def radius_join_grouped(spark, sf):
    q, s = both(spark, sf)
    out = nb.radius_neighbours(q, s, R, ["label"])
    return rounded(out, "d2").withColumn("rank", F.col("rank").cast("long"))


@query("radius_join_index_order", PAIRS + f"""
SELECT q_id, s_id, round(d2,6) AS d2, row_number() OVER (PARTITION BY q_id ORDER BY s_id) AS rank FROM pr WHERE d2 < {R}*{R}""")
def radius_join_index_order(spark, sf):
    q, s = both(spark, sf)
    out = nb.index_ordered_neighbours(q, s, R)
    return rounded(out, "d2").withColumn("rank", F.col("rank").cast("long"))


@query("radius_join_limited", PAIRS + f"""
SELECT q_id, s_id, rank FROM (SELECT q_id, s_id, row_number() OVER (PARTITION BY q_id ORDER BY d2, s_id) AS rank FROM pr WHERE d2 < {R}*{R}) WHERE rank <= 5""")
def radius_join_limited(spark, sf):
    q, s = both(spark, sf)
    out = nb.radius_neighbours(q, s, R, limit=5)
    return out.select("q_id", "s_id", F.col("rank").cast("long").alias("rank"))


@query("nearest_join", PAIRS + """
SELECT q_id, s_id, CAST(s_label AS BIGINT) AS s_label, round(d2,6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, s_id) AS rn FROM pr WHERE q_id<>s_id AND q_id%2<>s_id%2) WHERE rn=1""")
def nearest_join(spark, sf):
    """Nearest vector of the other parity: both halves act as query and as support."""
    v = vectors(spark, sf).withColumn("side", F.col("id") % 2)
    q = v.select("side", F.col("id").alias("q_id"), "x", "y", "z")
    s = v.select((1 - F.col("side")).alias("side"), F.col("id").alias("s_id"), F.col("label").alias("s_label"), "x", "y", "z")
    return rounded(nb.nearest_join(q, s, ["side"], carry=["s_label"]).drop("side"), "d2")


TRANSFER = f"""WITH {LATTICE}, k AS (SELECT CAST(floor(x/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz, x,y,z,label FROM pts),
c AS (SELECT vx,vy,vz,label,count(*) AS n FROM k GROUP BY ALL), m AS (SELECT vx,vy,vz,arg_max(label,n*100-label) AS label FROM c GROUP BY ALL),
a AS (SELECT vx,vy,vz,avg(x) AS x,avg(y) AS y,avg(z) AS z FROM k GROUP BY ALL), mp AS (SELECT vx*10000+vy*100+vz AS s_id, x,y,z,label FROM a JOIN m USING (vx,vy,vz)),
q AS (SELECT DISTINCT x, y, z FROM pts), d AS (SELECT q.x,q.y,q.z, mp.label, mp.s_id,
 (q.x+0.31-mp.x)*(q.x+0.31-mp.x)+(q.y+0.17-mp.y)*(q.y+0.17-mp.y)+(q.z+0.11-mp.z)*(q.z+0.11-mp.z) AS d2 FROM q, mp),
b AS (SELECT x,y,z, arg_min(label, d2) AS label FROM d GROUP BY ALL)"""


@query("nearest_label_transfer", TRANSFER + """
SELECT p.session, b.label, count(*) AS n FROM pts p JOIN b USING (x,y,z) GROUP BY ALL""")
def nearest_label_transfer(spark, sf):
    """Labels of a voxel map given to every (slightly shifted) point of the table."""
    pts = lattice(spark, sf)
    m = voxels.voxel_barycentre(pts, 4.0, labels=["label"]).select(
        (F.col("vx") * 10000 + F.col("vy") * 100 + F.col("vz")).alias("s_id"), "x", "y", "z", F.col("label").alias("near"))
    moved = pts.select("session", "id", (F.col("x") + 0.31).alias("x"), (F.col("y") + 0.17).alias("y"), (F.col("z") + 0.11).alias("z"))
    out = nb.nearest_join(moved, m, [], "id", "s_id", carry=["near"], max_distance=16.0)
    return (out.select(F.col("id.l_suppkey").alias("k"), F.col("near").alias("label"))
            .groupBy((F.col("k") % 8).alias("session"), "label").agg(F.count(F.lit(1)).alias("n")))


# Unit prices and quantities: continuous points whose number grows with the tables, a third of them within a millionth of the extent.
SCENE = """WITH l AS (SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_extendedprice AS e, l_extendedprice / l_quantity AS x, l_quantity * 20 + l_discount * 100 AS y, l_tax * 1000 AS z FROM lineitem),
s AS (SELECT a, b, c, d, e, CASE WHEN d % 3 = 0 THEN 1500 + x / 1000000 ELSE x END AS x, CASE WHEN d % 3 = 0 THEN 500 + y / 1000000 ELSE y END AS y, CASE WHEN d % 3 = 0 THEN 40 + z / 1000000 ELSE z END AS z FROM l),
q AS (SELECT p_partkey AS q_id, p_retailprice AS x, p_size * 20.0 AS y, p_partkey % 80 + 0.5 AS z FROM part UNION ALL SELECT -1 - c_custkey, 1500 + c_acctbal / 1000, 500 + c_nationkey / 10.0, 40.0 + c_custkey % 7 / 10.0 FROM customer)"""


def priced(spark, sf):
    """Queries (parts and customers) and supports (line items)."""
    t = table(spark, sf, "lineitem")
    own = {"x": F.col("l_extendedprice") / F.col("l_quantity"), "y": F.col("l_quantity") * 20 + F.col("l_discount") * 100, "z": F.col("l_tax") * 1000}
    crowd = F.col("l_suppkey") % 3 == 0
    s = t.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("s_id"),
                 *(F.when(crowd, at + own[a] / 1000000).otherwise(own[a]).alias(a) for a, at in (("x", 1500), ("y", 500), ("z", 40))))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("q_id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 20.0).alias("y"), (F.col("p_partkey") % 80 + 0.5).alias("z"))
    customers = table(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("q_id"), (1500 + F.col("c_acctbal") / 1000).alias("x"), (500 + F.col("c_nationkey") / 10.0).alias("y"), (40.0 + F.col("c_custkey") % 7 / 10.0).alias("z"))
    return parts.unionByName(customers), s


@query("nearest_continuous", SCENE + """, d AS (SELECT q_id, min({'d2': (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z), 'a': a, 'b': b, 'c': c, 'd': d, 'e': e}) AS m FROM q, s GROUP BY q_id)
SELECT q_id, m.a AS l_orderkey, m.b AS l_linenumber, m.c AS l_partkey, m.d AS l_suppkey, round(m.d2, 6) AS d2 FROM d""")
def nearest_continuous(spark, sf):
    """The line item nearest to every part and customer."""
    hit = nb.nearest_join(*priced(spark, sf))
    return rounded(hit.select("q_id", "s_id.*", "d2").drop("l_extendedprice"), "d2")


@query("proximity_far", PAIRS + """
SELECT q_id AS id FROM pr WHERE q_id%2=0 AND s_id%2=1 GROUP BY q_id HAVING min(d2) > 0.06*0.06""")
def proximity_far(spark, sf):
    v = vectors(spark, sf)
    return nb.proximity(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 0.06, "far").select("id")


@query("proximity_near", PAIRS + """
SELECT q_id AS id FROM pr WHERE q_id%2=0 AND s_id%2=1 GROUP BY q_id HAVING min(d2) < 0.06*0.06""")
def proximity_near(spark, sf):
    v = vectors(spark, sf)
    return nb.proximity(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 0.06, "near").select("id")


@query("proximity_still", f"""WITH {VECTORS}, p AS (SELECT *, CASE WHEN label<5 THEN -1 ELSE 3 END AS c FROM vec),
w AS (SELECT a.id FROM p a WHERE a.c<-0.5 OR EXISTS (SELECT 1 FROM p b WHERE b.c<-0.5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.0016))
SELECT a.id FROM p a WHERE a.id IN (SELECT id FROM w) AND NOT EXISTS (SELECT 1 FROM p b WHERE b.id NOT IN (SELECT id FROM w)
 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0016)""")
def proximity_still(spark, sf):
    v = vectors(spark, sf).withColumn("count", F.when(F.col("label") < 5, -1).otherwise(3))
    return nb.still_points(v, 0.04).select("id")


@query("pool_max", PAIRS + f"""
SELECT q_id, count(*) AS n, round(max(f),6) AS f FROM pr WHERE d2 < {R}*{R} GROUP BY q_id""")
def pool_max(spark, sf):
    return rounded(nb.pool(*both(spark, sf), R, ["f"], "max"), "f")


@query("pool_mean_padded", PAIRS + f""", c AS (SELECT q_id, count(*) AS n, sum(f) AS s FROM pr WHERE d2 < {R}*{R} GROUP BY q_id)
SELECT q_id, n, round(s/(SELECT max(n) FROM c),6) AS f FROM c""")
def pool_mean_padded(spark, sf):
    return rounded(nb.pool(*both(spark, sf), R, ["f"], "mean", shadow_zero=True), "f")


@query("pool_closest", PAIRS + """, h AS (SELECT q_id, f, d2, row_number() OVER (PARTITION BY q_id ORDER BY d2, s_id) AS rn FROM pr WHERE s_id%2=1 AND d2 < 0.05*0.05)
SELECT v.id AS q_id, round(coalesce(h.f, 0),6) AS f FROM vec v LEFT JOIN h ON h.q_id=v.id AND h.rn=1""")
def pool_closest(spark, sf):
    q, s = both(spark, sf)
    return rounded(nb.closest_pool(q, s.where("s_id % 2 = 1"), 0.05, ["f"]), "f")


@query("pool_grid_indices", f"""WITH {VECTORS}, g AS (SELECT generate_series AS i FROM generate_series(0,19)),
n AS (SELECT a.i AS px, b.i AS py, v.id, (v.x-(a.i*0.04-0.4))*(v.x-(a.i*0.04-0.4))+(v.y-(b.i*0.04-0.4))*(v.y-(b.i*0.04-0.4)) AS d2 FROM g a, g b, vec v),
k AS (SELECT *, row_number() OVER (PARTITION BY px,py ORDER BY d2,id) AS rank FROM n WHERE d2 < 0.04*0.04/2)
SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, id, rank FROM k WHERE rank<=20""")
def pool_grid_indices(spark, sf):
    out = nb.grid_pool_indices(vectors(spark, sf), 0.4, 0.04)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("px", "py", "id", "rank")))


@query("neighbour_limit", PAIRS + f""", c AS (SELECT q_id, count(*) AS n FROM pr WHERE d2 < {R}*{R} GROUP BY q_id), h AS (SELECT n AS bin, count(*) AS c FROM c GROUP BY n),
u AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS cum, sum(c) OVER () AS total FROM h)
SELECT min(bin) FILTER (cum >= 0.9*total) AS bin_limit, CAST(max(total) AS BIGINT) AS total FROM u""")
def neighbour_limit(spark, sf):
    return nb.neighbour_limit(*both(spark, sf), R)


@query("group_size_limit", f"""WITH {LATTICE}, s AS (SELECT session, frame, count(*) AS n FROM pts GROUP BY ALL) SELECT round(quantile_cont(n, 0.9),6) AS size_limit FROM s""")
def group_size_limit(spark, sf):
    return rounded(nb.size_limit(lattice(spark, sf), ["session", "frame"], 0.9), "size_limit")


@query("pca_neighbourhood_frames", PAIRS + f""", m AS (SELECT q_id, count(*) AS n, avg(sx-qx) AS mx, avg(sy-qy) AS my, avg(sz-qz) AS mz,
 var_pop(sx-qx)+var_pop(sy-qy)+var_pop(sz-qz) AS tr FROM pr WHERE d2 < {R}*{R} GROUP BY q_id)
SELECT v.id AS q_id, CAST(n AS DOUBLE) AS n, round(n*tr,6) AS trace, round(x+mx,6) AS cx, round(y+my,6) AS cy, round(z+mz,6) AS cz, TRUE AS away, TRUE AS right_handed FROM m JOIN vec v ON v.id=m.q_id""")
def pca_neighbourhood_frames(spark, sf):
    """The frame's trace and centroid are compared; its signs and handedness must hold for every row."""
    q, s = both(spark, sf)
    out = nb.neighbourhood_frames(q, s, R).join(q.select("q_id", *(F.col(a).alias("q" + a) for a in "xyz")), "q_id")
    away = F.lit(True)
    for k in "uv":
        dot = sum((F.col(k + a) * (F.col("c" + a) - F.col("q" + a)) for a in "yz"), F.col(k + "x") * (F.col("cx") - F.col("qx")))
        away = away & (dot <= 1e-9)
    cross = (F.abs(F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx") - F.col("wz")) < 1e-9)
    return out.select("q_id", "n", r6(F.col("l0") + F.col("l1") + F.col("l2")).alias("trace"), r6("cx").alias("cx"),
                      r6("cy").alias("cy"), r6("cz").alias("cz"), away.alias("away"), cross.alias("right_handed"))
