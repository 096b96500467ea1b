"""Ordering, sampling, packing, augmentation and meshes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mesh
from ..operators import sampling as sa
from ..operators.selection import lowest, ranked
from ..plans import samples
from .registry import LATTICE, VECTORS, lattice, longs, query, r6, table, vectors


def items(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("potential"), F.col("o_orderpriority").alias("label"))


@query("sample_lowest_potential", "SELECT o_orderkey AS id, o_totalprice AS potential FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500")
def sample_lowest_potential(spark, sf):
    return sa.lowest_potential(items(spark, sf), 500).select("id", "potential")


# The draw is a hash, so only its integer part has an SQL twin.
@query("sample_raise_potential", """WITH c AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500)
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey IN (SELECT * FROM c) THEN ceil(o_totalprice) ELSE floor(o_totalprice) END AS BIGINT) AS base, o_orderkey IN (SELECT * FROM c) AS raised FROM orders""")
def sample_raise_potential(spark, sf):
    it = items(spark, sf)
    chosen = sa.lowest_potential(it, 500)
    up = sa.raise_potential(it, chosen, 5).join(it.select("id", F.col("potential").alias("old")), "id")
    step = F.col("potential") - F.ceil("old")
    return up.select("id", F.floor("potential").cast("long").alias("base"), ((F.col("potential") > F.col("old")) & step.between(0.1, 0.2)).alias("raised"))


@query("sample_class_balanced", """SELECT o_orderkey AS id, o_orderpriority AS label, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 201""")
def sample_class_balanced(spark, sf):
    return longs(sa.balanced_lowest(items(spark, sf), 1000, 5), "rank").select("id", "label", "rank")


@query("sample_balanced_epoch", """SELECT id, label, potential, rank FROM (SELECT id, label, potential, row_number() OVER (ORDER BY id*7919 % 10007, id) AS rank FROM
 (SELECT o_orderkey AS id, o_orderpriority AS label, o_totalprice AS potential, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r <= 201) WHERE rank <= 1000""")
def sample_balanced_epoch(spark, sf):
    """Drawn by a key that SQL can form; its place in the epoch is the rank."""
    drawn = sa.balanced_epoch(items(spark, sf), 1000, 5, 11, key=F.col("id") * 7919 % 10007)
    return ranked(drawn, [F.col("id") * 7919 % 10007, "id"]).select("id", "label", "potential", "rank")


@query("sample_largest_orders", "SELECT o_orderkey AS id, o_totalprice AS price FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= n // 3")
def sample_largest_orders(spark, sf):
    """The dearer third: a k that grows with the table."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return lowest(o, o.count() // 3, -F.col("price"), ["id"])


@query("sample_to_cap", f"WITH {LATTICE} SELECT session, frame, least(count(*), 2) AS n FROM pts GROUP BY ALL")
def sample_to_cap(spark, sf):
    """Which points are kept is a hash; how many is not."""
    return sa.sample_to_cap(lattice(spark, sf), ["session", "frame"], 2, 3).groupBy("session", "frame").agg(F.count(F.lit(1)).alias("n"))


@query("sample_weighted", f"WITH {LATTICE} SELECT session, least(count(*), 100) AS n FROM pts WHERE y > 0 GROUP BY session")
def sample_weighted(spark, sf):
    return sa.weighted_sample(lattice(spark, sf), ["session"], 100, "y", 3).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("sample_every_tenth", f"""WITH {LATTICE}, f AS (SELECT DISTINCT session, frame FROM pts), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY frame) AS rn FROM f)
SELECT session, frame FROM r WHERE (rn-1)%10=0""")
def sample_every_tenth(spark, sf):
    f = lattice(spark, sf).select("session", "frame").distinct()
    return sa.every_nth(f, ["session"], "frame", 10, F.floor(F.col("frame") / 365))


@query("sample_repeat", "SELECT o_orderpriority AS label, 3*count(*) AS n FROM orders GROUP BY ALL")
def sample_repeat(spark, sf):
    return sa.repeat_rows(items(spark, sf), 3).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _places(ordered, by):
    """The place of each row among its key's rows in the order in which ``ordered`` holds them."""
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_at")).cast("long"))


@query("sample_shuffle", "SELECT o_orderpriority AS label, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3-' || o_orderkey), o_orderkey) AS place FROM orders")
def sample_shuffle(spark, sf):
    drawn = sa.shuffled(items(spark, sf), 3, key=F.md5(F.concat(F.lit("3-"), F.col("id").cast("string")).cast("binary")))
    return _places(drawn, "label").select("label", "id", "place")


@query("sample_best_worst", """WITH r AS (SELECT o_orderpriority AS label, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS b,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS w FROM orders)
SELECT label, id, 'best' AS side, b AS rank FROM r WHERE b<=7 UNION ALL SELECT label, id, 'worst', w FROM r WHERE w<=7""")
def sample_best_worst(spark, sf):
    return longs(sa.best_and_worst(items(spark, sf), ["label"], "potential", 7), "rank").select("label", "id", "side", "rank")


@query("sample_top_activations", """WITH b AS (SELECT o_orderpriority AS feature, o_custkey%20 AS label, arg_max(o_orderkey, struct_pack(v:=o_totalprice,k:=-o_orderkey)) AS id, max(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT feature, label, id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, id) AS rank FROM b) WHERE rank<=5""")
def sample_top_activations(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("feature"), (F.col("o_custkey") % 20).alias("label"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return longs(sa.top_activations(o, "feature", "label", "value", 5), "rank").select("feature", "label", "id", "value", "rank")


@query("sample_time_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def sample_time_order(spark, sf):
    return _places(sa.time_order(table(spark, sf, "events"), ["user_id"], "ts", ["event_id"]), "user_id").select("user_id", "event_id", "place")


@query("sample_batches", """WITH RECURSIVE o AS (SELECT o_orderpriority AS shard, o_orderkey AS k, floor(o_totalprice/1000) AS size, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
r AS (SELECT shard, rn, k, 0 AS batch, size AS total FROM o WHERE rn=1 UNION ALL
 SELECT o.shard, o.rn, o.k, CASE WHEN r.total > 2000 THEN r.batch+1 ELSE r.batch END, CASE WHEN r.total > 2000 THEN o.size ELSE r.total+o.size END FROM r JOIN o ON o.shard=r.shard AND o.rn=r.rn+1)
SELECT shard, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(k) AS first_key FROM r GROUP BY ALL""")
def sample_batches(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("shard"), F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 1000).alias("size"))
    return sa.pack_batches(o, ["shard"], "k", "size", 2000).groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"))


# Rotation about z and mirroring keep lengths up to the scale, whatever the hash draws.
@query("augment_points", f"""WITH {VECTORS} SELECT label, count(*) AS n, round(sum(z*z),6) AS sz FROM vec GROUP BY label""")
def augment_points(spark, sf):
    v = vectors(spark, sf)
    par = sa.augmentation_parameters(v, ["label"], 9, "vertical", (1.0, 1.0), False)
    return sa.augment(v, par, ["label"], 9, 0.0).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("z") * F.col("z"))).alias("sz"))


@query("augment_rotated_groups", f"""WITH {VECTORS} SELECT label, round(sum(x*x+y*y+z*z),6) AS energy FROM vec GROUP BY label""")
def augment_rotated_groups(spark, sf):
    out = sa.rotate_groups(vectors(spark, sf), ["label"], 4, "all")
    return out.groupBy("label").agg(r6(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("energy"))


# Layer 0 of the pyramid: neighbours within 0.1; layer 1: voxels of 2 * 0.1 / 2.5.
@query("pyramid_layers", f"""WITH {VECTORS}, n0 AS (SELECT count(*) AS n FROM vec a, vec b WHERE a.label=b.label AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.01),
c AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vec GROUP BY label, floor(x/0.08), floor(y/0.08), floor(z/0.08)),
p0 AS (SELECT count(*) AS n FROM c a, vec b WHERE a.label=b.label AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.01),
n1 AS (SELECT count(*) AS n FROM c a, c b WHERE a.label=b.label AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.04)
SELECT 'neighbours_0' AS part, n FROM n0 UNION ALL SELECT 'pools_0', n FROM p0 UNION ALL SELECT 'points_1', count(*) FROM c UNION ALL SELECT 'neighbours_1', n FROM n1 UNION ALL SELECT 'upsamples_0', count(*) FROM vec""")
def pyramid_layers(spark, sf):
    layers = samples.pyramid(vectors(spark, sf), ["label"], 0.04, 2.5, 2)
    parts = {"neighbours_0": layers[0]["neighbours"], "pools_0": layers[0]["pools"], "points_1": layers[1]["points"],
             "neighbours_1": layers[1]["neighbours"], "upsamples_0": layers[0]["upsamples"]}
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


SAMPLE_BALL = f"""WITH {LATTICE}, f AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame) AS rn FROM (SELECT DISTINCT session, frame FROM pts)),
c AS (SELECT session, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY ALL),
m AS (SELECT a.session, a.frame AS newest, b.frame, a.rn-b.rn AS age FROM f a JOIN f b ON a.session=b.session AND b.rn BETWEEN a.rn-2 AND a.rn),
r AS (SELECT m.session, m.newest, age, label, x-cx AS x, y-cy AS y, z-cz AS z FROM m JOIN pts p ON p.session=m.session AND p.frame=m.frame JOIN c ON c.session=m.session AND c.frame=m.newest),
b AS (SELECT *, floor(x/2) AS vx, floor(y/2) AS vy, floor(z/2) AS vz FROM r WHERE x*x+y*y+z*z < 400)"""


# Without a cap no draw decides: every voxel is there with its most frequent frame and label.
@query("assemble_samples", SAMPLE_BALL + """, a AS (SELECT session, newest, vx, vy, vz, age, count(*) AS n FROM b GROUP BY ALL), l AS (SELECT session, newest, vx, vy, vz, label, count(*) AS n FROM b GROUP BY ALL),
v AS (SELECT session, newest, vx, vy, vz, arg_max(age, n * 100 - age) AS age FROM a GROUP BY ALL), w AS (SELECT session, newest, vx, vy, vz, arg_max(label, n * 100 - label) AS label FROM l GROUP BY ALL)
SELECT session, count(*) AS n, CAST(sum((age = 0)::INT) AS BIGINT) AS newest, CAST(sum((age <= 1)::INT) AS BIGINT) AS recent, CAST(sum(label) AS BIGINT) AS labels FROM v JOIN w USING (session, newest, vx, vy, vz) GROUP BY session""")
def assemble_samples(spark, sf):
    out = _samples(spark, sf, 1_000_000)["samples"]
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("age") == 0).cast("long")).alias("newest"),
                                      F.sum((F.col("age") <= 1).cast("long")).alias("recent"), F.sum("label").alias("labels"))


def _samples(spark, sf, cap=50):
    p = lattice(spark, sf).select("session", F.col("frame").alias("frame_ts"), F.xxhash64("id").alias("id"), "x", "y", "z", "label")
    centres = p.groupBy("session", F.col("frame_ts").alias("newest_ts")).agg(*(F.avg(a).alias("c" + a) for a in "xyz"))
    return samples.assemble_samples(p, centres, 3, 20.0, 2.0, cap, 7)


# How many points a sample has, and how many raw points are projected back onto it, do not depend on the draw.
@query("assemble_samples_sizes", f"""WITH {LATTICE}, f AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame) AS rn FROM (SELECT DISTINCT session, frame FROM pts)),
c AS (SELECT session, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY ALL),
m AS (SELECT a.session, a.frame AS newest, b.frame, a.rn-b.rn AS age FROM f a JOIN f b ON a.session=b.session AND b.rn BETWEEN a.rn-2 AND a.rn),
r AS (SELECT m.session, m.newest, age, x-cx AS x, y-cy AS y, z-cz AS z FROM m JOIN pts p ON p.session=m.session AND p.frame=m.frame JOIN c ON c.session=m.session AND c.frame=m.newest),
b AS (SELECT * FROM r WHERE x*x+y*y+z*z < 400), v AS (SELECT session, newest, count(*) AS n FROM (SELECT DISTINCT session, newest, floor(x/2), floor(y/2), floor(z/2) FROM b) GROUP BY ALL),
s AS (SELECT session, CAST(sum(least(n,50)) AS BIGINT) AS n FROM v GROUP BY session), w AS (SELECT session, count(*) AS raw FROM b WHERE age=0 AND x*x+y*y+z*z < 19.8*19.8 GROUP BY session)
SELECT s.session, s.n, w.raw FROM s JOIN w USING (session)""")
def assemble_samples_sizes(spark, sf):
    out = _samples(spark, sf)
    sizes = out["samples"].groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    raw = out["reprojection"].where("id IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("raw"))
    return sizes.join(raw, "session")


# One triangle per supplier; a mesh point lies on its edges, its lattice or its corners.
@query("mesh_rasterize", """WITH t AS (SELECT s_suppkey AS m, 1.0+s_suppkey%3 AS w FROM supplier)
SELECT m, sum(corner) AS corners, max(mx) AS x_max, min(mn) AS x_min FROM (SELECT m, 3 AS corner, w AS mx, 0.0 AS mn FROM t) GROUP BY m""".replace("sum(corner)", "CAST(sum(corner) AS BIGINT)").replace("max(mx)", "CAST(max(mx) AS DOUBLE)").replace("min(mn)", "CAST(min(mn) AS DOUBLE)"))
def mesh_rasterize(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("m"), (1.0 + F.col("s_suppkey") % 3).alias("w"))
    zero = F.lit(0.0)
    v = s.select("m", F.explode(F.array(
        F.struct(F.lit(0).alias("v_id"), zero.alias("x"), zero.alias("y"), zero.alias("z")),
        F.struct(F.lit(1).alias("v_id"), F.col("w").alias("x"), zero.alias("y"), zero.alias("z")),
        F.struct(F.lit(2).alias("v_id"), zero.alias("x"), F.lit(1.0).alias("y"), zero.alias("z")))).alias("v")).select("m", "v.*")
    f = s.select("m", F.lit(0).alias("f_id"), F.lit(0).alias("v1"), F.lit(1).alias("v2"), F.lit(2).alias("v3"))
    pts = mesh.rasterize_mesh(v, f, 0.3, by=["m"])
    at = pts.join(v.withColumnsRenamed({a: "c" + a for a in "xyz"}), ["m", "v_id"])
    corner = (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy"))
    return at.groupBy("m").agg(F.count_if(corner).alias("corners"), F.max("x").alias("x_max"), F.min("x").alias("x_min"))


@query("mesh_cylinders", """SELECT s_suppkey AS m, 50 AS vertices, 96 AS faces, round(1+s_suppkey%5,6) AS radius FROM supplier""".replace("50 AS", "CAST(50 AS BIGINT) AS").replace("96 AS", "CAST(96 AS BIGINT) AS").replace("round(1+s_suppkey%5,6)", "CAST(1+s_suppkey%5 AS DOUBLE)"))
def mesh_cylinders(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("m"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"),
                                            F.lit(2.0).alias("height"), (1.0 + F.col("s_suppkey") % 5).alias("radius"))
    v = mesh.cylinder_vertices(c, ["m"]).groupBy("m").agg(F.count(F.lit(1)).alias("vertices"), F.max("x").alias("radius"))
    f = mesh.cylinder_faces(c, ["m"]).groupBy("m").agg(F.count(F.lit(1)).alias("faces"))
    return v.join(f, "m")
