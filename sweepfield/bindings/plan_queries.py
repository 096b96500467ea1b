"""Whole plans on the timeline of events and the lattice."""

from pyspark.sql import functions as F

from ..functions.rigid import matrices_of
from ..plans import maps
from .registry import LATTICE, frames_and_poses, lattice, longs, query, rounded
from .temporal_queries import BRACKET, CH

# Frames with the pose between the two around them; half a turn at most, so the shortest arc runs along the yaw.
AT_FRAMES = BRACKET + """, w AS (SELECT *, (frame_ts-t0)/(t1-t0) AS a FROM n WHERE t0 IS NOT NULL AND t1 IS NOT NULL),
y AS (SELECT session, event_id, frame_ts, (1-a)*px0+a*px1 AS px, (1-a)*py0+a*py1 AS py, yaw0+a*(CASE WHEN yaw1-yaw0>pi() THEN yaw1-yaw0-2*pi() WHEN yaw1-yaw0<-pi() THEN yaw1-yaw0+2*pi() ELSE yaw1-yaw0 END) AS yaw FROM w)"""


@query("session_jitter", AT_FRAMES + """, l AS (SELECT *, lag(frame_ts) OVER w AS t0, lag(px) OVER w AS x0, lag(py) OVER w AS y0, lag(yaw) OVER w AS a0 FROM y WINDOW w AS (PARTITION BY session ORDER BY frame_ts))
SELECT session, round(frame_ts, 6) AS frame_ts, round(frame_ts-t0, 6) AS dt, round(sqrt((px-x0)*(px-x0)+(py-y0)*(py-y0)), 4) AS d_trans, round(acos(greatest(least(cos(yaw-a0),1.0),-1.0)), 2) AS d_rot FROM l WHERE t0 IS NOT NULL""")
def session_jitter(spark, sf):
    out = maps.session_jitter(*frames_and_poses(spark, sf))
    return rounded(out, "frame_ts", "dt").select("session", "frame_ts", "dt", F.round("d_trans", 4).alias("d_trans"), F.round("d_rot", 2).alias("d_rot"))


# The estimate is the frames' own poses turned by 0.3 and shifted; its fourth frame must fall on the truth at that time.
@query("align_trajectory", AT_FRAMES + """, e AS (SELECT f.session, f.event_id, f.frame_ts, cos(0.3)*v.px - sin(0.3)*v.py + 5 AS px, sin(0.3)*v.px + cos(0.3)*v.py - 3 AS py, v.yaw + 0.3 AS yaw, row_number() OVER (PARTITION BY f.session ORDER BY f.frame_ts) AS rn FROM n f JOIN ev v ON v.event_id = f.event_id),
h AS (SELECT e.session, e.px AS ex, e.py AS ey, y.px AS tx, y.py AS ty, y.yaw - e.yaw AS turn FROM e JOIN y ON y.event_id = e.event_id WHERE rn = 4)
SELECT e.session, event_id, round(cos(turn)*(px-ex) - sin(turn)*(py-ey) + tx, 2) AS px, round(sin(turn)*(px-ex) + cos(turn)*(py-ey) + ty, 2) AS py, round(cos(yaw+turn), 3) AS r00 FROM e JOIN h USING (session)""")
def align_trajectory(spark, sf):
    from .registry import timeline

    ev, (f, poses) = timeline(spark, sf), frames_and_poses(spark, sf)
    own = matrices_of(ev).join(f.select("event_id", "frame_ts"), "event_id")
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    turned = {f"r0{k}": c * F.col(f"r0{k}") - s * F.col(f"r1{k}") for k in range(3)} | {f"r1{k}": s * F.col(f"r0{k}") + c * F.col(f"r1{k}") for k in range(3)}
    moved = {"t0": c * F.col("t0") - s * F.col("t1") + 5, "t1": s * F.col("t0") + c * F.col("t1") - 3}
    estimate = own.withColumns(turned | moved).drop("t").withColumnRenamed("frame_ts", "t")
    out = maps.align_trajectory(estimate, poses, ["session"], "t")
    return out.select("session", "event_id", F.round("t0", 2).alias("px"), F.round("t1", 2).alias("py"), F.round("r00", 3).alias("r00"))


# One point in front of the sensor at every frame near the place.
@query("merge_day_clouds", BRACKET + """, c AS (SELECT session, min(t) AS lo, max(t) AS hi FROM poses GROUP BY session),
k AS (SELECT n.session, event_id, frame_ts, t1 IS NULL OR (t0 IS NOT NULL AND frame_ts-t0 <= t1-frame_ts) AS first, px0, px1, py0, py1, yaw0, yaw1 FROM n JOIN c USING (session) WHERE frame_ts > lo AND frame_ts < hi),
p AS (SELECT session, event_id, frame_ts, CASE WHEN first THEN px0 ELSE px1 END AS px, CASE WHEN first THEN py0 ELSE py1 END AS py, CASE WHEN first THEN yaw0 ELSE yaw1 END AS yaw FROM k), q AS (SELECT * FROM p WHERE sqrt((px-30)*(px-30)+(py-10)*(py-10)) <= 25)
SELECT session, event_id, round(cos(yaw)*(10 + event_id % 7) - sin(yaw)*5 + px, 4) AS x, round(sin(yaw)*(10 + event_id % 7) + cos(yaw)*5 + py, 4) AS y, round(sqrt(frame_ts - min(frame_ts) OVER (PARTITION BY session)), 4) AS sqrt_dt FROM q""")
def merge_day_clouds(spark, sf):
    f, p = frames_and_poses(spark, sf)
    points = f.select("session", "frame_ts", "event_id", (F.lit(10.0) + F.col("event_id") % 7).alias("x"), F.lit(5.0).alias("y"), F.lit(1.0).alias("z"))
    from ..functions.rigid import POSITION, QUATERNION, Vec, rigid_from_quaternion

    poses = p.withColumns(rigid_from_quaternion(QUATERNION, Vec.of(*POSITION)).columns("_m_")).withColumnRenamed("t", "_t")
    named = poses.select("session", F.col("_t").alias("t"), *POSITION, *(F.col(c).alias(c[3:]) for c in poses.columns if c.startswith("_m_")))
    out = maps.merge_day_clouds(points, named, (30, 10, 0), 25.0)
    return out.select("session", "event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("sqrt_dt", 4).alias("sqrt_dt"))


# A plane that leans along x: 0.6 x + 0.8 z = 12 + session. The level of a session is the median height of its lowest points.
@query("flatten_ground", f"""WITH {LATTICE}, m AS (SELECT *, abs(0.6*x + 0.8*z - 12 - session) < 1 AS flat FROM pts), l AS (SELECT session, min(z) AS z0 FROM m WHERE flat GROUP BY session),
g AS (SELECT m.session, median(z) AS level FROM m JOIN l USING (session) WHERE flat AND z < z0 + 1.5 GROUP BY m.session)
SELECT m.session, flat, CASE WHEN flat THEN level ELSE z END AS z, CASE WHEN flat THEN 1.0 ELSE 0.5 END::DOUBLE AS nz, CASE WHEN flat THEN 0.99 ELSE 0.25 END::DOUBLE AS score, count(*) AS n, sum(x) AS sx FROM m LEFT JOIN g USING (session) GROUP BY ALL""")
def flatten_ground(spark, sf):
    p = lattice(spark, sf).withColumns({"nx": F.lit(0.5), "ny": F.lit(0.5), "nz": F.lit(0.5), "score": F.lit(0.25)})
    planes = p.select("session").distinct().withColumns({"a": F.lit(0.6), "b": F.lit(0.0), "c": F.lit(0.8), "d": 12.0 + F.col("session")})
    out = maps.flatten_ground(p, ["session"], planes, 1.0, 1.5)
    return out.groupBy("session", (F.col("score") == 0.99).alias("flat"), "z", "nz", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))
