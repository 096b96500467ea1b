"""Time joins and windows on the event timeline."""

from pyspark.sql import functions as F

from ..functions.rigid import matrices_of
from ..operators import temporal as tp
from ..sources.catalogue import not_done, session_filter
from .registry import LATTICE, TIMELINE, frames_and_poses, lattice, longs, query, r6, rounded, table, timeline

H = 3600.0
CH = 86400.0

BRACKET = f"""WITH {TIMELINE}, b AS (SELECT f.session, f.t AS frame_ts, f.event_id, p.t AS t0, p.px AS px0, p.py AS py0, p.yaw AS yaw0
  FROM frames f ASOF LEFT JOIN poses p ON f.session=p.session AND f.t >= p.t),
n AS (SELECT b.*, p.t AS t1, p.px AS px1, p.py AS py1, p.yaw AS yaw1 FROM b ASOF LEFT JOIN poses p ON b.session=p.session AND b.frame_ts < p.t)"""


@query("asof_bracket", BRACKET + """
SELECT session, event_id, round(t0,6) AS t0, round(t1,6) AS t1, px0, px1 FROM n WHERE t0 IS NOT NULL AND t1 IS NOT NULL""")
def asof_bracket(spark, sf):
    f, p = frames_and_poses(spark, sf)
    out = tp.asof_bracket(f, p, ["session"], "frame_ts", "t", ["px"], CH)
    return rounded(out, "t0", "t1").select("session", "event_id", "t0", "t1", "px0", "px1")


# Half the yaw is at most pi/2, so the shortest arc runs along the yaw itself.
@query("asof_pose_interpolation", BRACKET + """
, w AS (SELECT *, (frame_ts-t0)/(t1-t0) AS a FROM n WHERE t0 IS NOT NULL AND t1 IS NOT NULL),
y AS (SELECT *, yaw0+a*(CASE WHEN yaw1-yaw0>pi() THEN yaw1-yaw0-2*pi() WHEN yaw1-yaw0<-pi() THEN yaw1-yaw0+2*pi() ELSE yaw1-yaw0 END) AS yaw FROM w)
SELECT session, event_id, round((1-a)*px0+a*px1,5) AS px, round((1-a)*py0+a*py1,5) AS py, round(cos(yaw),3) AS r00, round(sin(yaw),3) AS r10 FROM y""")
def asof_pose_interpolation(spark, sf):
    f, p = frames_and_poses(spark, sf)
    out = tp.interpolated_poses(f, p, ["session"], chunk=CH)
    return out.select("session", "event_id", F.round("t0", 5).alias("px"), F.round("t1", 5).alias("py"),
                      F.round("r00", 3).alias("r00"), F.round("r10", 3).alias("r10"))


@query("asof_nearest_time", BRACKET + """
SELECT session, event_id, round(CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND frame_ts-t0 <= t1-frame_ts) THEN t0 ELSE t1 END,6) AS near_t,
 CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND frame_ts-t0 <= t1-frame_ts) THEN px0 ELSE px1 END AS px FROM n WHERE t0 IS NOT NULL OR t1 IS NOT NULL""")
def asof_nearest_time(spark, sf):
    f, p = frames_and_poses(spark, sf)
    out = tp.nearest_time_join(f, p, ["session"], "frame_ts", "t", ["px"], CH)
    return rounded(out, "near_t").select("session", "event_id", "near_t", "px")


@query("asof_exact_time", f"""WITH {TIMELINE} SELECT a.event_id, b.event_id AS pose_id FROM ev a JOIN ev b ON a.session=b.session AND round(a.t*1e6)=round(b.t*1e6)""")
def asof_exact_time(spark, sf):
    ev = timeline(spark, sf)
    f = ev.select("session", F.col("t").alias("frame_ts"), "event_id")
    return tp.exact_time_join(f, ev.select("session", "t", F.col("event_id").alias("pose_id")), ["session"]).select("event_id", "pose_id")


@query("asof_pose_priority", f"""WITH {TIMELINE}, k AS (SELECT session, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 END) AS r FROM ev GROUP BY session)
SELECT ev.session, ev.event_id FROM ev JOIN k USING (session) WHERE CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 END = r""")
def asof_pose_priority(spark, sf):
    return tp.pick_by_priority(timeline(spark, sf), ["purchase", "error"], ["session"], "event_type").select("session", "event_id")


@query("interval_join", f"""WITH {TIMELINE} SELECT a.session, a.event_id, count(*) AS n, round(sum(b.t-a.t),3) AS total FROM ev a JOIN ev b
 ON a.session=b.session AND b.t BETWEEN a.t+{H} AND a.t+10*{H} GROUP BY ALL""")
def interval_join(spark, sf):
    ev = timeline(spark, sf).select("session", "event_id", "t")
    out = tp.interval_join(ev, ev, ["session"], "t", "t", H, 10 * H)
    return out.groupBy("session", "event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("other_t") - F.col("t")), 3).alias("total"))


def _horizon_sql(start: float, future: float) -> str:
    span = future - start
    return f"""WITH {TIMELINE}, e AS (SELECT a.session, a.t AS oldest, b.t AS fin FROM ev a ASOF JOIN (SELECT session, t FROM ev) b ON a.session=b.session AND a.t+{span} < b.t),
m AS (SELECT e.session, e.oldest, e.fin, v.t, abs(v.t-(e.oldest-({start}))) AS gap FROM e JOIN ev v ON v.session=e.session AND v.t BETWEEN e.oldest AND e.fin),
o AS (SELECT session, oldest, arg_min(t, gap) AS origin FROM m GROUP BY ALL)
SELECT m.session, round(m.oldest,6) AS oldest_ts, round(o.origin,6) AS origin_ts, count(*) AS n, round(sum(m.t-o.origin),3) AS total
FROM m JOIN o USING (session, oldest) GROUP BY ALL"""


def _horizon(spark, sf, start, future):
    out = tp.horizon_windows(timeline(spark, sf), ["session"], "t", start, future, CH)
    return (rounded(out, "oldest_ts", "origin_ts").groupBy("session", "oldest_ts", "origin_ts")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 3).alias("total")))


@query("horizon_windows", _horizon_sql(-6 * H, 30 * H))
def horizon_windows(spark, sf):
    return _horizon(spark, sf, -6 * H, 30 * H)


@query("horizon_no_lookback", _horizon_sql(0.0, 24 * H))
def horizon_no_lookback(spark, sf):
    return _horizon(spark, sf, 0.0, 24 * H)


@query("horizon_stacked_cloud", f"""WITH {TIMELINE}, e AS (SELECT a.session, a.t AS oldest, b.t AS fin FROM ev a ASOF JOIN (SELECT session, t FROM ev) b ON a.session=b.session AND a.t+12*3600.0 < b.t)
SELECT e.session, count(*) AS n, round(sum(v.value),2) AS total FROM e JOIN ev v ON v.session=e.session AND v.t BETWEEN e.oldest AND e.fin GROUP BY ALL""")
def horizon_stacked_cloud(spark, sf):
    ev = timeline(spark, sf)
    out = tp.stack_horizon(ev, ["session"], "t", 0.0, 12 * H, ["value"], CH)
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("merge_last_frames", f"""WITH {LATTICE}, f AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame) AS rn FROM (SELECT DISTINCT session, frame FROM pts)),
p AS (SELECT a.session, a.frame AS newest_ts, b.frame, a.rn-b.rn AS age FROM f a JOIN f b ON a.session=b.session AND b.rn BETWEEN a.rn-2 AND a.rn)
SELECT session, newest_ts, age, count(*) AS n, sum(x) AS sx FROM p JOIN pts USING (session, frame) GROUP BY ALL""")
def merge_last_frames(spark, sf):
    out = tp.merge_last_frames(lattice(spark, sf), ["session"], "frame", 3, 365.0)
    return longs(out, "age").groupBy("session", "newest_ts", "age").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))


@query("near_duplicate_frames", f"""WITH RECURSIVE {TIMELINE}, d AS (SELECT DISTINCT session, t FROM ev),
c AS (SELECT session, min(t) AS t FROM d GROUP BY session UNION ALL
 SELECT c.session, (SELECT min(d.t) FROM d WHERE d.session=c.session AND d.t - c.t >= 7200.0) FROM c WHERE c.t IS NOT NULL)
SELECT session, count(t) AS n, round(sum(t - 1704067200),3) AS total FROM c GROUP BY session""")
def near_duplicate_frames(spark, sf):
    kept = tp.drop_near_duplicates(timeline(spark, sf).select("session", "t"), ["session"], "t", 7200.0, CH)
    return kept.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("t") - 1704067200), 3).alias("total"))


@query("pose_steps", f"""WITH {TIMELINE}, l AS (SELECT *, lag(t) OVER w AS t0, lag(px) OVER w AS x0, lag(py) OVER w AS y0, lag(yaw) OVER w AS a0 FROM ev WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, event_id, round(t-t0,6) AS dt, round(sqrt((px-x0)*(px-x0)+(py-y0)*(py-y0)),6) AS d_trans, round(acos(greatest(least(cos(yaw-a0),1.0),-1.0)),4) AS d_rot FROM l WHERE t0 IS NOT NULL""")
def pose_steps(spark, sf):
    m = matrices_of(timeline(spark, sf))
    steps = tp.pose_steps(m, ["session"], "t", CH)
    out = steps.join(m.select("session", "t", "event_id"), ["session", "t"])
    return rounded(out, "dt", "d_trans").select("session", "event_id", "dt", "d_trans", F.round("d_rot", 4).alias("d_rot"))


@query("sweep_frames", f"""WITH {TIMELINE}, p AS (SELECT *, (atan2(-py+100, px-200)-pi()/2) - 2*pi()*floor((atan2(-py+100,px-200)-pi()/2)/(2*pi())) AS phi FROM ev),
l AS (SELECT *, CASE WHEN phi < lag(phi) OVER (PARTITION BY session ORDER BY event_id) THEN 1 ELSE 0 END AS fl FROM p)
SELECT session, event_id, round(phi,6) AS phi, CAST(sum(fl) OVER (PARTITION BY session ORDER BY event_id) AS BIGINT) AS sweep FROM l""")
def sweep_frames(spark, sf):
    hits = timeline(spark, sf).select("session", "event_id", (F.col("px") - 200).alias("x"), (F.col("py") - 100).alias("y"))
    return rounded(tp.sweep_frames(hits, ["session"], "event_id", 4096), "phi").select("session", "event_id", "phi", "sweep")


@query("segment_gaps", f"""WITH {TIMELINE}, l AS (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY session ORDER BY t) > 6*3600 THEN 1 ELSE 0 END AS fl FROM ev)
SELECT session, event_id, CAST(sum(fl) OVER (PARTITION BY session ORDER BY t) AS BIGINT) AS segment FROM l""")
def segment_gaps(spark, sf):
    return tp.gap_segments(timeline(spark, sf), ["session"], "t", 6 * H, CH).select("session", "event_id", "segment")


@query("segment_around_closest", f"""WITH {TIMELINE}, l AS (SELECT *, t-lag(t) OVER w AS gap, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY session ORDER BY t)),
m AS (SELECT session, quantile_cont(gap, 0.5) AS med FROM l WHERE rn BETWEEN 2 AND 51 GROUP BY session),
s AS (SELECT l.*, sum(CASE WHEN gap > 2*med THEN 1 ELSE 0 END) OVER (PARTITION BY l.session ORDER BY t) AS seg FROM l JOIN m USING (session)),
c AS (SELECT session, arg_min(seg, abs(value-20)) AS seg FROM s GROUP BY session)
SELECT session, event_id FROM s JOIN c USING (session, seg)""")
def segment_around_closest(spark, sf):
    ev = timeline(spark, sf).withColumn("distance", F.abs(F.col("value") - 20))
    return tp.segment_around_closest(ev, ["session"], "t", "distance", 2.0, 50, CH).select("session", "event_id")


@query("frames_near_place", BRACKET + """, c AS (SELECT session, min(t) AS lo, max(t) AS hi FROM poses GROUP BY session),
k AS (SELECT n.*, CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND frame_ts-t0 <= t1-frame_ts) THEN px0 ELSE px1 END AS px, CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND frame_ts-t0 <= t1-frame_ts) THEN py0 ELSE py1 END AS py FROM n)
SELECT k.session, event_id, round(sqrt((px-30)*(px-30)+(py-10)*(py-10)),6) AS distance FROM k JOIN c USING (session)
WHERE frame_ts > lo AND frame_ts < hi AND sqrt((px-30)*(px-30)+(py-10)*(py-10)) <= 25""")
def frames_near_place(spark, sf):
    f, p = frames_and_poses(spark, sf)
    out = tp.frames_near_place(f, p, ["session"], (30, 10, 0), 25.0, chunk=CH)
    return rounded(out, "distance").select("session", "event_id", "distance")


@query("running_mean", f"""WITH {TIMELINE}, w AS (SELECT session, event_id, avg(value) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m,
 row_number() OVER (PARTITION BY session ORDER BY t) AS rn, count(*) OVER (PARTITION BY session) AS n FROM ev)
SELECT session, round(m,5) AS mean, event_id FROM w WHERE rn > 3 AND rn <= n-3 AND (rn-4) % 2 = 0""")
def running_mean(spark, sf):
    ev = timeline(spark, sf)
    out = tp.running_mean(ev, ["session"], "event_id", "value", 3, 2, 4096)
    return out.select("session", F.round("mean", 5).alias("mean"), "event_id")


@query("pose_drift", BRACKET.replace("FROM frames f", "FROM frames f") + """
, w AS (SELECT n.session, n.event_id, n.frame_ts, (frame_ts-t0)/(t1-t0) AS a, px0, px1, py0, py1, e.px, e.py FROM n JOIN ev e ON e.event_id=n.event_id WHERE t0 IS NOT NULL AND t1 IS NOT NULL),
g AS (SELECT *, sqrt(pow(px-((1-a)*px0+a*px1),2)+pow(py-((1-a)*py0+a*py1),2)) AS d FROM w)
SELECT session, event_id, round(d,5) AS d_trans, CAST(max(CASE WHEN d > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY frame_ts) AS BIGINT) AS failed FROM g""")
def pose_drift(spark, sf):
    f, p = frames_and_poses(spark, sf)
    ev = matrices_of(timeline(spark, sf)).join(f.select("event_id"), "event_id", "left_semi")
    out = tp.pose_drift(ev, p, ["session"], "t", 60.0, 1e6, CH).join(ev.select("session", "t", "event_id"), ["session", "t"])
    return longs(out.select("session", "event_id", F.round("d_trans", 5).alias("d_trans"), "failed"), "failed")


@query("scan_line_outliers", """
WITH p AS (SELECT l_suppkey AS line, l_orderkey*8+l_linenumber AS o, l_partkey, l_extendedprice, l_quantity AS r FROM lineitem),
q AS (SELECT *, row_number() OVER (ORDER BY o, l_partkey, line, l_extendedprice) AS i FROM p),
a AS (SELECT *, coalesce(abs(r-lag(r) OVER w) > 35, false) OR coalesce(abs(lead(r) OVER w - r) > 35, false) AS bad FROM q WINDOW w AS (PARTITION BY line ORDER BY i)),
b AS (SELECT i, coalesce(abs(r-lag(r) OVER w) > 35, false) OR coalesce(abs(lead(r) OVER w - r) > 35, false) AS bad FROM a WHERE NOT bad WINDOW w AS (PARTITION BY line ORDER BY i))
SELECT a.line, count(*) AS n, count(*) FILTER (a.bad OR coalesce(b.bad,false)) AS outliers FROM a LEFT JOIN b ON a.i=b.i GROUP BY a.line""")
def scan_line_outliers(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("line"), F.col("l_quantity").alias("r"),
                                            F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), "l_partkey", "l_suppkey", "l_extendedprice").alias("key"))
    # The order within a line is the composite key; its leading number gives the blocks.
    p = p.withColumn("o", F.col("key.o"))
    out = _outliers(p)
    return out.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_if("outlier").alias("outliers"))


def _outliers(p):
    from ..operators.scans import numbered, parts_for

    parts = parts_for(p)
    ranked = numbered(p.withColumn("_all", F.lit(0)), ["line"], ["key"], F.floor(F.col("o") / 65536).cast("long"), "i", parts)
    return tp.scan_line_outliers(ranked, [], "line", "i", "r", 35.0, 2, partitions=parts)


@query("scan_columns", f"""WITH RECURSIVE {TIMELINE}, q AS (SELECT session, event_id, event_type, row_number() OVER (PARTITION BY session ORDER BY event_id) AS i FROM ev),
r AS (SELECT session, event_id, i, 1 AS c, [event_type] AS seen FROM q WHERE i=1 UNION ALL
 SELECT q.session, q.event_id, q.i, CASE WHEN list_contains(r.seen, q.event_type) THEN r.c+1 ELSE r.c END,
  CASE WHEN list_contains(r.seen, q.event_type) THEN [q.event_type] ELSE list_append(r.seen, q.event_type) END FROM r JOIN q ON q.session=r.session AND q.i=r.i+1)
SELECT session, event_id, CAST(c-1 AS BIGINT) AS "column" FROM r""")
def scan_columns(spark, sf):
    ev = timeline(spark, sf).select("session", "event_id", "event_type")
    return tp.scan_columns(ev, ["session"], "event_type", "event_id", 4096).select("session", "event_id", "column")


@query("deskew_points", f"""WITH {TIMELINE}, d AS (SELECT session, CAST(floor(t/86400) AS BIGINT) AS frame, event_id, px, py, yaw, px-200 AS x, py-100 AS y FROM ev),
h AS (SELECT *, (1.5*pi()-atan2(y,x)) - 2*pi()*floor((1.5*pi()-atan2(y,x))/(2*pi())) AS phi FROM d),
q AS (SELECT session, frame, arg_min(px, event_id) AS px, arg_min(py, event_id) AS py, arg_min(yaw, event_id) AS yaw, max(phi) AS phi1 FROM h GROUP BY ALL),
l AS (SELECT *, lag(px) OVER w AS px0, lag(py) OVER w AS py0, lag(yaw) OVER w AS yaw0, lag(phi1) OVER w - 2*pi() AS phi0 FROM q WINDOW w AS (PARTITION BY session ORDER BY frame)),
i AS (SELECT h.session, h.frame, x, y, (phi-phi0)/(phi1-phi0) AS f, l.px, l.py, px0, py0, yaw0, CASE WHEN l.yaw-yaw0>pi() THEN l.yaw-yaw0-2*pi() WHEN l.yaw-yaw0<-pi() THEN l.yaw-yaw0+2*pi() ELSE l.yaw-yaw0 END AS turn FROM h JOIN l USING (session, frame) WHERE px0 IS NOT NULL)
SELECT session, frame, round(cos(yaw0+f*turn)*x - sin(yaw0+f*turn)*y + px0+f*(px-px0), 2) AS x, round(sin(yaw0+f*turn)*x + cos(yaw0+f*turn)*y + py0+f*(py-py0), 2) AS y, 0.0::DOUBLE AS z FROM i""")
def deskew_points(spark, sf):
    ev = timeline(spark, sf)
    day = F.floor(F.col("t") / 86400).cast("long")
    pts = ev.select("session", day.alias("frame"), (F.col("px") - 200).alias("x"), (F.col("py") - 100).alias("y"), F.col("pz").alias("z"))
    poses = ev.groupBy("session", day.alias("frame")).agg(*(F.min_by(c, "event_id").alias(c) for c in ("px", "py", "pz", "qx", "qy", "qz", "qw")))
    out = tp.deskew(pts, poses, ["session"], "frame")
    return out.select("session", "frame", *(F.round(a, 2).alias(a) for a in "xyz"))


@query("azimuth_slices", f"""WITH {LATTICE}, s AS (SELECT session, x-25.3 AS x, y-5.2 AS y FROM pts),
p AS (SELECT *, (1.5*pi()-atan2(y,x)) - 2*pi()*floor((1.5*pi()-atan2(y,x))/(2*pi())) AS phi FROM s), b AS (SELECT session, min(phi) AS lo, (max(phi)-min(phi))/12 AS w FROM p GROUP BY session),
k AS (SELECT p.*, lo, w, CAST(floor((phi-lo)/w) AS BIGINT) AS slice FROM p JOIN b USING (session))
SELECT session, slice, count(*) AS n, round(min(lo+(slice+0.5)*w),6) AS slice_phi FROM k WHERE phi > lo+slice*w AND slice BETWEEN 0 AND 11 GROUP BY ALL""")
def azimuth_slices(spark, sf):
    p = lattice(spark, sf).select("session", (F.col("x") - 25.3).alias("x"), (F.col("y") - 5.2).alias("y"), "z")
    out = tp.azimuth_slices(p, ["session"], 12)
    return longs(out, "slice").groupBy("session", "slice").agg(F.count(F.lit(1)).alias("n"), r6(F.min("slice_phi")).alias("slice_phi"))


@query("sessions_not_done", f"""WITH {TIMELINE} SELECT session, count(*) AS n FROM frames WHERE session NOT IN (SELECT session FROM ev WHERE event_type='error' AND value > 100) AND session BETWEEN 10 AND 120 GROUP BY session""")
def sessions_not_done(spark, sf):
    f, _ = frames_and_poses(spark, sf)
    done = timeline(spark, sf).where("event_type = 'error' AND value > 100").select("session").distinct()
    return not_done(f.where(session_filter(first=10, last=120)), done, ["session"]).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("path_stamps", """
SELECT page_id, regexp_extract(url, '://([^/.]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS stamp FROM pages""")
def path_stamps(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/.]+)", 1).alias("host"),
                                            F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as double)").alias("stamp"))
