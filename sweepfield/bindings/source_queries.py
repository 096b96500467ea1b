"""Files of every kind written from the driver tables, read back, against the SQL of the tables themselves."""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators.voxels import voxel_barycentre
from ..plans import maps
from ..runtime import shared_root
from ..sources import catalogue, logs, packets, ply, poses
from ..storage import FILES_A_FOLDER, write_files, write_many
from .registry import LATTICE, TIMELINE, lattice, longs, query, r6, rounded, table, timeline
from .stream_queries import _drain


def _folder(spark):
    """A fresh folder next to the checkpoints: shared on a cluster, temporary in a test."""
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


def _among(df, key):
    """A folder for each ``key``, so many that none holds many more than ``FILES_A_FOLDER`` files of one key each."""
    folders = math.ceil(df.agg(F.approx_count_distinct(key)).first()[0] / FILES_A_FOLDER)
    return F.concat(F.pmod(F.xxhash64(key), F.lit(max(1, folders))).cast("string"), F.lit("/"))


def _day(session):
    return F.format_string("2020-01-%02d-00-00-00", session.cast("int") + 1)


DAY = "printf('2020-01-%02d-00-00-00', (session + 1)::INT)"
FRAMES = f"WITH {LATTICE}, f AS (SELECT {DAY} AS session, label / 2.0 AS frame_ts, x, y, z, label FROM pts)"


def _frames(spark, sf):
    p = lattice(spark, sf)
    return p.select(_day(F.col("session")).alias("session"), (F.col("label") / 2.0).alias("frame_ts"),
                    *(F.col(a).cast("float").alias(a) for a in "xyz"), F.col("label").cast("int").alias("label"))


@query("ply_frames", FRAMES + " SELECT session, frame_ts, x, y, z, label, row_number() OVER (PARTITION BY session, frame_ts ORDER BY x, y, z) - 1 AS id FROM f")
def ply_frames(spark, sf):
    """Frames written as PLY files in point order; columns come from the headers."""
    root = _folder(spark)
    ply.write_ply(_frames(spark, sf), root, order=["x", "y", "z"])
    back = ply.read_ply(spark, root)
    return longs(back.select("session", "frame_ts", *(F.col(a).cast("double").alias(a) for a in "xyz"), "label", "id"), "label")


@query("ply_stream", FRAMES + " SELECT session, frame_ts, count(*) AS n, sum(x) AS sx FROM f GROUP BY ALL")
def ply_stream(spark, sf):
    root = _folder(spark)
    ply.write_ply(_frames(spark, sf), root)
    out = _drain(spark, ply.stream_ply(spark, root + "/*", "x float, label int").select("session", "frame_ts", "x"))
    return out.groupBy("session", "frame_ts").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("sx"))


@query("ply_catalogue", FRAMES + " SELECT DISTINCT session, frame_ts FROM f WHERE session BETWEEN '2020-01-03' AND '2020-01-06'")
def ply_catalogue(spark, sf):
    """Two folders of frames, of which each session counts the first it has; sessions by name range."""
    root = _folder(spark)
    f = _frames(spark, sf).withColumn("kind", F.when(F.col("session") < "2020-01-04", "raw").otherwise("annotated"))
    ply.write_ply(f.drop("label").select("session", "kind", "frame_ts", "x"), root, ["session", "kind", "frame_ts"])
    extra = f.where("kind = 'annotated'").withColumn("kind", F.lit("raw")).withColumn("frame_ts", F.col("frame_ts") + 1000)
    ply.write_ply(extra.select("session", "kind", "frame_ts", "x"), root, ["session", "kind", "frame_ts"])
    listed = catalogue.catalogue_with_fallback(spark, root, ("annotated", "raw"))
    both = catalogue.frame_catalogue(spark, root).select("session", "frame_ts").join(listed.select("session", "frame_ts"), ["session", "frame_ts"], "left_semi")
    return both.where(catalogue.session_filter(first="2020-01-03", last="2020-01-06"))


@query("ply_unexpected", FRAMES + " SELECT DISTINCT session, printf('frames/%.6f.ply', frame_ts) AS file FROM f WHERE frame_ts > 2.5")
def ply_unexpected(spark, sf):
    root = _folder(spark)
    ply.write_ply(_frames(spark, sf).select("session", F.lit("frames").alias("kind"), "frame_ts", "x"), root, ["session", "kind", "frame_ts"])
    return catalogue.unexpected_files(spark, root, [r"^frames/[012]\.[05]0+\.ply$"]).select("session", "file")


@query("snapshot_iou", FRAMES + """, c AS (SELECT (label % 3)::INT AS epoch, unnest([1, 2, 3]) AS label, (x::INT % 3) + 1 AS gt, (y::INT % 3) + 1 AS pred FROM f)
SELECT epoch, label::BIGINT AS label, round(coalesce(sum((gt = label AND pred = label)::INT) / nullif(sum((gt = label OR pred = label)::INT), 0), 0), 6) AS iou FROM c GROUP BY ALL""")
def snapshot_iou(spark, sf):
    """Predictions of three epochs as PLY files of their folders."""
    root = _folder(spark)
    f = _frames(spark, sf)
    rows = f.select("session", F.concat(F.lit("val_preds_"), (F.col("label") % 3).cast("string")).alias("kind"), "frame_ts", "x",
                    (F.col("x").cast("int") % 3 + 1).cast("int").alias("gt"), (F.col("y").cast("int") % 3 + 1).cast("int").alias("pred"))
    ply.write_ply(rows, root, ["session", "kind", "frame_ts"])
    out = catalogue.snapshot_iou(catalogue.snapshot_points(spark, root, "x float, gt int, pred int"), [1, 2, 3], "gt", "pred")
    return longs(rounded(out.select("epoch", "label", "iou"), "iou"), "label")


@query("map_versions", f"WITH {LATTICE} SELECT 2::BIGINT AS version, CAST(floor(x/4) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy, CAST(floor(z/4) AS BIGINT) AS vz, count(*) AS n FROM pts GROUP BY ALL")
def map_versions(spark, sf):
    """A job that publishes a version twice, the second time with other rows."""
    root = _folder(spark)
    p = lattice(spark, sf)
    for version, m in ((1, p.where("label = 1")), (2, p), (2, p.where("label = 2"))):
        catalogue.write_map_version(voxel_barycentre(m, 4.0).select("vx", "vy", "vz", "n"), root, version)
    newest, version = catalogue.latest_map(spark, root)
    return newest.select(F.lit(version).cast("long").alias("version"), "vx", "vy", "vz", "n")


def _csv(df, root, header, by=None):
    """``df`` as CSV files below ``root``, a folder for each value of ``by``."""
    w = df.write.option("header", header).option("nullValue", "")
    (w.partitionBy(by) if by else w).csv(root)
    return f"{root}/*" if by else root


@query("csv_legacy_poses", f"WITH {TIMELINE} SELECT printf('2020-01-%02d-00-00-00', (session % 28 + 1)::INT) AS session, round(t, 6) AS t, px, py, round(sin(yaw/2), 9) AS qz, round(cos(yaw/2), 9) AS qw FROM ev")
def csv_legacy_poses(spark, sf):
    ev = timeline(spark, sf).withColumn("day", F.format_string("2020-01-%02d-00-00-00", (F.col("session") % 28 + 1).cast("int")))
    rows = ev.select("day", "t", *(F.lit(0).alias(f"_{i}") for i in range(4)), "px", "py", "pz", "qx", "qy", "qz", "qw")
    back = poses.read_legacy_poses(spark, _csv(rows, _folder(spark), True, "day"))
    return back.select("session", r6("t").alias("t"), "px", "py", F.round("qz", 9).alias("qz"), F.round("qw", 9).alias("qw"))


@query("csv_euler_poses", """WITH e AS (SELECT event_id, value/100 AS a, value/200 AS b, value/300 AS c, value FROM events)
SELECT event_id::DOUBLE AS t, round(cos(c)*cos(b),6) AS r00, round(cos(c)*sin(b)*sin(a)-sin(c)*cos(a),6) AS r01, round(-sin(b),6) AS r20, round(cos(b)*cos(a),6) AS r22, value AS t0, value*2 AS t1 FROM e""")
def csv_euler_poses(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("t"), v.alias("x"), (v * 2).alias("y"), F.lit(0.0).alias("z"), (v / 100).alias("roll"), (v / 200).alias("pitch"), (v / 300).alias("heading"))
    back = poses.read_euler_poses(spark, _csv(rows, _folder(spark), True))
    return rounded(back.select("t", "r00", "r01", "r20", "r22", "t0", "t1"), "r00", "r01", "r20", "r22")


@query("csv_odometry", f"WITH {TIMELINE} SELECT round(t, 6) AS t, value FROM ev WHERE t BETWEEN (SELECT min(t) FROM ev) + 86400 AND (SELECT min(t) FROM ev) + 5 * 86400")
def csv_odometry(spark, sf):
    ev = timeline(spark, sf)
    first = ev.agg(F.min("t")).first()[0]
    back = poses.read_odometry(spark, _csv(ev.select("t", "value"), _folder(spark), True), first + 86400, first + 5 * 86400, ["value"])
    return rounded(back, "t")


# Three transforms per session: two shifts, then a quarter turn to the left with a shift.
@query("csv_calibration", f"""WITH {TIMELINE}, s AS (SELECT session, round(max(value), 3) AS a, count(*) AS b FROM ev GROUP BY session)
SELECT session, round(r00, 6) AS r00, round(r10, 6) AS r10, round(t0, 6) AS t0, round(t1, 6) AS t1, t2 FROM (SELECT session, 0.0 AS r00, 1.0 AS r10, -(b + 2.0) + 7 AS t0, a + 1.0 + 8 AS t1, 9.0 AS t2 FROM s)""")
def csv_calibration(spark, sf):
    s = timeline(spark, sf).groupBy("session").agg(F.round(F.max("value"), 3).alias("a"), F.count(F.lit(1)).alias("b"))
    line = lambda x, y, z, turn: F.concat_ws(",", F.lit("from"), F.lit("to"), *(F.col(v).cast("string") if isinstance(v, str) else F.lit(str(v)) for v in (x, y, z)), F.lit("0,0"), F.lit(str(turn)), F.lit(str(1.0 if turn == 0 else turn)))
    half = 0.5 ** 0.5
    text = F.concat_ws("\n", F.lit("header"), line("a", 2, 0, 0), F.lit("x"), F.lit("x"), line(1, "b", 0, 0), F.lit("x"), F.lit("x"), line(7, 8, 9, half))
    root, folder = _folder(spark), _among(timeline(spark, sf), "session")
    write_many(s.select(F.concat(folder, F.lit("calib_"), F.col("session").cast("string"), F.lit(".csv")).alias("name"), text.cast("binary").alias("content")), root)
    back = poses.read_calibration(spark, f"{root}/*")
    return rounded(back.select(F.regexp_extract("path", r"calib_(\d+)", 1).cast("long").alias("session"), "r00", "r10", "t0", "t1", "t2"), "r00", "r10", "t0", "t1")


def _lines(df, name, order, text):
    """One file per ``name`` whose lines are in ``order``."""
    return df.groupBy(F.col(name).cast("string").alias("name")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n").cast("binary").alias("content"))


@query("log_confusions", """WITH c AS (SELECT l_linenumber % 3 AS run, month(l_shipdate) - 1 AS epoch, (l_quantity::INT) % 2 AS truth, (l_tax * 100)::INT % 2 AS pred FROM lineitem),
g AS (SELECT run, epoch, t.i AS truth, p.i AS pred FROM (SELECT DISTINCT run, epoch FROM c), (SELECT unnest([0, 1]) AS i) t, (SELECT unnest([0, 1]) AS i) p)
SELECT g.run::BIGINT AS run, g.epoch::BIGINT AS epoch, g.truth::BIGINT AS truth, g.pred::BIGINT AS pred, count(c.run) AS n FROM g LEFT JOIN c ON c.run = g.run AND c.epoch = g.epoch AND c.truth = g.truth AND c.pred = g.pred GROUP BY ALL""")
def log_confusions(spark, sf):
    """A confusion matrix of every month on one line of its run's log."""
    c = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3).alias("run"), (F.month("l_shipdate") - 1).alias("epoch"),
                                            (F.col("l_quantity").cast("int") % 2 * 2 + F.round(F.col("l_tax") * 100).cast("int") % 2).alias("cell"))
    row = c.groupBy("run", "epoch").agg(F.concat_ws(" ", *(F.count_if(F.col("cell") == k).cast("string") for k in range(4))).alias("text"))
    root = _folder(spark)
    write_files(_lines(row, "run", "epoch", "text"), root)
    back = logs.read_confusions(spark, root, 2).withColumn("run", F.regexp_extract("path", r"/(\d+)$", 1))
    return longs(back.select("run", "epoch", "truth", "pred", "n"), "run", "epoch", "truth", "pred", "n")


@query("log_training", """SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, user_id AS epoch, event_id AS step, round(value, 4) AS loss_out, CASE WHEN event_type < 'p' THEN round(value / 2, 4) END AS loss_prop FROM events""")
def log_training(spark, sf):
    """Logs of both layouts: some lack the last two losses."""
    v = F.format_string("%.6f", F.col("value"))
    own = F.concat_ws(" ", F.col("user_id").cast("string"), F.col("event_id").cast("string"), v, F.lit("0.1 0.9 1.5"))
    more = F.concat_ws(" ", own, v, F.format_string("%.6f", F.col("value") / 2))
    rows = table(spark, sf, "events").select("event_type", "event_id", F.when(F.col("event_type") < "p", more).otherwise(own).alias("text"))
    head = rows.select("event_type").distinct().select("event_type", F.lit(-1).cast("long").alias("event_id"), F.lit("epoch step out p acc t").alias("text"))
    root = _folder(spark)
    write_files(_lines(rows.unionByName(head), "event_type", "event_id", "text"), root)
    back = logs.read_training_log(spark, root)
    return longs(back.select(F.regexp_extract("path", r"/([^/]+)$", 1).alias("run"), "line", "epoch", "step", F.round("loss_out", 4).alias("loss_out"), F.round("loss_prop", 4).alias("loss_prop")), "line", "epoch", "step")


@query("log_iou", """SELECT user_id AS run, epoch, object::BIGINT AS object, label::BIGINT AS label, round(value / 100 + object + label / 10, 4) AS iou
FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS epoch FROM events), (SELECT unnest([0, 0, 1]) AS object, unnest([0, 1, 0]) AS label)""")
def log_iou(spark, sf):
    """Two classes of a first object and one of a second on each line, read by both readers."""
    at = lambda o, l: F.format_string("%.6f", F.col("value") / 100 + o + l / 10)
    text = F.concat(at(0, 0), F.lit(" "), at(0, 1), F.lit(" / "), at(1, 0))
    flat = F.concat(F.lit("["), at(0, 0), F.lit(", "), at(0, 1), F.lit("]"))
    ev = table(spark, sf, "events")
    file = F.concat(_among(ev, "user_id"), F.col("user_id").cast("string")).alias("file")
    root, other = _folder(spark), _folder(spark)
    write_many(_lines(ev.select(file, "event_id", text.alias("text")), "file", "event_id", "text"), root)
    write_many(_lines(ev.select(file, "event_id", flat.alias("text")), "file", "event_id", "text"), other)
    run = F.regexp_extract("path", r"/(\d+)$", 1).alias("run")
    many = logs.read_multi_iou(spark, f"{root}/*").select(run, "epoch", "object", "label", "iou")
    one = logs.read_single_iou(spark, f"{other}/*").select(run, "epoch", F.lit(0).alias("object"), "label", F.col("iou").alias("single"))
    both = many.join(one, ["run", "epoch", "object", "label"], "left")
    same = F.when(F.col("single").isNull() | (F.col("single") == F.col("iou")), F.col("iou"))
    return longs(both.select("run", "epoch", "object", "label", F.round(same, 4).alias("iou")), "run", "epoch", "object", "label")


def _packed(spark, sf, headers):
    """A log per session of hit records; with headers a packet for every label."""
    p = lattice(spark, sf).select("session", "label", *(F.round((F.col(a) + 100) / packets.SCALE).cast("int").alias(a) for a in "xyz"))

    order = ["session", "label", "x", "y", "z"]
    schema = "session long, label long, part long, raw binary"

    def encode(batches):
        """The records of each stretch of one session and label; range partitions and batches come in order."""
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            hits = np.zeros(b.num_rows, packets.HIT)
            for a in "xyz":
                hits[a] = b.column(a).to_numpy()
            session, label = b.column("session").to_numpy(), b.column("label").to_numpy()
            hits["laser"] = label
            starts = np.flatnonzero((np.diff(session, prepend=session[:1] - 1) != 0) | (np.diff(label, prepend=label[:1] - 1) != 0))
            ends = np.append(starts[1:], len(hits))
            yield pa.RecordBatch.from_arrays([pa.array(session[starts], pa.int64()), pa.array(label[starts], pa.int64()), pa.array(part + np.arange(len(starts))),
                                              pa.array([hits[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["session", "label", "part", "raw"])
            part += len(starts)

    def head(batches):
        for b in batches:
            raw = [packets.MAGIC + n.to_bytes(4, "little") + (1000 + k).to_bytes(8, "little") + bytes(4) for k, n in zip(b.column("label").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("label"), pa.array([-1] * len(raw), pa.int64()), pa.array(raw, pa.binary())], ["session", "label", "part", "raw"])

    p = p.select(F.col("session").cast("long"), "label", "x", "y", "z")
    pieces = p.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, schema)
    if headers:
        pieces = pieces.unionByName(p.groupBy("session", "label").agg(F.count(F.lit(1)).alias("n")).mapInArrow(head, schema))
    # A file is one value, joined outside of Python.
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "part", F.col("raw").cast("string").alias("raw")))), lambda s: s["raw"]), "")
    files = pieces.groupBy("session").agg(joined.cast("binary").alias("content"))
    root = _folder(spark)
    write_files(files.select(F.concat(F.col("session").cast("string"), F.lit(".bin")).alias("name"), "content"), root)
    return root


@query("packet_logs", f"WITH {LATTICE} SELECT session, 1000 + label AS utime, row_number() OVER (PARTITION BY session ORDER BY label, x, y, z) - 1 AS seq, x, y, z, label AS laser FROM pts")
def packet_logs(spark, sf):
    back = packets.read_packets(spark, _packed(spark, sf, True), "*.bin")
    session = F.regexp_extract("path", r"/(\d+)\.bin$", 1).alias("session")
    return longs(rounded(back.select(session, "utime", "seq", "x", "y", "z", "laser"), "x", "y", "z"), "session", "laser")


@query("packed_frames", f"WITH {LATTICE} SELECT session, row_number() OVER (PARTITION BY session ORDER BY label, x, y, z) - 1 AS seq, x, y, z, label AS laser FROM pts")
def packed_frames(spark, sf):
    back = packets.read_packed_frames(spark, _packed(spark, sf, False), "*.bin")
    session = F.regexp_extract("path", r"/(\d+)\.bin$", 1).alias("session")
    return longs(rounded(back.select(session, "seq", "x", "y", "z", "laser"), "x", "y", "z"), "session", "laser")


@query("trajectory_axes", f"""WITH {TIMELINE}, a AS (SELECT unnest([0, 1, 2]) AS axis), k AS (SELECT unnest(range(5)) AS step)
SELECT session, event_id, axis::BIGINT AS axis, round(px + CASE axis WHEN 0 THEN cos(yaw) WHEN 1 THEN -sin(yaw) ELSE 0 END * step * 0.2, 6) AS x, round(py + CASE axis WHEN 0 THEN sin(yaw) WHEN 1 THEN cos(yaw) ELSE 0 END * step * 0.2, 6) AS y,
 round(CASE axis WHEN 2 THEN step * 0.2 ELSE 0 END, 6) AS z, CASE axis WHEN 1 THEN 255 ELSE 0 END::BIGINT AS green FROM ev, a, k""")
def trajectory_axes(spark, sf):
    from ..functions.geometry import Vec
    from ..functions.rigid import QUATERNION, rigid_from_quaternion

    ev = timeline(spark, sf).withColumns(rigid_from_quaternion(QUATERNION, Vec.of("px", "py", "pz")).columns())
    out = maps.trajectory_points(ev, ["session"], "event_id", 1.0, 5)
    return longs(rounded(out.select("session", "event_id", "axis", "x", "y", "z", "green"), "x", "y", "z"), "axis", "green")
