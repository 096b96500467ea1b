"""Streaming operators drained over the event files, against the SQL of their batch twins."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..runtime import shared_root
from ..streaming import jobs
from ..streaming.tables import BucketedTable
from .ray_queries import EVIDENCE, PH, TH, setup
from .registry import TIMELINE, query, rounded, table


def _folder(spark) -> str:
    """A fresh folder next to the checkpoints: shared on a cluster, temporary in a test."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _read(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _finish(handle):
    handle.awaitTermination()
    if handle.exception():
        raise handle.exception()


def _drain(spark, stream, mode="append"):
    """Run a stream over all there is and return what it wrote: in update mode the rows of every micro-batch, else the last."""
    root = _folder(spark)
    if mode == "append":
        _finish(stream.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/ckpt")
                .trigger(availableNow=True).start())
        return spark.read.parquet(root + "/out")
    target = jobs.VersionedTable(spark, root + "/out")
    _finish(stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: target.write(df, n))
            .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start())
    return target.every() if mode == "update" else target.latest()


def _points(df):
    return df.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("frame_idx"), F.col("value").alias("x"),
                     (F.col("value") / 2).alias("y"), F.lit(0.0).alias("z"), (F.col("user_id") / 200).alias("score"),
                     F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))


@query("stream_first_hit_map", """WITH p AS (SELECT *, floor(value/8) AS vx, row_number() OVER (PARTITION BY floor(value/8), floor(value/2/8) ORDER BY ts, event_id) AS a, count(*) OVER (PARTITION BY floor(value/8), floor(value/2/8)) AS hits,
 max(user_id/200) OVER (PARTITION BY floor(value/8), floor(value/2/8)) AS score FROM events)
SELECT CAST(vx AS BIGINT) AS vx, CAST(floor(value/2/8) AS BIGINT) AS vy, event_id AS id, value AS x, round(score,6) AS score, hits FROM p WHERE a=1""")
def stream_first_hit_map(spark, sf):
    root = _folder(spark)
    target = BucketedTable(spark, root + "/map", ["vx", "vy", "vz"], buckets=8)
    events = _in_time_order(spark, table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", 3)
    _finish(jobs.stream_first_hit_map(_points(events), 8.0, target, root + "/ckpt"))
    return rounded(target.latest(), "score").select("vx", "vy", "id", "x", "score", "hits")


@contextmanager
def _rocksdb(spark):
    """The state store that list state and timers need; the session's own one comes back afterwards."""
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, rocks)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _in_time_order(spark, df, ts, parts):
    """``df`` as files that a stream reads one by one, each later than the one before."""
    root = _folder(spark)
    ends = df.agg(F.min(F.col(ts).cast("double")).alias("a"), F.max(F.col(ts).cast("double")).alias("b")).first()
    at = F.least(F.floor((F.col(ts).cast("double") - ends["a"]) / max(ends["b"] - ends["a"], 1e-6) * parts), F.lit(parts - 1))
    for k in range(parts):
        df.where(at == k).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


LATE = 3600
HORIZON = f"""WITH {TIMELINE}, e AS (SELECT a.session, a.t AS oldest, b.t AS fin FROM (SELECT DISTINCT session, t FROM ev) a ASOF JOIN (SELECT DISTINCT session, t FROM ev) b ON a.session=b.session AND a.t+36*3600.0 < b.t),
m AS (SELECT e.session, e.oldest, e.fin, v.t, abs(v.t-(e.oldest+6*3600.0)) AS gap FROM e JOIN (SELECT DISTINCT session, t FROM ev) v ON v.session=e.session AND v.t BETWEEN e.oldest AND e.fin WHERE fin <= (SELECT max(t) FROM ev) - {LATE}),
o AS (SELECT session, oldest, min({{'gap': gap, 't': t}}).t AS origin FROM m GROUP BY ALL)
SELECT m.session, round(m.oldest,6) AS oldest_ts, round(o.origin,6) AS origin_ts, round(m.t,6) AS frame_ts, round(m.t-o.origin,6) AS t FROM m JOIN o USING (session, oldest)"""


@query("stream_horizon", HORIZON)
def stream_horizon(spark, sf):
    """Every window closed by a frame that the watermark has passed, from files read one a micro-batch."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    with _rocksdb(spark):
        out = _drain(spark, jobs.stream_horizon(_in_time_order(spark, ev, "ts", 4), ["session"], "ts", -6 * 3600.0, 30 * 3600.0, f"{LATE} seconds"))
    return rounded(out, "oldest_ts", "origin_ts", "frame_ts", "t")


@query("stream_votes", """WITH v AS (SELECT user_id AS pid, value/500 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT pid, round(sum(p*0.1*pow(0.9,rn-1)),6) AS p, count(*) AS votes FROM v GROUP BY pid""")
def stream_votes(spark, sf):
    ev = _read(spark, sf, "events").select(F.col("user_id").alias("pid"), "event_id", (F.col("value") / 500).alias("p"))
    out = _drain(spark, jobs.stream_votes(ev, ["pid"], "event_id", ["p"], 0.9), "update")
    return rounded(out.groupBy("pid").agg(F.max_by("p", "votes").alias("p"), F.max("votes").alias("votes")), "p")


@query("stream_ray_evidence", EVIDENCE + " SELECT map_id, count, prob FROM evd")
def stream_ray_evidence(spark, sf):
    """Frames in parts: every file holds half of one frame and half of the one before it; a late mark closes the last."""
    fp, po, m = setup(spark, sf)
    fp = fp.withColumn("ts", F.timestamp_seconds(F.col("frame") * 10)).withColumn("_part", F.col("frame") + F.pmod(F.xxhash64("x", "y", "z"), F.lit(2)))
    root = _folder(spark)
    last = fp.agg(F.max("frame")).first()[0]
    for k in range(1, last + 2):
        fp.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(root + "/frames")
    mark = fp.limit(1).select((F.col("frame") + last + 100).alias("frame"), "x", "y", "z", F.timestamp_seconds(F.lit(last * 10 + 1000)).alias("ts"))
    mark.coalesce(1).write.mode("append").parquet(root + "/frames")
    stream = spark.readStream.schema(mark.schema).option("maxFilesPerTrigger", 1).parquet(root + "/frames")
    target = BucketedTable(spark, root + "/evidence", ["map_id"], buckets=8)
    _finish(jobs.stream_ray_evidence(stream, po, m, ["frame"], TH, PH, 0.5, target, root + "/ckpt", ts="ts", lateness="15 seconds"))
    return target.latest().select("map_id", "count", "prob")


@query("stream_window_stats", """SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value),4) AS total, round(count(*)/86400.0::DOUBLE,9) AS rate FROM events GROUP BY ALL""")
def stream_window_stats(spark, sf):
    ev = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, jobs.stream_window_stats(ev, ["event_type"], "ts", "value", "1 day"), "complete")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("rate", 9).alias("rate"))


@query("stream_sessions", """WITH l AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS fl FROM events),
s AS (SELECT *, sum(fl) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, CAST(epoch_us(max(ts)+INTERVAL '6 hours') AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def stream_sessions(spark, sf):
    ev = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, jobs.stream_sessions(ev, ["user_id"], "ts", "6 hours"), "complete")
    return out.select("user_id", *(F.unix_micros(c).alias(c) for c in ("start", "end")), "n")
