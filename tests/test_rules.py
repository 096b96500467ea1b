"""Rules that must not depend on the epoch, on ties, on partitions or on micro-batches."""

import itertools

import pytest
from pyspark.sql import functions as F

from sweepfield.operators.sampling import pack_batches
from sweepfield.operators.temporal import asof_bracket, drop_near_duplicates
from sweepfield.runtime import one_row, shared_root
from sweepfield.sources.ply import encode, read_ply
from sweepfield.streaming import jobs
from sweepfield.streaming.tables import BucketedTable


def packed(sizes, limit):
    batch, total, out = 0, 0, []
    for s in sizes:
        if total > limit:
            batch, total = batch + 1, 0
        total += s
        out.append(batch)
    return out


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("sizes,limit", [([1] * 3000, 1500), ([0, 0, 5, 0, 3, 0, 0, 9, 1, 0], 4), ([10] * 6, 3), ([(i * 37) % 11 for i in range(800)], 60)])
def test_batches_close_only_on_overflow(spark, parts, sizes, limit):
    items = spark.createDataFrame([("a", i, s) for i, s in enumerate(sizes)] + [("b", i, s) for i, s in enumerate(sizes[:3])], "shard string, k long, size long").repartition(parts)
    got = pack_batches(items, ["shard"], "k", "size", limit, chunk=50.0).orderBy("shard", "k").collect()
    assert [r.batch for r in got] == packed(sizes, limit) + packed(sizes[:3], limit)


@pytest.mark.parametrize("base", [0.0, 1.7e9])
def test_near_duplicates_at_exact_gaps(spark, base):
    frames = spark.createDataFrame([("s", base + t) for t in (0.0, 0.25, 0.5, 0.75, 1.0, 1.49, 1.5, 1.5)], "session string, t double")
    kept = drop_near_duplicates(frames, ["session"], "t", 0.5).select(F.round(F.col("t") - base, 3).alias("t")).orderBy("t").collect()
    assert [r.t for r in kept] == [0.0, 0.5, 1.0, 1.5, 1.5]


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_asof_ties_go_to_the_lowest_id(spark, parts):
    poses = spark.createDataFrame([("s", 10.0, i, float(9 - i)) for i in range(6)] + [("s", 20.0, i, float(i)) for i in range(6)], "session string, t double, id long, px double").repartition(parts)
    frames = spark.createDataFrame([("s", 10.0), ("s", 15.0)], "session string, frame_ts double")
    got = asof_bracket(frames, poses, ["session"], "frame_ts", "t", ["px"], tie=["id"]).collect()
    assert all((r.px0, r.px1) == (9.0, 0.0) for r in got) and len(got) == 2
    low = asof_bracket(frames, poses, ["session"], "frame_ts", "t", ["px"]).collect()
    assert all((r.px0, r.px1) == (4.0, 0.0) for r in low)


def test_votes_over_several_micro_batches(spark, tmp_path):
    rows = [(k, 10 * b + i, (k + i + b) / 10) for b, keys in enumerate(([0, 1], [2, 3, 1], [3])) for k, i in itertools.product(keys, range(2))]
    for b in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == b], "pid long, event_id long, p double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from sweepfield.bindings.stream_queries import _drain

    stream = spark.readStream.schema("pid long, event_id long, p double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = _drain(spark, jobs.stream_votes(stream, ["pid"], "event_id", ["p"], 0.9), "update")
    got = {r.pid: r.p for r in out.groupBy("pid").agg(F.max_by("p", "votes").alias("p")).collect()}
    want = {}
    for k, _, p in sorted(rows, key=lambda r: r[1]):
        want[k] = 0.9 * want.get(k, 0.0) + 0.1 * p
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_horizon_stream_equals_the_batch_windows(spark, tmp_path):
    """Frames out of order within the lateness, repeated ones, a gap, and two keys; one file a micro-batch."""
    from sweepfield.bindings.stream_queries import _drain, _rocksdb
    from sweepfield.operators.temporal import horizon_windows

    rows = [(k, t + 0.125 * k) for k in (1, 2) for t in [*range(0, 40, 2), *range(90, 120), 100, 100]]
    for b in range(4):
        part = [r for r in rows if (r[1] + 3 * (r[0] % 2)) // 32 == b] + [(3, 500.0)] * (b == 3)
        spark.createDataFrame(part[::-1], "session long, t double").selectExpr("session", "timestamp_micros(cast(t * 1000000 as long)) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with _rocksdb(spark):
        out = _drain(spark, jobs.stream_horizon(stream, ["session"], "ts", -4.0, 8.0, "5 seconds"))
    want = horizon_windows(spark.createDataFrame(rows, "session long, t double"), ["session"], "t", -4.0, 8.0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    with pytest.raises(ValueError):
        jobs.stream_horizon(stream, ["session"], "ts", 1.0, 8.0)


def test_bucketed_table_rewrites_what_a_batch_touches(spark, tmp_path):
    target = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)

    def total(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    def batch(*keys):
        return spark.createDataFrame([(k, 1) for k in keys], "k long, n long")

    assert target.latest() is None
    first = target.merge(batch(*range(200)), 0, total)
    assert first["touched"] == 16
    second = target.merge(batch(5, 5), 3, total)
    assert second["touched"] == 1 and second["bytes"] < first["bytes"] / 4
    once = sorted(map(tuple, target.latest().collect()))
    assert once == [(k, 3 if k == 5 else 1) for k in range(200)]
    # A batch that failed after writing its files, or that is run again, changes nothing.
    (tmp_path / "t/data/000000000004/bucket=0").mkdir(parents=True)
    target.merge(batch(5, 5), 3, total)
    assert sorted(map(tuple, target.latest().collect())) == once
    target.merge(batch(7, 500), 4, total)
    target.merge(batch(7), 5, total)
    assert [h["number"] for h in target.history()] == [4, 5]
    got = {r.k: r.n for r in target.latest().collect()}
    assert len(got) == 201 and (got[5], got[7], got[500]) == (3, 3, 1)
    folders = {int(n): set(target.files.names(f"data/{n}")) for n in target.files.names("data")}
    named = {(b, n) for h in target.history() for b, n in h["buckets"].items()}
    assert {(x.split("=")[1], n) for n, names in folders.items() for x in names if "=" in x} == named


def test_a_second_row_is_refused(spark):
    two = spark.createDataFrame([(1,), (2,)], "a int")
    assert [r.a for r in one_row(two.where("a = 1"), "offset").collect()] == [1] and one_row(two.where("false"), "offset").count() == 0
    with pytest.raises(Exception, match="more than one offset"):
        one_row(two, "offset").collect()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_root(Session)


def test_ply_columns_come_from_all_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.ply").write_bytes(encode([np.array([1.0, 2.0], "f4")], ["x"], ["float"]))
    (tmp_path / "b.ply").write_bytes(encode([np.array([3.0], "f4"), np.array([7], "i4")], ["x", "label"], ["float", "int"]))
    got = read_ply(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.x, r.label) for r in got] == [(1.0, None), (2.0, None), (3.0, 7)]
    (tmp_path / "c.ply").write_bytes(encode([np.array([3.0], "f8")], ["x"], ["double"]))
    with pytest.raises(ValueError, match="column x"):
        read_ply(spark, str(tmp_path))


def test_ply_refuses_quads(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "q.ply").write_text(head + "4 0 1 2 3\n")
    with pytest.raises(Exception, match="only triangles"):
        read_ply(spark, str(tmp_path), element="face").collect()


def test_a_key_of_a_horizon_stream_has_one_timer():
    from types import SimpleNamespace as S

    from pyspark.sql.types import DoubleType, StructField, StructType
    import pandas as pd

    held, timers, asked = [], set(), []
    state = S(exists=lambda: bool(held), get=lambda: list(held), put=lambda rows: held.__setitem__(slice(None), rows))
    handle = S(getListState=lambda *_: state, registerTimer=lambda t: (asked.append(t), timers.add(t)), deleteTimer=timers.discard)
    windows = jobs.HorizonWindows(StructType([StructField(c, DoubleType()) for c in ("k", "oldest_ts", "origin_ts", "frame_ts", "t")]), -2.0, 8.0)
    windows.init(handle)
    closed = []
    for batch, mark in (([float(i) for i in range(40)], 25_000), ([27.5, 41.0, 26.0], 33_000), ([60.0], 60_000)):
        list(windows.handleInputRows((1,), iter([pd.DataFrame({"ts": batch})]), None))
        while due := [t for t in timers if t <= mark]:
            timers.discard(due[0])
            at = S(getCurrentWatermarkInMs=lambda: mark)
            for out in windows.handleExpiredTimer((1,), at, S(getExpiryTimeInMs=lambda: due[0])):
                closed += out["oldest_ts"].unique().tolist()
        assert len(timers) <= 1
    assert len(asked) <= 6
    times = sorted({*map(float, range(40)), 27.5, 41.0, 60.0})
    assert closed == [t for t in times if t + 10 < 60.0]
