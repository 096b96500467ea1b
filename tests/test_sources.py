import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepfield.sources import catalogue, logs, packets, ply, poses

DAY = "2020-05-06-07-08-09"


def cloud(n=7):
    rng = np.random.default_rng(1)
    return {"x": rng.normal(size=n).astype("f4"), "y": rng.normal(size=n).astype("f4"), "z": rng.normal(size=n).astype("f4"),
            "cat": np.arange(n, dtype="i4")}


def triplet(folder, c):
    """The same cloud as ascii, little and big endian."""
    os.makedirs(folder)
    n = len(c["x"])
    head = "ply\nformat {}\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nproperty int cat\nend_header\n"
    with open(f"{folder}/1.000000.ply", "w") as f:
        f.write(head.format("ascii 1.0", n))
        for row in zip(*c.values()):
            f.write(" ".join(repr(v.item()) for v in row) + "\n")
    for name, order, mark in (("2.000000", "little", "<"), ("3.000000", "big", ">")):
        t = np.empty(n, [("x", mark + "f4"), ("y", mark + "f4"), ("z", mark + "f4"), ("cat", mark + "i4")])
        for k, v in c.items():
            t[k] = v
        with open(f"{folder}/{name}.ply", "wb") as f:
            f.write(head.format(f"binary_{order}_endian 1.0", n).encode() + t.tobytes())


def test_ply_formats_agree(spark, tmp_path):
    c = cloud()
    triplet(f"{tmp_path}/{DAY}/frames", c)
    df = ply.read_ply(spark, str(tmp_path))
    out = df.toPandas().sort_values(["frame_ts", "id"])
    assert out.session.unique().tolist() == [DAY] and out.frame_ts.unique().tolist() == [1.0, 2.0, 3.0]
    for _, part in out.groupby("frame_ts"):
        assert all(np.array_equal(part[k].to_numpy(), v) for k, v in c.items())
    wide = ply.read_ply(spark, str(tmp_path), "x float, nx float").toPandas()
    assert wide.nx.isna().all() and len(wide) == 21
    listed = catalogue.frame_catalogue(spark, str(tmp_path)).toPandas()
    assert listed.frame_ts.tolist() == [1.0, 2.0, 3.0]
    none = ply.read_ply(spark, str(tmp_path), "x float", sessions=catalogue.session_filter(first="2021"))
    assert none.count() == 0


def test_ply_round_trip_and_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"session": DAY, "frame_ts": np.repeat([1.5, 2.5], 50), "id": list(range(50)) * 2,
                        "x": rng.normal(size=100), "label": np.arange(100, dtype="int32")})
    ply.write_ply(spark.createDataFrame(pdf), f"{tmp_path}/out", order=["id"])
    assert sorted(n for n in os.listdir(f"{tmp_path}/out/{DAY}") if n[0] != ".") == ["1.500000.ply", "2.500000.ply"]
    # A file that exists stops the whole write; nothing of it appears.
    more = spark.createDataFrame(pdf.assign(frame_ts=pdf.frame_ts + 1))
    with pytest.raises(FileExistsError):
        ply.write_ply(more, f"{tmp_path}/out", order=["id"])
    assert not os.path.exists(f"{tmp_path}/out/{DAY}/3.500000.ply") and os.listdir(f"{tmp_path}/out/_staging") == []
    assert ply.write_ply(more.where("frame_ts > 3"), f"{tmp_path}/out", order=["id"]) == [f"{DAY}/3.500000.ply"]
    ply.write_ply(spark.createDataFrame(pdf.assign(x=pdf.x + (pdf.frame_ts > 2))), f"{tmp_path}/out", mode="overwrite", order=["id"])
    assert ply.read_ply(spark, f"{tmp_path}/out", "x double").where("frame_ts = 2.5").agg(F.sum("x")).first()[0] == pytest.approx(pdf.x[pdf.frame_ts > 2].sum() + 50)
    os.remove(f"{tmp_path}/out/{DAY}/3.500000.ply")
    pdf["x"] = pdf.x + (pdf.frame_ts > 2)
    back = ply.read_ply(spark, f"{tmp_path}/out", "x double, label int").toPandas().sort_values(["frame_ts", "x"])
    assert np.array_equal(back[["frame_ts", "x"]], pdf.sort_values(["frame_ts", "x"])[["frame_ts", "x"]])
    stream = ply.stream_ply(spark, f"{tmp_path}/out/{DAY}", "x double, label int")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/pq").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 100


def test_ply_rejects_bad_input():
    with pytest.raises(ValueError):
        ply.encode([np.zeros(3), np.zeros(2)], ["x", "y"], ["float", "float"])
    with pytest.raises(ValueError):
        ply.encode([np.zeros(3)], ["x", "y"], ["float"])
    with pytest.raises(ValueError):
        ply.parse_header(b"not a ply")


def test_mesh_files(spark, tmp_path):
    v = spark.createDataFrame([("a", i, float(i), 0.0, 1.0) for i in range(4)], "mesh string, v_id int, x double, y double, z double")
    f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 1, 2, 3)], "mesh string, f_id int, v1 int, v2 int, v3 int")
    assert ply.write_mesh(v, f, f"{tmp_path}/m").first()["faces"] == 2
    faces = ply.read_ply(spark, f"{tmp_path}/m", element="face").orderBy("id").select("v1", "v2", "v3").collect()
    assert [tuple(r) for r in faces] == [(0, 1, 2), (1, 2, 3)]
    assert ply.read_ply(spark, f"{tmp_path}/m").count() == 4


def test_packets(spark, tmp_path):
    hits = np.zeros(5, packets.HIT)
    hits["x"], hits["laser"] = np.arange(5) * 200, np.arange(5)
    raw = b""
    for k in range(2):
        raw += packets.MAGIC + (5).to_bytes(4, "little") + (1000 + k).to_bytes(8, "little") + b"\0" * 4 + hits.tobytes()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "log.bin").write_bytes(raw + packets.MAGIC[:5])
    out = packets.read_packets(spark, str(tmp_path / "p")).toPandas().sort_values("seq")
    assert out.utime.tolist() == [1000] * 5 + [1001] * 5 and np.allclose(out.x[:5], np.arange(5) - 100)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "frame.bin").write_bytes(hits.tobytes())
    assert packets.read_packed_frames(spark, str(tmp_path / "f")).count() == 5
    with pytest.raises(ValueError):
        list(packets.decode_packets(b"\0" * 30))


def test_logs(spark, tmp_path):
    (tmp_path / "conf.txt").write_text("1 2 3 4\n5 6 7 8\n")
    c = logs.read_confusions(spark, str(tmp_path / "conf.txt"), 2).toPandas()
    assert c[(c.epoch == 1) & (c.truth == 1) & (c.pred == 0)].n.tolist() == [7]
    (tmp_path / "train.txt").write_text("epoch step out p acc t\n0 1 0.5 0.1 0.9 1.5\n1 2 0.4 0.1 0.8 2.5 0.3 0.2\n")
    t = logs.read_training_log(spark, str(tmp_path / "train.txt")).toPandas().sort_values("epoch")
    assert t.loss_prop.isna().tolist() == [True, False] and t.acc.tolist() == [0.9, 0.8]
    (tmp_path / "iou.txt").write_text("[0.1, 0.2]\n[0.3, 0.4]\n")
    assert logs.read_single_iou(spark, str(tmp_path / "iou.txt")).agg(F.sum("iou")).first()[0] == pytest.approx(1.0)
    (tmp_path / "multi.txt").write_text("0.1 0.2 / 0.3 / 0.5 0.6\n")
    m = logs.read_multi_iou(spark, str(tmp_path / "multi.txt")).toPandas()
    assert m.object.value_counts().to_dict() == {0: 2, 1: 1, 2: 2}


def test_pose_files(spark, tmp_path):
    day = tmp_path / DAY
    day.mkdir()
    (day / "gt.csv").write_text("h\n" + ",".join(str(v) for v in [7, 0, 0, 0, 0, 1, 2, 3, 0, 0, 0, 1]) + "\n")
    p = poses.read_legacy_poses(spark, str(day / "gt.csv")).first()
    assert (p.session, p.t, p.px, p.qw) == (DAY, 7.0, 1.0, 1.0)
    (day / "euler.csv").write_text("t,x,y,z,r,p,h\n1,2,3,4,0,0,90\n")
    e = poses.read_euler_poses(spark, str(day / "euler.csv"), degrees=True).first()
    assert abs(e.r10 - 1) < 1e-9 and e.t1 == 3.0
    rows = [["", ""] + [0] * 7 for _ in range(8)]
    for i, shift in ((1, 1.0), (4, 10.0), (7, 100.0)):
        rows[i] = ["a", "b", shift, 0, 0, 0, 0, 0, 1]
    (day / "calib.csv").write_text("\n".join(",".join(map(str, r)) for r in rows))
    assert poses.read_calibration(spark, str(day / "calib.csv")).first().t0 == 111.0
    (day / "odo.csv").write_text("t,v\n1,5\n2,6\n3,7\n")
    assert poses.read_odometry(spark, str(day / "odo.csv"), 2, 3, ["v"]).count() == 2
    table = spark.createDataFrame([("gt", "a", 1.0), ("loc", "a", 1.0), ("loc", "b", 2.0)], "kind string, session string, t double")
    days = spark.createDataFrame([("a",), ("b",)], "session string")
    picked = poses.poses_with_fallback(table, days, ["gt", "loc"]).toPandas().sort_values("session")
    assert picked.kind.tolist() == ["gt", "loc"]
    with pytest.raises(Exception, match="no poses"):
        poses.poses_with_fallback(table, days.union(spark.createDataFrame([("c",)], "session string")), ["gt", "loc"]).collect()


def test_versions_snapshots_and_audit(spark, tmp_path):
    m = spark.range(3)
    for v in (1, 2):
        catalogue.write_map_version(m.limit(v), f"{tmp_path}/map", v)
    newest, version = catalogue.latest_map(spark, f"{tmp_path}/map")
    assert version == 2 and newest.count() == 2
    # A job that is run again, or that died before its version was published, changes nothing.
    assert not catalogue.write_map_version(m, f"{tmp_path}/map", 2)
    m.write.parquet(f"{tmp_path}/map/_staging/dead")
    newest, version = catalogue.latest_map(spark, f"{tmp_path}/map")
    assert version == 2 and newest.count() == 2 and spark.read.parquet(f"{tmp_path}/map").count() == 3
    assert catalogue.map_versions(spark, f"{tmp_path}/map") == [1, 2]
    folder = tmp_path / DAY / "val_preds_3"
    folder.mkdir(parents=True)
    data = ply.encode([np.zeros(2), np.array([1, 2]), np.array([1, 1])], ["x", "gt", "pred"], ["float", "int", "int"])
    (folder / "1.5.ply").write_bytes(data)
    (folder / "1.5_sub.ply").write_bytes(data)
    pts = catalogue.snapshot_points(spark, str(tmp_path / DAY), "x float, gt int, pred int")
    assert pts.count() == 2 and pts.first()["epoch"] == 3
    assert catalogue.snapshot_iou(pts, [0, 1, 2], "gt", "pred", [0]).count() == 2
    odd = catalogue.unexpected_files(spark, str(tmp_path / DAY), [r"^val_preds_\d+/[\d.]+\.ply$"]).toPandas()
    assert odd.file.tolist() == ["val_preds_3/1.5_sub.ply"]


@pytest.mark.parametrize("parts", [1, 3])
def test_many_small_files_and_names_that_repeat(spark, tmp_path, parts):
    from sweepfield.storage import Files, write_files

    asked = []
    seen = Files.names
    rows = spark.range(400).selectExpr("concat('a%b=', id % 7, '/n ', id, '.txt') AS name", "cast(cast(id AS string) AS binary) AS content").repartition(parts)
    Files.names = lambda self, name="": asked.append(name) or seen(self, name)
    try:
        done = write_files(rows, f"{tmp_path}/out")
    finally:
        Files.names = seen
    # Folders are listed once each, not once a file.
    assert len(done) == 400 and len(asked) <= 7
    for i in (0, 8, 399):
        with open(f"{tmp_path}/out/a%b={i % 7}/n {i}.txt") as f:
            assert f.read() == f"{i}\n"
    twice = spark.createDataFrame([("x", b"1"), ("x", b"2"), ("y", b"3")], "name string, content binary").repartition(parts)
    with pytest.raises(FileExistsError):
        write_files(twice, f"{tmp_path}/twice")
    assert not os.path.exists(f"{tmp_path}/twice/x") and not os.path.exists(f"{tmp_path}/twice/y")
    assert write_files(twice.where("name = 'z'"), f"{tmp_path}/none") == []


def test_long_packets_are_decoded_in_steps(spark, tmp_path, monkeypatch):
    from sweepfield.sources import packets

    hits = np.zeros(25, packets.HIT)
    hits["x"], hits["laser"] = np.arange(25), np.arange(25) % 3
    head = lambda n, t: packets.MAGIC + n.to_bytes(4, "little") + t.to_bytes(8, "little") + bytes(4)
    raw = head(20, 7) + hits[:20].tobytes() + head(0, 8) + head(5, 9) + hits[20:].tobytes() + head(9, 10)
    monkeypatch.setattr(packets, "STEP", 8)
    assert [(t, len(h["x"])) for t, h in packets.decode_packets(raw)] == [(7, 8), (7, 8), (7, 4), (9, 5)]
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(raw)
    got = packets.read_packets(spark, str(tmp_path), "*.bin").orderBy("path", "seq").toPandas()
    assert got.seq.tolist() == list(range(25)) * 2 and got.utime.tolist() == ([7] * 20 + [9] * 5) * 2
    assert np.allclose(got.x, np.tile(np.arange(25) * packets.SCALE + packets.OFFSET, 2)) and got.laser.tolist() == (np.arange(25) % 3).tolist() * 2
