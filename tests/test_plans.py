import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import corridor
from sweepfield.functions.rigid import matrices_of
from sweepfield.operators.evidence import ray_evidence
from sweepfield.plans import annotation, maps, reports


@pytest.fixture(scope="module")
def scene(spark):
    points, poses, fine, static, block = corridor(6)
    return {"points": spark.createDataFrame(points).cache(), "poses": spark.createDataFrame(poses).cache(),
            "fine": spark.createDataFrame(fine).cache(), "static": static, "block": block, "pdf": points, "ppdf": poses}


def base_map(spark, static):
    up = np.abs(static[:, 1]) < 3.05
    pdf = pd.DataFrame(static, columns=list("xyz"))
    pdf["nx"], pdf["ny"], pdf["nz"] = 0.0, np.where(up, 0.0, 1.0), np.where(up, 1.0, 0.0)
    pdf["score"], pdf["id"] = 0.9, np.arange(len(pdf))
    return spark.createDataFrame(pdf)


def test_trajectory_map_equals_frame_map(spark, scene):
    a = maps.map_from_trajectory(scene["points"], scene["fine"], 0.5, n_lines=24).toPandas()
    at = maps.interpolated_poses(scene["points"].select("session", "frame_ts").distinct(), scene["fine"], ["session"]).toPandas()
    assert len(at) == 6 and np.allclose(at.t0, at.frame_ts - 100, atol=1e-6)
    assert len(a) > 100 and a["score"].max() <= 1 + 1e-9
    n = np.linalg.norm(a[["nx", "ny", "nz"]], axis=1)
    assert (n < 1.0001).all() and np.median(n) > 0.99


def test_annotation(spark, scene):
    base = base_map(spark, scene["static"])
    out = annotation.annotate_session(scene["points"], scene["poses"], base, 0.1, 0.2, n_lines=24, min_rays=2,
                                      theta_dl=0.04, phi_dl=0.03, margin=0.15)
    labels = out["map_labels"].toPandas()
    frames = out["frame_labels"]
    assert frames.count() == len(scene["pdf"])
    ground = labels[labels.classif == 1]
    assert len(ground) > 200 and ground.z.abs().max() < 0.3 and ground.z.abs().median() < 0.02
    block = labels[(labels.x.between(5.9, 6.2)) & (labels.y.abs() < 0.35) & (labels.z > 0.45) & (labels["count"] >= 0)]
    assert len(block) and (block.classif.isin([0, 3, 4])).all()
    # The base map covers the walls only within these limits.
    walls = labels[(labels.y.abs() > 3.0) & labels.z.between(0.5, 1.7) & labels.x.between(-3.5, 11)]
    assert (walls.classif == 2).mean() > 0.9


def test_refined_map_loses_the_block(spark, scene):
    block = pd.DataFrame(scene["block"], columns=list("xyz"))
    static = pd.DataFrame(scene["static"], columns=list("xyz"))
    m = pd.concat([static.assign(nx=0.0, ny=0.0, nz=1.0), block.assign(nx=-1.0, ny=0.0, nz=0.0)]).reset_index(drop=True)
    m["map_id"] = m.index
    late = scene["points"].where("frame_ts > 100.25")
    out = maps.refine_map(spark.createDataFrame(m), late, scene["poses"], 0.1, 0.04, 0.03, 2, 0.9).toPandas()
    kept = set(out.map_id)
    gone = block.index.size - sum(k >= len(static) for k in kept)
    assert gone > 10
    assert sum(k < len(static) for k in kept) > 0.95 * len(static)


def test_ray_evidence_against_loops(spark, scene):
    rng = np.random.default_rng(4)
    m = pd.DataFrame(rng.uniform([0, -2, 0.3], [8, 2, 1.8], (150, 3)), columns=list("xyz"))
    n = rng.normal(size=(150, 3))
    m[["nx", "ny", "nz"]] = n / np.linalg.norm(n, axis=1, keepdims=True)
    m["map_id"] = range(150)
    th, ph, dl = 0.05, 0.05, 0.1
    got = ray_evidence(scene["points"], scene["poses"], spark.createDataFrame(m), ["session", "frame_ts"], th, ph, dl).toPandas()
    want = {}
    for _, pose in scene["ppdf"].iterrows():
        f = scene["pdf"][scene["pdf"].frame_ts == pose.frame_ts][list("xyz")].to_numpy()
        t = np.array([pose.t0, pose.t1, pose.t2])
        w = f + t
        cells = {tuple(c) for c in np.floor(w / dl).astype(int)}
        rho = np.linalg.norm(f, axis=1)
        theta, phi = np.arctan2(np.hypot(f[:, 0], f[:, 1]), f[:, 2]), np.arctan2(f[:, 1], f[:, 0]) + np.pi / 2
        th0, ph0 = theta.min() - th / 2, phi.min() - ph / 2
        free = {}
        for r, i, j in zip(rho, np.floor((theta - th0) / th), np.floor((phi - ph0) / ph)):
            free[i, j] = min(r, free.get((i, j), 1e9))
        lo, hi = w.min(0) - dl, w.max(0) + dl
        for row in m.itertuples():
            p = np.array([row.x, row.y, row.z])
            k = np.floor(p / dl).astype(int)
            if any((k[0] + a, k[1] + b, k[2] + c) in cells for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)):
                c, s = want.get(row.map_id, (0, 0))
                want[row.map_id] = (c + 1, s)
                continue
            if (p < lo).any() or (p > hi).any():
                continue
            q = p - t
            r = np.linalg.norm(q)
            key = (np.floor((np.arctan2(np.hypot(q[0], q[1]), q[2]) - th0) / th), np.floor((np.arctan2(q[1], q[0]) + np.pi / 2 - ph0) / ph))
            if key not in free or not (2 * dl < r < free[key] - max(dl, free[key] * th / 2)):
                continue
            nn = np.array([row.nx, row.ny, row.nz])
            if abs(nn[2]) > 0.5 or np.arccos(min(abs(q @ nn / r), 1)) < 5 * np.pi / 12:
                c, s = want.get(row.map_id, (0, 0))
                want[row.map_id] = (c + 1, s + 1)
    assert {r.map_id: (r["count"], r.prob) for _, r in got.iterrows()} == want


def test_future_clouds(spark, scene):
    static = pd.DataFrame(scene["static"], columns=list("xyz")).assign(nx=0.0, ny=0.0)
    static["nz"] = np.where(static.y.abs() < 3.05, 1.0, 0.0)
    static["map_id"] = static.index
    labelled = scene["points"].withColumn("classif", F.when(F.col("z") > -0.9, 2).otherwise(1))
    out = annotation.future_clouds(labelled, scene["poses"], spark.createDataFrame(static), 0.5, -0.1, 0.2).toPandas()
    assert len(out) and out.classif.eq(2).all()
    assert out.groupby("origin_ts").t.min().round(3).eq(-0.1).all()
    assert out.t.max() <= 0.41


def test_align_and_jitter(spark, scene):
    fine = matrices_of(scene["fine"])
    frames = scene["points"].select("session", "frame_ts").distinct()
    truth = scene["fine"]
    est = maps.interpolated_poses(frames, truth, ["session"]).withColumn("t0", F.col("t0") + 5).withColumn("t1", F.col("t1") - 2)
    out = maps.align_trajectory(est, truth, ["session"], "frame_ts", 3).toPandas()
    assert np.allclose(out.t0, out.frame_ts - 100, atol=1e-6) and np.allclose(out.t1, 0, atol=1e-6)
    steps = maps.session_jitter(frames, truth).toPandas()
    assert np.allclose(steps.d_trans, 0.1, atol=1e-6) and np.allclose(steps.d_rot, 0, atol=1e-6)
    axes = maps.trajectory_points(fine, ["session"], "t", 1.0, 5)
    assert axes.count() == fine.count() * 15


def test_flat_ground_and_day_merge(spark, scene):
    pts = spark.createDataFrame(pd.DataFrame({"g": 0, "x": np.arange(10.0), "y": 0.0, "z": [0.0, 0.01, 0.02, 0.01, 0.0, 0.03, 0.02, 0.01, 2.0, 3.0],
                                              "nx": 0.1, "ny": 0.0, "nz": 0.9, "score": 0.5}))
    plane = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0)], "g int, a double, b double, c double, d double")
    out = maps.flatten_ground(pts, ["g"], plane).toPandas()
    assert sorted(out.z.round(3))[-2:] == [2.0, 3.0] and out[out.z < 1].z.nunique() == 1
    fine = scene["fine"].join(matrices_of(scene["fine"]), ["session", "t"])
    near = maps.merge_day_clouds(scene["points"], fine, (0.2, 0.0, 1.0), 0.15).toPandas()
    assert near.sqrt_dt.min() == 0 and near.frame_ts.nunique() in (2, 3)


def test_reports(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": 1, "truth": rng.integers(0, 3, 500), "pred": rng.integers(0, 3, 500)})
    shares = spark.createDataFrame([(1, 0.7), (2, 0.3)], "label int, share double")
    out = reports.validation_report(spark.createDataFrame(pdf), shares, [0, 1, 2], [0], ["g"])
    kept = pdf[(pdf.truth > 0) & (pdf.pred > 0)]
    assert out["confusion"].agg(F.sum("n")).first()[0] == len(kept)
    acc = out["accuracy"].first()["acc"]
    assert math.isclose(acc, (kept.truth == kept.pred).mean(), abs_tol=1e-6)


def test_first_map_labels_and_offsets(spark, scene):
    m = spark.createDataFrame(pd.DataFrame({"map_id": range(40), "x": np.arange(40.0), "y": 0.0, "z": [0.0] * 30 + [1.0] * 10,
                                            "nx": 0.0, "ny": 0.0, "nz": [1.0] * 30 + [0.0] * 10}))
    m = m.withColumn("y", F.pmod(F.col("map_id") * 7, F.lit(5)).cast("double"))
    e = m.select("map_id", F.lit(10).cast("long").alias("count"), F.when(F.col("map_id") >= 25, 10).otherwise(0).cast("long").alias("prob"))
    out = maps.first_map_labels(m.select(F.col("map_id").alias("id"), "x", "y", "z"), m, e).toPandas()
    assert set(out[out.label == 4].id) == set(range(30, 40))
    sensor = matrices_of(scene["fine"]).limit(1).drop("session", "t").withColumns({"t0": F.lit(0.5), "t1": F.lit(0.0), "t2": F.lit(0.25)})
    moved = maps.composed_poses(scene["poses"], sensor).toPandas().sort_values("frame_ts")
    assert np.allclose(moved.t0, 0.5 + 0.1 * np.arange(6)) and np.allclose(moved.t2, 1.25)
