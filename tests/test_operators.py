import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepfield.operators import filters, mapping, neighbors, octree, planes, scans, scoring, selection, shape, temporal, voxels
from sweepfield.functions import geometry as g

XYZ = list("xyz")


def frame(spark, array, **more):
    pdf = pd.DataFrame(array, columns=XYZ)
    for k, v in more.items():
        pdf[k] = v
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("rows", [octree.RUN_ROWS, 40])
def test_nearest_with_hot_cell_and_copies(spark, rows, monkeypatch):
    """A third of the supports in one tiny cell, a third copies of one point, the rest spread; far queries too."""
    monkeypatch.setattr(octree, "RUN_ROWS", rows)
    rng = np.random.default_rng(0)
    s = np.vstack([rng.normal(2, 0.001, (300, 3)), np.tile([[1.0, 1.0, 1.0]], (300, 1)), rng.uniform(-5, 5, (300, 3))])
    q = np.vstack([rng.uniform(-5, 5, (200, 3)), rng.normal(2, 0.002, (50, 3)), [[60.0, 0, 0]], np.tile([[1.0, 1.0, 1.1]], (40, 1))])
    out = neighbors.nearest_join(frame(spark, q, q_id=range(len(q))), frame(spark, s, s_id=range(len(s)))).toPandas()
    want = ((q[:, None] - s[None]) ** 2).sum(-1).argmin(1)
    assert out.sort_values("q_id").s_id.tolist() == want.tolist()


def test_nearest_queries_at_one_place_ask_once_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(octree, "PART_ROWS", 50)
    seen = []
    ordered = octree._in_order
    monkeypatch.setattr(octree, "_in_order", lambda *a: seen.append(ordered(*a)) or seen[-1])
    rng = np.random.default_rng(2)
    s, places = rng.uniform(0, 1, (100, 3)), rng.uniform(0, 1, (12, 3))
    q = places[rng.integers(0, 12, 1400)]
    out = neighbors.nearest_join(frame(spark, q, q_id=range(len(q))), frame(spark, s, s_id=range(len(s)))).toPandas()
    assert out.sort_values("q_id").s_id.tolist() == ((q[:, None] - s[None]) ** 2).sum(-1).argmin(1).tolist()
    assert seen[0].rdd.getNumPartitions() > 20
    assert seen[0].where("_asks and _row = _asker").count() <= 12 * 30 / 2


def brute_nearest(queries, supports, most=None):
    """By group, ties to the lowest id; None without any."""
    out = {}
    for i, (g, *p) in queries.items():
        found = [] if g is None or None in p else [(sum((a - b) ** 2 for a, b in zip(p, r)), j) for j, (h, *r) in supports.items() if h == g and None not in r]
        best = min(found, default=(None, None))
        out[i] = best if best[0] is not None and (most is None or best[0] <= most * most) else (None, None)
    return out


@pytest.mark.parametrize("rows", [octree.RUN_ROWS, 16])
def test_nearest_by_group_with_ties_nulls_and_clashing_names(spark, rows, monkeypatch):
    monkeypatch.setattr(octree, "RUN_ROWS", rows)
    monkeypatch.setattr(octree, "MOST_RUNS", 1 << 30)
    rng = np.random.default_rng(4)

    def points(n, odd):
        made = {i: (("a", "b", None)[int(rng.integers(0, 3))] if i % 9 else "hot", *map(float, rng.integers(-3, 4, 3))) for i in range(n)}
        return made | {n: odd}

    s, q = points(300, ("a", None, 0.0, 0.0)), points(200, ("a", 0.0, None, 0.0))
    q[201] = ("nowhere", 0.0, 0.0, 0.0)
    q[202] = ("a", 1e9, 0.0, -1e9)
    make = lambda rows, name: spark.createDataFrame([(v[0], i, f"c{i}", "row", *v[1:]) for i, v in rows.items()], f"_g string, {name} long, _hit string, _row string, x double, y double, z double").repartition(5)
    for most in (None, 1.0):
        got = neighbors.nearest_join(make(q, "_ask"), make(s, "_run"), ["_g"], "_ask", "_run", ["_hit"], max_distance=most).collect()
        assert len(got) == len(q) and {r._ask: (r.d2, r._run) for r in got} == brute_nearest(q, s, most)
        assert all(r._hit == (None if r._run is None else f"c{r._run}") for r in got)
    assert {(r._run, r.d2) for r in neighbors.nearest_join(make(q, "_ask"), make({}, "_run"), ["_g"], "_ask", "_run").collect()} == {(None, None)}
    assert neighbors.nearest_join(make({}, "_ask"), make(s, "_run"), ["_g"], "_ask", "_run").collect() == []


def test_leaves_split_only_full_cells():
    rng = np.random.default_rng(3)
    code = np.sort(np.concatenate([rng.integers(0, 1 << 60, 300), rng.integers(5 << 40, (5 << 40) + (1 << 20), 3000)]))
    starts = octree.leaves(code, np.zeros(len(code), int))
    sizes = np.diff(starts, append=len(code))
    assert starts[0] == 0 and sizes.max() <= octree.LEAF and (np.diff(starts) > 0).all()
    assert len(starts) < 3300 / 3  # cells are not split further than they need


def test_radius_is_strict_and_signs_do_not_matter(spark):
    q = frame(spark, [[-0.5, 0, 0]], q_id=[0])
    s = frame(spark, [[0.5, 0, 0], [0.4999, 0, 0], [-1.4999, 0, 0]], s_id=[0, 1, 2])
    assert sorted(r.s_id for r in neighbors.radius_pairs(q, s, 1.0).collect()) == [1, 2]
    assert neighbors.radius_pairs(q, s, 1.0, explode="support").count() == 2


def test_spheres_against_loops(spark):
    pts = np.random.default_rng(1).uniform(-3, 3, (300, 3))
    got = voxels.sphere_barycentre(frame(spark, pts), 1.0).toPandas()
    sums = {}
    for p in pts:
        k = np.floor(p).astype(int)
        for d in np.ndindex(3, 3, 3):
            c = k + np.array(d) - 1
            if ((p - (c + 0.5)) ** 2).sum() < 2.25:
                sums.setdefault(tuple(c), []).append(p)
    want = {k: np.mean(v, 0) for k, v in sums.items() if (np.floor(np.mean(v, 0)) == k).all()}
    assert {(r.vx, r.vy, r.vz) for r in got.itertuples()} == set(want)
    assert all(np.allclose([r.x, r.y, r.z], want[r.vx, r.vy, r.vz]) for r in got.itertuples())


def fold(points):
    score, normal = -1.0, np.zeros(3)
    for s, n in points:
        if s > score + 0.1:
            score, normal = s, n.copy()
        elif s > score - 0.1:
            score = max(score, s)
            normal = normal + n if normal @ n > 0 else normal - n
    return score, normal / (np.linalg.norm(normal) + 1e-6)


def test_normal_merge_follows_the_order(spark):
    """Normals in all directions, so that signs do depend on the order in many voxels."""
    rng = np.random.default_rng(5)
    pts, n = rng.uniform(0, 3, (600, 3)), rng.normal(size=(600, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    s = rng.uniform(0.5, 0.75, 600)
    df = frame(spark, pts, id=range(600), frame_idx=np.arange(600) // 50, score=s, nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])
    got = mapping.merged_normals(df, 1.0, None, "frame_idx", "id").toPandas()
    keys = [tuple(k) for k in np.floor(pts).astype(int)]
    for r in got.itertuples():
        score, normal = fold([(s[i], n[i]) for i in range(600) if keys[i] == (r.vx, r.vy, r.vz)])
        assert r.score == pytest.approx(score) and np.allclose([r.nx, r.ny, r.nz], normal, atol=1e-6)
    other = mapping.merged_normals(df.repartition(37), 1.0, None, "frame_idx", "id").toPandas()
    key = ["vx", "vy", "vz"]
    assert np.allclose(got.sort_values(key)[["nx", "ny", "nz"]], other.sort_values(key)[["nx", "ny", "nz"]])


def test_first_hit_maps_merge(spark):
    rng = np.random.default_rng(6)
    pts = frame(spark, rng.uniform(0, 4, (200, 3)), id=range(200), frame_idx=np.arange(200) // 20, score=rng.uniform(size=200), nx=0.0, ny=0.0, nz=1.0)
    whole = mapping.first_hit_map(pts, 1.0)
    parts = [mapping.merge_first_hit(mapping.first_hit_state(pts.where(c), 1.0)) for c in ("frame_idx % 2 = 0", "frame_idx % 2 = 1")]
    assert whole.exceptAll(mapping.merge_first_hit(parts[0].unionByName(parts[1]))).count() == 0


def test_ground_of_a_box_on_a_plane(spark):
    rng = np.random.default_rng(7)
    floor = np.c_[rng.uniform(-5, 5, (1500, 2)), rng.normal(0, 0.01, 1500)]
    box = np.c_[rng.uniform(1, 2, (300, 2)), rng.uniform(0.3, 1, 300)]
    df = frame(spark, np.vstack([floor, box]), id=range(1800), nx=0.0, ny=0.0, nz=[1.0] * 1500 + [0.0] * 300)
    plane = planes.ransac_plane(df.where("nz > 0.5"), [], 0.1).first()
    assert abs(plane.c) > 0.99 and abs(plane.d) < 0.1
    ids = {r.id for r in planes.extract_ground(df, remove_dist=0.1).select("id").collect()}
    assert ids <= set(range(1500)) and len(ids) > 1300


def test_frame_normals_on_a_wall(spark):
    phi, theta = np.meshgrid(np.radians(np.arange(60, 120, 0.5)), np.radians(np.linspace(70, 110, 41)), indexing="ij")
    d = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], -1).reshape(-1, 3)
    df = frame(spark, d * (5 / d[:, 1])[:, None], id=range(len(d)), f=0)
    out = shape.frame_normals(df, ["f"], 41).toPandas()
    good = out[out.score >= 0]
    assert len(good) > 0.9 * len(d) and np.allclose(good.ny, -1, atol=1e-3)
    some = shape.frame_normals(df, ["f"], 41, queries=df.where("id % 7 = 0")).toPandas()
    assert (some.score > 0.99).mean() > 0.9


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 120], "a long, b long")
    out = planes.connected_components(edges).toPandas()
    assert set(out.component) == {0, 121} and (out.component == 121).sum() == 80


def test_prefix_scan_equals_window(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300), "o": rng.permutation(300), "v": rng.integers(0, 50, 300)})
    out = scans.prefix_scan(spark.createDataFrame(pdf), ["k"], ["o"], F.floor(F.col("o") / 17), {
        "s": scans.running("sum", "v"), "m": scans.running("max", "v", exclusive=True), "p": scans.previous("v"), "n": scans.following("v")}).toPandas()
    for _, part in out.sort_values("o").groupby("k"):
        assert part.s.tolist() == part.v.cumsum().tolist()
        assert np.array_equal(part.m.fillna(-1), part.v.cummax().shift().fillna(-1))
        assert np.array_equal(part.p.fillna(-1), part.v.shift().fillna(-1)) and np.array_equal(part.n.fillna(-1), part.v.shift(-1).fillna(-1))


def test_large_top_k_is_salted(spark):
    df = spark.range(5000).withColumn("k", F.lit(0))
    out = scans.top_k(df, ["k"], [F.desc("id")], 1500)
    assert out.agg(F.min("id")).first()[0] == 3500 and out.count() == 1500


def test_thresholds_against_comparison(spark):
    p = np.round(np.linspace(0, 1, 101), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "prob": p, "truth": p > 0.3}))
    out = scoring.threshold_counts(df, ["g"]).toPandas()
    for r in out.itertuples():
        t = 1 - r.k / 50
        assert (r.tp, r.fp) == (((p > t) & (p > 0.3)).sum(), ((p > t) & ~(p > 0.3)).sum())


def test_bad_input_is_refused(spark):
    with pytest.raises(ValueError):
        scoring.confusion(spark.range(1), [0, 0])
    with pytest.raises(Exception, match="negative"):
        scoring.confusion(spark.createDataFrame([(-1, 0)], "truth int, pred int"), [0]).collect()
    with pytest.raises(Exception, match="axis"):
        filters.drop_sensor_origin(frame(spark, [[0.0, 0.0, 1.0]]), mode="fail").collect()
    assert filters.finite(frame(spark, [[np.nan, 0, 0], [1.0, 0, 0]])).count() == 1
    lonely = frame(spark, [[0.0, 0, 0]], q_id=[0]), frame(spark, [[9.0, 0, 0]], s_id=[0])
    with pytest.raises(Exception, match="no neighbour"):
        neighbors.neighbourhood_frames(*lonely, 1.0).collect()


def test_quantised_votes(spark):
    v = [0.3, 0.9, 0.1, 0.7]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(v)], "pid int, o int, p double")
    state = 0.0
    for p in v:
        state = np.floor((0.5 * state + 0.5 * p) * 255) / 255
    assert scoring.folded_votes(df, ["pid"], "o", ["p"], 0.5, quantised=True).first().p == pytest.approx(state)
    flip = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 0.0, -1.0)], "pid int, o int, a double, b double")
    assert scoring.folded_votes(flip, ["pid"], "o", ["a", "b"], 0.5, align_sign=True).first().b == pytest.approx(1.0)


def test_slerp_ends_and_middle(spark):
    from sweepfield.functions.rigid import with_slerp

    h = np.pi / 4
    df = spark.createDataFrame([(f, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -float(np.sin(h)), -float(np.cos(h))) for f in (0.0, 0.5, 1.0)],
                               "f double, a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    out = with_slerp(df, ["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"], "f").orderBy("f").toPandas()
    assert np.allclose(np.abs(out.qz), [0, np.sin(h / 2), np.sin(h)])
    p = g.Polar(F.lit(2.0), F.lit(0.7), F.lit(1.1))
    row = spark.range(1).select(*(c.alias(n) for n, c in zip("abc", g.polar_wrapped(g.cartesian_from_wrapped(p))))).first()
    assert np.allclose(row, [2.0, 0.7, 1.1])


def test_attentive_and_slices(spark):
    cells = spark.range(2000).select(F.lit(0).alias("g"), F.col("id").alias("t_idx"), F.lit(0).alias("px"), F.lit(0).alias("py"),
                                     F.when(F.col("id") < 100, 1.0).otherwise(0.0).alias("gt_sum"), F.lit(0.0).alias("pred_sum"))
    kept = filters.attentive(cells, ["g"])
    n = kept.count()
    assert kept.where("gt_sum > 0").count() == 100 and 150 < n < 260
    assert filters.attentive(cells.repartition(9), ["g"]).count() == n and filters.attentive(cells, ["g"], 0).count() == 2000
    ring = pd.DataFrame({"f": 0, "x": np.cos(np.arange(0.1, 6.2, 0.1)), "y": np.sin(np.arange(0.1, 6.2, 0.1)), "z": 0.0})
    cut = temporal.azimuth_slices(spark.createDataFrame(ring), ["f"], 4)
    pose = spark.createDataFrame([(0, *[0.0] * 6, 1.0, 4.0, *[0.0] * 5, 1.0, 0.0, 8.0)], "f int, px0 double, py0 double, pz0 double, qx0 double, qy0 double, qz0 double, qw0 double, px1 double, py1 double, pz1 double, qx1 double, qy1 double, qz1 double, qw1 double, phi0 double, phi1 double")
    at = temporal.slice_poses(cut, pose, ["f"]).orderBy("slice").toPandas()
    assert len(at) == 4 and at.t0.is_monotonic_increasing


def fold_in_order(rows, smooth, quantised=False, align=False):
    state = {}
    for pid, _, *new in sorted(rows, key=lambda r: r[1]):
        new, p = np.array(new), state.get(pid)
        p = (new if align else np.zeros(len(new))) if p is None else p
        new = -new if align and p @ new < 0 else new
        p = smooth * p + (1 - smooth) * new
        state[pid] = np.floor(p * 255) / 255 if quantised else p
    return state


def test_byte_votes_of_a_hot_key_over_many_chunks(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 3 else f"k{i % 50}", i, *map(float, rng.uniform(0, 1, 2))) for i in range(4000)] + [(None, 5000, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "pid string, o long, p double, q double").repartition(5)
    got = scoring.folded_votes(df, ["pid"], "o", ["p", "q"], 0.9, quantised=True, chunk=F.floor(F.col("o") / 100).cast("long")).collect()
    want = fold_in_order(rows, 0.9, quantised=True)
    assert {r.pid: (r.p, r.q) for r in got} == {k: tuple(v) for k, v in want.items()}
    assert {r.pid: r.votes for r in got}["hot"] == sum(r[0] == "hot" for r in rows)
    with pytest.raises(Exception, match="between 0 and 1"):
        scoring.folded_votes(df.withColumn("p", F.col("p") + 1), ["pid"], "o", ["p"], 0.9, quantised=True).collect()


def test_quantised_votes_of_any_size(spark):
    rows = [("plain", i, i % 7 / 6, 0.5) for i in range(300)] + [("wide", i, i % 5 - 1.5, 3.0 * (i % 2)) for i in range(300)] + [(None, i, 0.25, 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "pid string, o long, p double, q double").repartition(5)
    got = scoring.folded_votes(df, ["pid"], "o", ["p", "q"], 0.9, quantised=True, unbounded=True, chunk=F.floor(F.col("o") / 100).cast("long")).collect()
    assert {r.pid: (r.p, r.q) for r in got} == {k: tuple(v) for k, v in fold_in_order(rows, 0.9, quantised=True).items()}
    assert {r.pid: r.votes for r in got} == {"plain": 300, "wide": 300, None: 40}
    for wrong in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite|between 0 and 1"):
            scoring.folded_votes(df.withColumn("p", F.lit(wrong).cast("double")), ["pid"], "o", ["p"], 0.9, quantised=True, unbounded=True).collect()


def test_aligned_votes_inside_and_outside_the_cone(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        near = np.array([1.0, 0.2, 0.1]) + rng.normal(0, 0.1, 3)
        rows += [("hot", i, *map(float, near * rng.choice([-1, 1]))), (f"odd{i % 20}", i, *map(float, rng.normal(0, 1, 3))), (f"few{i}", i, *map(float, rng.normal(0, 1, 3)))]
    rows += [("zero", 0, 0.0, 0.0, 0.0), ("zero", 1, -1.0, 0.0, 0.0), ("zero", 2, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid string, o long, a double, b double, c double").repartition(5)
    got = scoring.folded_votes(df, ["pid"], "o", ["a", "b", "c"], 0.7, align_sign=True, chunk=F.floor(F.col("o") / 100).cast("long")).collect()
    want = fold_in_order(rows, 0.7, align=True)
    assert len(got) == len(want) and all(np.allclose([r.a, r.b, r.c], want[r.pid], atol=1e-9) for r in got)


def test_composed_runs_equal_one_after_another():
    rng = np.random.default_rng(8)
    maps, run = rng.integers(0, 256, (57, 3, 256)).astype(np.uint8), np.sort(rng.integers(0, 9, 57))
    got, starts = scoring.compose_runs(maps, run)
    for m, a, b in zip(got, starts, [*starts[1:], len(run)]):
        want = np.tile(np.arange(256), (3, 1))
        for i in range(a, b):
            want = np.take_along_axis(maps[i], want, axis=1)
        assert (m == want).all()


@pytest.mark.parametrize("logits,error", [(False, "linear"), (True, "linear"), (True, "bce")])
def test_errors_of_a_sparse_grid_equal_those_of_the_dense_one(spark, logits, error):
    from sweepfield.operators import raster

    rng = np.random.default_rng(9)
    sparse = {(k, int(i)): [float(v) for v in rng.uniform(0, 1, 4)] for k in range(3) for i in rng.choice(40, 7 * k + 1, replace=False)}
    rows = [(k, i, *sparse.get((k, i), [0.0] * 4)) for k in range(3) for i in range(40)]
    schema = "k long, i long, p_a double, p_b double, g_a double, g_b double"
    dense = raster.cell_errors(spark.createDataFrame(rows, schema), ["k"], ["a", "b"], logits, error)
    some = raster.cell_errors(spark.createDataFrame([(*key, *v) for key, v in sparse.items()], schema), ["k"], ["a", "b"], logits, error, nodes=40)
    for x, y in zip(*(sorted(map(tuple, d.collect())) for d in (dense, some))):
        assert np.allclose(x, y, atol=1e-6)
    with pytest.raises(ValueError):
        raster.cell_errors(dense, ["k"], ["a"], False, "bce", nodes=3)


@pytest.mark.parametrize("left", [selection.LEFT, 5])
def test_order_statistics_of_hot_and_odd_groups(spark, left, monkeypatch):
    monkeypatch.setattr(selection, "LEFT", left)
    rng = np.random.default_rng(10)
    groups = {"hot": rng.normal(0, 1, 3000), "copies": np.repeat([1.5, -2.0, 7.0], [500, 900, 3]), "one": np.array([4.0]), "wild": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), [-1.7e308, 1.7e308, 5e-324, 0.0]])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = selection.order_statistics(df, ["g"], "v", F.array(F.lit(0), F.floor(F.col("n") / 3), F.col("n") - 1, F.col("n"))).collect()
    want = {(g, k): np.sort(vs)[k] for g, vs in groups.items() for k in {0, len(vs) // 3, len(vs) - 1}}
    assert {(r.g, r["rank"]): r.value for r in got} == want
    mid = {r.g: r.m for r in selection.group_quantile(df, ["g"], "v", 0.5, "m").collect()}
    assert all(mid[g] == pytest.approx(np.median(vs), rel=1e-12) for g, vs in groups.items())
    assert [r.value for r in selection.order_statistics(df, [], "v", F.array(F.lit(1))).collect()] == [float(np.sort(np.concatenate([*groups.values(), [1.0]]))[1])]


@pytest.mark.parametrize("k", [0, 1, 700, 1999, 2000, 5000])
def test_lowest_rows_with_ties_and_nulls(spark, k):
    rows = [(i, None if i % 97 == 0 else float("nan") if i % 89 == 0 else float(i * 31 % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, p double").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0, r[0]))
    assert sorted(r.id for r in selection.lowest(df, k, F.col("p"), ["id"]).collect()) == sorted(i for i, _ in order[:k])
    assert [r["rank"] for r in selection.ranked(df, ["id"]).orderBy("id").collect()] == list(range(1, 2001))
