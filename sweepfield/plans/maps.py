"""From frames and poses to voxel maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, XYZ, incidence, normal_quality, polar_ray, xyz
from ..functions.rigid import MATRIX, Rigid, move_points
from ..operators.evidence import clean_map, movable_probabilities, ray_evidence, strongest_over_sessions
from ..operators.filters import drop_sensor_origin, score_above, score_not_below
from ..operators.mapping import barycentre_map, first_hit_map
from ..operators.neighbors import transfer_labels
from ..operators.planes import extract_ground, ground_height, mark_in_plane
from ..operators.shape import frame_normals
from ..operators.temporal import (drop_near_duplicates, frames_near_place, interpolated_poses,
                                  nearest_time_join, pose_steps)
from ..operators.voxels import sphere_barycentre, voxel_id
from ..runtime import checkpointed, one_row

FRAME = ["session", "frame_ts"]


def frame_table(points: DataFrame) -> DataFrame:
    """Frames in time order with a running index over all sessions' frames of a map."""
    return points.select(*FRAME).distinct()


def with_frame_index(points: DataFrame) -> DataFrame:
    """Give points an order by frame time: microseconds serve as the index."""
    return points.withColumn("frame_idx", F.round(F.col("frame_ts") * 1_000_000).cast("long"))


def map_from_frames(points: DataFrame, poses: DataFrame, dl: float, n_lines: int = 32,
                    min_score: float = 0.1, base: DataFrame | None = None) -> DataFrame:
    """Barycentre map of all frames with known poses (matrix columns per frame)."""
    clean = drop_sensor_origin(points)
    normals = score_above(frame_normals(clean, FRAME, n_lines), min_score)
    # A stage of its own: the merge reads it for positions, counts and normals.
    world = checkpointed(move_points(normals, poses, FRAME, normals=True))
    return barycentre_map(with_frame_index(world), dl, base)


def composed_poses(poses: DataFrame, sensor: DataFrame | None) -> DataFrame:
    """Body poses times one sensor offset (a single row of matrix columns)."""
    if sensor is None:
        return poses
    one = one_row(sensor, "sensor offset").select(F.lit(0).alias("_k"), *(F.col(n).alias("s_" + n) for n in MATRIX))
    joined = poses.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").drop("_k")
    whole = Rigid.named("s_").then(Rigid.named())
    return joined.withColumns(whole.columns()).drop(*("s_" + n for n in MATRIX))


def map_from_trajectory(points: DataFrame, poses: DataFrame, dl: float, sensor: DataFrame | None = None,
                        **options) -> DataFrame:
    """Map from ground-truth or localization poses taken at other times than the frames."""
    at_frames = interpolated_poses(frame_table(points), poses, ["session"])
    return map_from_frames(points, composed_poses(at_frames, sensor), dl, **options)


def day_map(points: DataFrame, poses: DataFrame, base: DataFrame, frame_dl: float, map_dl: float,
            n_lines: int = 32, min_score: float = 0.01) -> DataFrame:
    """First-hit map of a day on top of a base map, poses given.

    Frames are thinned by sphere barycentres; the thinned points get normals from
    the whole frame, weighed by range and incidence, and are merged. Base points
    keep frame index -1.
    """
    thin = sphere_barycentre(points, frame_dl, FRAME).withColumn("id", voxel_id()).select(*FRAME, "id", *XYZ)
    normals = frame_normals(drop_sensor_origin(points), FRAME, n_lines, queries=drop_sensor_origin(checkpointed(thin)))
    n = Vec.of("nx", "ny", "nz")
    weighed = normals.where(F.col("score") >= 0).withColumn(
        "score", normal_quality("score", polar_ray(xyz()).rho, incidence(n, xyz())))
    world = move_points(score_not_below(weighed, min_score), poses, FRAME, normals=True)
    out = first_hit_map(with_frame_index(world), map_dl, base=base)
    return out.withColumn("count", F.when(F.col("frame_idx") < 0, -1).otherwise(F.col("hits")).cast("int"))


def refine_map(map_points: DataFrame, points: DataFrame, poses: DataFrame, dl: float, theta_dl: float,
               phi_dl: float, min_rays: int = 10, threshold: float = 0.9, near_gap: float | None = 0.01,
               map_id: str = "map_id") -> DataFrame:
    """Remove what several sessions' rays passed through from a map; ground stays.

    ``near_gap`` drops frames closer in time than this to the last one kept
    (None keeps all, as one of the two session types wants it).
    """
    frames = frame_table(points)
    if near_gap is not None:
        frames = drop_near_duplicates(frames, ["session"], "frame_ts", near_gap)
    kept = points.join(frames, FRAME, "left_semi")
    evidence = ray_evidence(kept, poses, map_points, FRAME, theta_dl, phi_dl, dl, ["session"], map_id)
    movable = strongest_over_sessions(movable_probabilities(evidence, min_rays, "zero"), map_id)
    ground = extract_ground(map_points, p_id=map_id, remove_dist=0.01)
    return clean_map(map_points, movable, ground, threshold, map_id)


def first_map_labels(points: DataFrame, map_points: DataFrame, evidence: DataFrame, threshold: float = 0.7,
                     map_id: str = "map_id") -> DataFrame:
    """Class 4 for frame points whose nearest map point is movable and not ground, else 0."""
    probs = movable_probabilities(evidence, 10, "negative").select(map_id, "short_prob")
    ground = extract_ground(map_points, p_id=map_id).select(map_id).withColumn("_g", F.lit(True))
    marked = (map_points.join(probs, map_id, "left").join(ground, map_id, "left")
              .withColumn("label", F.when(F.col("_g"), 0).when(F.col("short_prob") > threshold, 4).otherwise(0)))
    return transfer_labels(points, marked, ["label"], labelled_id=map_id)


def align_trajectory(estimated: DataFrame, truth: DataFrame, by: list[str], t: str, reference: int = 3) -> DataFrame:
    """Move a trajectory rigidly so that its frame no. ``reference`` (from 0) falls on the truth."""
    from ..operators.scans import top_k

    head = top_k(estimated, by, [t], reference + 1).where(F.col("rank") == reference + 1).drop("rank")
    head = head.select(*by, t, *(F.col(n).alias("e_" + n) for n in MATRIX))
    at = interpolated_poses(head, truth, by, t, "t")
    fix = Rigid.named("e_").inverse().then(Rigid.named())
    fixes = at.select(*by, *(c.alias("f_" + n) for n, c in fix.columns().items()))
    joined = estimated.join(fixes, by)
    moved = Rigid.named().then(Rigid.named("f_")).columns()
    return joined.withColumns(moved).drop(*("f_" + n for n in MATRIX))


def flatten_ground(points: DataFrame, by: list[str], planes: DataFrame, threshold: float = 0.1, band: float = 0.05) -> DataFrame:
    """Ground points set to one height (the median within ``band`` of the lowest) with an upright normal and a fixed high score."""
    marked = mark_in_plane(points, planes, by, threshold)
    level = ground_height(marked.where("in_plane"), by, band)
    joined = marked.join(level, by, "left")
    new = {"z": F.col("ground_z"), "nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "score": F.lit(0.99)}
    return joined.withColumns({c: F.when(F.col("in_plane"), v).otherwise(F.col(c)) for c, v in new.items()}).drop(
        "in_plane", "ground_z")


def merge_day_clouds(points: DataFrame, poses: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """World points of all frames near a place; the feature is the root of the time since the first of them.

    ``poses`` carry matrix columns as well as positions.
    """
    frames = frames_near_place(frame_table(points), poses, ["session"], centre, radius).select(*FRAME)
    matched = nearest_time_join(frames, poses, ["session"], "frame_ts", "t", list(MATRIX))
    world = move_points(points, matched.select(*FRAME, *MATRIX), FRAME)
    start = matched.groupBy("session").agg(F.min("frame_ts").alias("_t0"))
    return world.join(start, "session").withColumn("sqrt_dt", F.sqrt(F.col("frame_ts") - F.col("_t0"))).drop("_t0")


def session_jitter(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Translation and rotation between consecutive frames, from poses interpolated at their times."""
    return pose_steps(interpolated_poses(frames, poses, ["session"]), ["session"], "frame_ts")


def trajectory_points(poses: DataFrame, by: list[str], t: str, size: float = 1.0, samples: int = 50) -> DataFrame:
    """Three coloured axes of ``samples`` points per pose, for viewing."""
    axes = F.array(F.lit(0), F.lit(1), F.lit(2))
    rows = poses.withColumn("axis", F.explode(axes)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    along = F.col("step") * (size / samples)
    local = Vec(*(F.when(F.col("axis") == i, along).otherwise(0.0) for i in range(3)))
    colour = {c: F.when(F.col("axis") == i, 255).otherwise(0) for i, c in enumerate(("red", "green", "blue"))}
    return rows.select(*by, t, "axis", *(c.alias(n) for n, c in Rigid.named().apply(local).columns().items()),
                       *(c.alias(n) for n, c in colour.items()))
