"""Session annotation: map, ray evidence, map classes, frame labels, future clouds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rigid import move_points
from ..operators.evidence import classify_map, movable_probabilities, ray_evidence
from ..operators.filters import vertical_normals
from ..operators.neighbors import still_points, transfer_labels
from ..operators.planes import extract_ground, mark_in_plane, ransac_plane
from ..operators.temporal import horizon_windows
from ..operators.voxels import voxel_barycentre, voxel_id
from ..runtime import checkpointed
from ..schema import GROUND, LONG_T, SHORT_T, STILL, UNCERTAIN
from .maps import FRAME, day_map

THETA_DL = math.radians(1.29)
PHI_DL = math.radians(0.1)


def annotate_map(map_points: DataFrame, points: DataFrame, poses: DataFrame, dl: float, min_rays: int = 10,
                 short_threshold: float = 0.7, long_threshold: float = 0.6, theta_dl: float = THETA_DL,
                 phi_dl: float = PHI_DL, margin: float = 0.1, ground_thresh: float = 0.12,
                 ground_remove: float = 0.01, seed: int = 42) -> DataFrame:
    """Classes of a day map (``map_id``, position, normal, ``count`` below 0 for base points)."""
    evidence = ray_evidence(points, poses, map_points, FRAME, theta_dl, phi_dl, dl)
    full = map_points.select("map_id").join(evidence, "map_id", "left").fillna(0, ["count", "prob"])
    probs = movable_probabilities(full, min_rays)
    still = still_points(map_points, margin, p_id="map_id")
    ground = extract_ground(map_points, [], 10.0, ground_thresh, ground_remove, seed, "map_id")
    return classify_map(map_points, probs, still, ground, short_threshold, long_threshold)


def annotate_session(points: DataFrame, poses: DataFrame, base: DataFrame, frame_dl: float, map_dl: float,
                     n_lines: int = 32, **options) -> dict[str, DataFrame]:
    """Day map, its classes, and frame points labelled by their nearest map point.

    The day map is the input of four later stages, so it goes through storage once.
    """
    day = day_map(points, poses, base, frame_dl, map_dl, n_lines)
    day = checkpointed(day.withColumn("map_id", voxel_id()))
    classes = checkpointed(annotate_map(day, points, poses, map_dl, **options))
    world = move_points(points, poses, FRAME)
    labelled = transfer_labels(world.select(*FRAME, F.col("id").alias("pid"), "x", "y", "z")
                               .withColumn("_u", F.struct(*FRAME, "pid")), classes.select("map_id", "x", "y", "z", "classif"),
                               ["classif"], point_id="_u", labelled_id="map_id")
    frame_labels = points.join(labelled.select(*FRAME, F.col("pid").alias("id"), "classif"), [*FRAME, "id"])
    return {"map": day, "map_labels": classes, "frame_labels": frame_labels}


def legacy_classes(map_points: DataFrame, short_prob: DataFrame, other_days: DataFrame, ground: DataFrame,
                   still: DataFrame, short_threshold: float = 0.7, long_threshold: float = 0.6,
                   swap_codes: bool = False, map_id: str = "map_id") -> DataFrame:
    """Older rule set: ground, then short-term, then long-term by the strongest other day, then still.

    ``short_prob`` and ``other_days`` hold one probability per map point
    (0 where too few rays were counted). ``swap_codes`` exchanges classes 3 and 4.
    """
    t = (map_points.join(short_prob.select(map_id, F.col("short_prob").alias("_p")), map_id, "left")
         .join(other_days.select(map_id, F.col("short_prob").alias("_o")), map_id, "left")
         .join(ground.select(map_id).withColumn("_g", F.lit(True)), map_id, "left")
         .join(still.select(map_id).withColumn("_s", F.lit(True)), map_id, "left"))
    short, long = (LONG_T, SHORT_T) if swap_codes else (SHORT_T, LONG_T)
    classif = (F.when(F.col("_g"), GROUND).when(F.col("_p") > short_threshold, short)
               .when(F.col("_o") > long_threshold, long).when(F.col("_s"), STILL).otherwise(UNCERTAIN))
    return t.select(*map_points.columns, classif.cast("int").alias("classif"))


def future_clouds(points: DataFrame, poses: DataFrame, map_points: DataFrame, dl_2d: float, start: float,
                  future: float, ground_thresh: float = 0.15, gap: float = 0.2, seed: int = 42) -> DataFrame:
    """2D+time clouds of annotated frames: ground removed, flattened, thinned, stacked over the horizon."""
    plane = ransac_plane(vertical_normals(map_points, 10.0), [], ground_thresh, seed=seed, p_id="map_id")
    world = move_points(points, poses, FRAME)
    apart = mark_in_plane(world, plane, [], gap, "_near")
    objects = apart.where(~F.col("_near") & (F.col("classif") > 1.5)).drop("_near").withColumn("z", F.lit(0.0))
    flat = voxel_barycentre(objects, dl_2d, FRAME, labels=["classif"]).select(*FRAME, "x", "y", "classif")
    # Windows come from the frame list, so frames without objects still count.
    frames = points.select(*FRAME).distinct()
    windows = horizon_windows(frames, ["session"], "frame_ts", start, future)
    return windows.join(flat, FRAME).select("session", "origin_ts", "x", "y", "t", "classif")
