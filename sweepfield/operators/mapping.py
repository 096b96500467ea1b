"""Building and merging voxel maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ, cells
from ..runtime import checkpointed
from .scans import prefix_scan, running
from .voxels import VOXEL, holds_own_centroid, sphere_members

NORMAL = ("nx", "ny", "nz")

# --- first-hit map -----------------------------------------------------------


def first_hit_state(points: DataFrame, dl: float, frame: str = "frame_idx", p_id: str = "id") -> DataFrame:
    """Points as single-row map states that :func:`merge_first_hit` can combine."""
    return points.select(
        *(c.alias(n) for n, c in cells(dl).items()), *XYZ,
        F.col(frame).cast("long").alias("frame_idx"), F.col(p_id).alias("id"), *NORMAL, "score",
        F.col(frame).cast("long").alias("normal_frame"), F.col(p_id).alias("normal_id"),
        F.lit(1).cast("long").alias("hits"))


def merge_first_hit(states: DataFrame) -> DataFrame:
    """Voxel map in which the first point fixes position and frame and the best normal wins.

    Every column is a minimum, a maximum or a sum under a total order, so maps
    merge in any grouping: batch, session by session, or micro-batch.
    """
    first = F.struct("frame_idx", "id")
    best = F.struct(-F.col("score"), F.col("normal_frame"), F.col("normal_id"))
    out = states.groupBy(*VOXEL).agg(
        F.min_by(F.struct(*XYZ, "frame_idx", "id"), first).alias("_f"),
        F.min_by(F.struct(*NORMAL, "score", "normal_frame", "normal_id"), best).alias("_n"),
        F.sum("hits").alias("hits"))
    return out.select(*VOXEL, "_f.*", "_n.*", "hits")


def first_hit_map(points: DataFrame, dl: float, frame: str = "frame_idx", p_id: str = "id",
                  base: DataFrame | None = None) -> DataFrame:
    """First-hit map of ``points``; points of ``base`` count as frame -1."""
    states = first_hit_state(points, dl, frame, p_id)
    if base is not None:
        prior = base.withColumn("_frame", F.lit(-1))
        states = states.unionByName(first_hit_state(prior, dl, "_frame", p_id))
    return merge_first_hit(states)


# --- barycentre map ----------------------------------------------------------


def barycentre_map(points: DataFrame, dl: float, base: DataFrame | None = None, frame: str = "frame_idx",
                   p_id: str = "id", min_score: float | None = None) -> DataFrame:
    """Merge new points into a map of sphere barycentres.

    Position: a map point enters its own voxel with its count as weight, a new
    point every voxel whose centre is within 1.5 cells; voxels are kept if some
    point lies in them and their centroid does too. Normals follow
    :func:`merged_normals`. ``min_score`` drops voxels at or below a score.
    """
    spots = points.groupBy(*XYZ).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    parts = sphere_members(spots, dl).select(*VOXEL, *XYZ, "_w")
    if base is not None:
        old = base.withColumns(cells(dl)).select(*VOXEL, *XYZ, F.col("count").cast("double").alias("_w"))
        parts = parts.unionByName(old)
    centroid = parts.groupBy(*VOXEL).agg(
        *((F.sum(F.col(a) * F.col("_w")) / F.sum("_w")).alias(a) for a in XYZ),
        F.sum("_w").cast("long").alias("count")).where(holds_own_centroid(dl))
    normals = merged_normals(points, dl, base, frame, p_id)
    out = centroid.join(normals, VOXEL)
    return out if min_score is None else out.where(F.col("score") > min_score)


def merged_normals(points: DataFrame, dl: float, base: DataFrame | None, frame: str, p_id: str) -> DataFrame:
    """Normal and score of each voxel under the ordered merge rule.

    In (frame, id) order a point better than the current score by more than 0.1
    replaces the normal, one within 0.1 is added with its sign aligned and may
    raise the score, a worse one is ignored. The current score is then always
    the running maximum, so it comes from a prefix scan; the sum after the last
    replacement is a plain aggregate as long as the added normals lie within 45
    degrees of the one that started it (their signs then cannot depend on the
    order). Only voxels where they do not are folded in order.
    """
    new = points.withColumns(cells(dl)).select(
        *VOXEL, F.col(frame).cast("long").alias("_f"), F.col(p_id).alias("_i"),
        *NORMAL, "score")
    if base is not None:
        old = base.withColumns(cells(dl)).withColumn("_k", F.col("count").cast("double")).select(
            *VOXEL, F.lit(-(1 << 60)).cast("long").alias("_f"),
            F.lit(None).cast(new.schema["_i"].dataType).alias("_i"),
            *((F.col(n) * F.col("_k")).alias(n) for n in NORMAL), "score")
        new = new.unionByName(old)
    scanned = prefix_scan(new, VOXEL, ["_f", "_i"], F.col("_f"), {
        "_best": running("max", "score", exclusive=True)})
    current = F.coalesce("_best", F.lit(-1.0))
    starts = F.col("score") > current + 0.1
    active = scanned.where(F.col("score") > current - 0.1)
    active = active.withColumn("_starts", starts)
    row = F.struct("_f", "_i")
    seed = active.groupBy(*VOXEL).agg(
        F.max(F.when(F.col("_starts"), row)).alias("_from"),
        F.max_by(F.struct(*NORMAL), F.when(F.col("_starts"), row)).alias("_seed"),
        F.max("score").alias("_top"))
    tail = active.join(seed, VOXEL).where(F.col("_from").isNull() | (row >= F.col("_from")))
    dot = _dot(lambda n: F.col(n), lambda n: F.col("_seed")[n])
    length = F.sqrt(_dot(lambda n: F.col(n), lambda n: F.col(n))
                    * _dot(lambda n: F.col("_seed")[n], lambda n: F.col("_seed")[n]))
    sign = F.when(dot > 0, 1.0).otherwise(-1.0)
    tail = tail.withColumns({"_sign": sign, "_cone": F.abs(dot) >= 0.70711 * length})
    # Three readers follow; without the cut each would redo the scan and the join.
    tail = checkpointed(tail.select(*VOXEL, "_f", "_i", *NORMAL, "_sign", "_cone", "_from", "_top"))
    summed = tail.groupBy(*VOXEL).agg(
        *(F.sum(F.col(n) * F.col("_sign")).alias(n) for n in NORMAL),
        F.max("_top").alias("score"),
        F.min(F.col("_cone") & F.col("_from").isNotNull()).alias("_plain"))
    plain = summed.where(F.coalesce("_plain", F.lit(False))).drop("_plain")
    odd = summed.where(~F.coalesce("_plain", F.lit(False))).select(*VOXEL, "score")
    folded = _fold_normals(tail.join(odd.select(*VOXEL), VOXEL, "left_semi")).join(odd, VOXEL)
    merged = plain.unionByName(folded.select(*plain.columns))
    size = F.sqrt(_dot(lambda n: F.col(n), lambda n: F.col(n))) + 1e-6
    return merged.withColumn("_s", size).withColumns({n: F.col(n) / F.col("_s") for n in NORMAL}).drop("_s")


def _dot(a, b):
    return sum((a(n) * b(n) for n in NORMAL[1:]), a(NORMAL[0]) * b(NORMAL[0]))


def _fold_normals(rows: DataFrame) -> DataFrame:
    """Sign-aligned sum in order, streamed over sorted rows with one running normal per voxel."""
    ordered = (rows.select(*VOXEL, "_f", "_i", *NORMAL).repartition(*VOXEL)
               .sortWithinPartitions(*VOXEL, "_f", "_i"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            done = []
            for voxel, normal in zip(map(tuple, batch[VOXEL].to_numpy()), batch[list(NORMAL)].to_numpy()):
                if voxel != key:
                    if key is not None:
                        done.append((*key, *total))
                    key, total = voxel, np.zeros(3)
                total = total + normal if total @ normal > 0 or not total.any() else total - normal
            yield pd.DataFrame(done, columns=[*VOXEL, *NORMAL])
        if key is not None:
            yield pd.DataFrame([(*key, *total)], columns=[*VOXEL, *NORMAL])

    return ordered.mapInPandas(fold, "vx long, vy long, vz long, nx double, ny double, nz double")
