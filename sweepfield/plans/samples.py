"""Training samples: merged frames, thinned, capped, with neighbour pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, xyz
from ..operators.filters import frame_indicators
from ..operators.neighbors import nearest_join, radius_neighbours
from ..operators.sampling import augment, augmentation_parameters, sample_to_cap
from ..operators.temporal import merge_last_frames
from ..operators.voxels import voxel_barycentre, voxel_id
from ..runtime import checkpointed


def pyramid(points: DataFrame, by: list[str], dl: float, conv_radius: float = 2.5, layers: int = 3,
            limits: list[int] | None = None, upsample: bool = True) -> list[dict[str, DataFrame]]:
    """Per layer: points, neighbours within r, pooling pairs to the next layer, and upsampling pairs.

    r starts at ``dl * conv_radius`` and doubles; the next layer is the voxel
    barycentre at 2 r / conv_radius. All as long tables of ids and ranks.
    """
    out, current, r = [], points.select(*by, F.col("id").cast("long").alias("id"), "x", "y", "z"), dl * conv_radius
    for layer in range(layers):
        limit = limits[layer] if limits else None
        q, s = current.withColumnRenamed("id", "q_id"), current.withColumnRenamed("id", "s_id")
        step = {"points": current, "neighbours": radius_neighbours(q, s, r, by, limit=limit)}
        if layer < layers - 1:
            coarse = voxel_barycentre(current, 2 * r / conv_radius, by)
            coarse = coarse.select(*by, voxel_id().alias("id"), "x", "y", "z")
            cq, cs = coarse.withColumnRenamed("id", "q_id"), coarse.withColumnRenamed("id", "s_id")
            step["pools"] = radius_neighbours(cq, s, r, by, limit=limit)
            if upsample:
                step["upsamples"] = radius_neighbours(q, cs, 2 * r, by, limit=1)
            current = coarse
        out.append(step)
        r *= 2
    return out


def assemble_samples(points: DataFrame, centres: DataFrame, n_frames: int, radius: float, dl: float, cap: int,
                     seed: int, noise: float = 0.001) -> dict[str, DataFrame]:
    """One sample per frame: the last n frames in a ball, thinned, capped and augmented.

    ``points`` are in world coordinates with ``session, frame_ts, id, label``;
    ``centres`` give ``cx, cy, cz`` per ``session, newest_ts``. Returns the
    samples, and for every raw point of the newest frame (within 0.99 of the
    radius) its nearest sample point for re-projection.
    """
    key = ["session", "newest_ts"]
    merged = merge_last_frames(points, ["session"], "frame_ts", n_frames, facts=centres)
    rel = xyz().minus(Vec.of("cx", "cy", "cz"))
    centred = merged.withColumns(rel.columns()).drop("cx", "cy", "cz")
    ball = centred.where(xyz().sq_norm() < radius * radius)
    thin = voxel_barycentre(ball.withColumn("age", F.col("age").cast("int")), dl, key, labels=["label", "age"])
    thin = thin.withColumn("id", voxel_id()).select(*key, "id", "x", "y", "z", "label", "age")
    # The samples, their parameters and the projection all read it.
    capped = checkpointed(sample_to_cap(thin, key, cap, seed))
    raw = centred.where((F.col("age") == 0) & (xyz().sq_norm() < (0.99 * radius) ** 2))
    raw = raw.select(*key, F.col("id").alias("raw_id"), "x", "y", "z", F.col("label").alias("raw_label"))
    projected = nearest_join(raw, capped, key, "raw_id", "id")
    parameters = augmentation_parameters(capped, key, seed)
    return {"samples": frame_indicators(augment(capped, parameters, key, seed, noise), n_frames),
            "parameters": parameters, "reprojection": projected}
