"""Voxel and pixel aggregation of point tables.

All aggregates are mergeable, so Spark combines them map-side and a voxel that
holds a third of all points costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Vec, XYZ, cell, cells, sq_distance, xyz
from ..functions.hashed import uniform
from ..functions.rigid import Rigid, axis_angle

VOXEL = ["vx", "vy", "vz"]


def voxel_id() -> Column:
    """One number for a voxel, different for different ones: 21 bits of each index. Indices beyond a million either way are an error."""
    half = 1 << 20
    known, packed = F.lit(True), F.lit(0).cast("long")
    for v in VOXEL:
        known = known & F.col(v).between(-half, half - 1)
        packed = F.shiftleft(packed, 21).bitwiseOR(F.col(v) + half)
    return F.when(known, packed).otherwise(F.raise_error(F.lit("a voxel index is too large for an id")).cast("long"))


def spread(df: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """One row per cell within ``reach`` of the row's own cell along every key."""
    for k in keys:
        df = df.withColumn(k, F.explode(F.sequence(F.col(k) - reach, F.col(k) + reach)))
    return df


def majority(df: DataFrame, keys: list[str], label: str, out: str | None = None) -> DataFrame:
    """Most frequent label per key; equal counts go to the lowest label."""
    counted = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.col(label), F.struct(F.col("_n"), -F.col(label)))
    return counted.groupBy(*keys).agg(best.alias(out or label))


def voxel_barycentre(points: DataFrame, dl: float, by: list[str] = (), features: list[str] = (),
                     labels: list[str] = ()) -> DataFrame:
    """Mean position, mean features and majority label per voxel and group.

    With one label column everything fits into a single two-level aggregation
    (per label, then per voxel); further label columns add one join each.
    """
    by, features, labels = list(by), list(features), list(labels)
    keyed = points.withColumns(cells(dl))
    keys = [*by, *VOXEL]
    values = [*XYZ, *features]
    if not labels:
        return keyed.groupBy(*keys).agg(
            *(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))
    first, rest = labels[0], labels[1:]
    inner = keyed.groupBy(*keys, first).agg(
        *(F.sum(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))
    out = inner.groupBy(*keys).agg(
        *((F.sum(v) / F.sum("n")).alias(v) for v in values),
        F.max_by(F.col(first), F.struct(F.col("n"), -F.col(first))).alias(first),
        F.sum("n").alias("n"))
    for label in rest:
        out = out.join(majority(keyed, keys, label), keys)
    return out


def voxel_barycentre_capped(points: DataFrame, dl: float, by: list[str], max_points: int = 0,
                            features: list[str] = (), labels: list[str] = ()) -> DataFrame:
    """Barycentres with at most ``max_points`` voxels per group (0: no limit).

    The voxels kept are the first in (vx, vy, vz) order.
    """
    from .scans import top_k

    out = voxel_barycentre(points, dl, by, features, labels)
    return top_k(out, list(by), VOXEL, max_points).drop("rank") if max_points else out


def voxel_medoid(points: DataFrame, dl: float, by: list[str] = (), id_col: str = "id") -> DataFrame:
    """The input point nearest to the centre of its voxel; ties go to the lowest id."""
    keyed = points.withColumns(cells(dl))
    centre = Vec(*((F.col(v) + 0.5) * dl for v in VOXEL))
    others = [c for c in points.columns if c not in by]
    pick = F.min_by(F.struct(*others), F.struct(sq_distance(xyz(), centre), F.col(id_col)))
    return (keyed.groupBy(*by, *VOXEL).agg(pick.alias("_p"))
            .select(*by, *VOXEL, *(F.col("_p")[c].alias(c) for c in others)))


def sphere_members(points: DataFrame, dl: float) -> DataFrame:
    """Every point once per voxel whose centre lies within 1.5 cells of it."""
    near = spread(points.withColumns(cells(dl)), VOXEL)
    centre = Vec(*((F.col(v) + 0.5) * dl for v in VOXEL))
    return near.where(sq_distance(xyz(), centre) < (1.5 * dl) ** 2)


def holds_own_centroid(dl: float) -> Column:
    keep = F.lit(True)
    for v, a in zip(VOXEL, XYZ):
        keep = keep & (cell(a, dl) == F.col(v))
    return keep


def sphere_barycentre(points: DataFrame, dl: float, by: list[str] = ()) -> DataFrame:
    """Barycentre of overlapping spheres, kept where it falls into its own voxel.

    Copies of a point are merged before the 27-fold spread.
    """
    by = list(by)
    merged = points.groupBy(*by, *XYZ).agg(F.count(F.lit(1)).alias("_w"))
    member = sphere_members(merged, dl)
    sums = member.groupBy(*by, *VOXEL).agg(
        *((F.sum(F.col(a) * F.col("_w")) / F.sum("_w")).alias(a) for a in XYZ),
        F.sum("_w").alias("n"))
    return sums.where(holds_own_centroid(dl))


def turned_voxel_barycentre(points: DataFrame, dl: float, by: list[str], seed: int,
                            features: list[str] = (), labels: list[str] = (), turn: Rigid | None = None) -> DataFrame:
    """Barycentres on a grid turned by a random vertical-free rotation per group, or by a ``turn`` of the caller's."""
    turn = _group_rotation(seed, by) if turn is None else turn
    turned = points.withColumns(turn.rotate(xyz()).columns())
    out = voxel_barycentre(turned, dl, by, features, labels)
    return out.withColumns(turn.unrotate(xyz()).columns())


def _group_rotation(seed: int, by: list[str]):
    u = uniform(seed, F.lit("axis-z"), *by) * 2 - 1
    a = uniform(seed, F.lit("axis-a"), *by) * (2 * 3.141592653589793)
    flat = F.sqrt(1 - u * u)
    axis = Vec(flat * F.cos(a), flat * F.sin(a), u)
    return axis_angle(axis, uniform(seed, F.lit("angle"), *by) * (2 * 3.141592653589793))


def occupied_pixels(points: DataFrame, dl: float, by: list[str] = ()) -> DataFrame:
    """Distinct 2D cells."""
    return points.select(*by, cell("x", dl).alias("px"), cell("y", dl).alias("py")).distinct()


def occupancy_raster(points: DataFrame, dl: float, z_min: float, z_max: float,
                     by: list[str] = ()) -> DataFrame:
    """Dense 0/1 raster over the bounding box of the occupied pixels of each group.

    The dense rows are made by exploding the two index ranges of the group's
    box in two steps (rows, then columns), so no task builds the whole image.
    """
    by = list(by)
    group = by or ["_all"]
    if not by:
        points = points.withColumn("_all", F.lit(0))
    hit = occupied_pixels(points.where(F.col("z").between(z_min, z_max)), dl, group)
    box = hit.groupBy(*group).agg(F.min("px").alias("x0"), F.max("px").alias("x1"),
                                  F.min("py").alias("y0"), F.max("py").alias("y1"))
    rows = box.withColumn("px", F.explode(F.sequence("x0", "x1"))).repartition(*group, "px")
    dense = rows.withColumn("py", F.explode(F.sequence("y0", "y1"))).select(*group, "px", "py")
    marked = dense.join(hit.withColumn("occupied", F.lit(1)), [*group, "px", "py"], "left")
    return marked.fillna(0, ["occupied"]).select(*by, "px", "py", "occupied")


def class_frequency(points: DataFrame, levels: list[str], label: str = "label") -> DataFrame:
    """Count and share of each class at every level of a hierarchy, down to the grand total.

    One aggregation feeds all levels: the finest counts are rolled up.
    """
    fine = points.groupBy(*levels, label).agg(F.count(F.lit(1)).alias("n"))
    keep = [levels[:i] for i in range(len(levels) + 1)]
    out = None
    for level in keep:
        counts = fine.groupBy(*level, label).agg(F.sum("n").alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy(*level)) if level else None
        if share is None:
            # No key: a broadcast one-row total instead of a one-task window.
            total = fine.agg(F.sum("n").alias("_t")).withColumn("_k", F.lit(0))
            counts = (counts.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")
                      .withColumn("share", F.col("n") / F.col("_t")).drop("_k", "_t"))
        else:
            counts = counts.withColumn("share", share)
        missing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in levels if c not in level]
        part = counts.select(*level, *missing, label, "n", "share").select(*levels, label, "n", "share")
        out = part if out is None else out.unionByName(part)
    return out
