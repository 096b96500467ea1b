"""Row filters on point tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Plane, Vec, col, plane_distance, sq_distance, verticality, xyz
from ..functions.hashed import uniform

# Object categories that survive the mapping filter.
MAPPED_CATEGORIES = (0, 1, 2, 3)


def drop_sensor_origin(points: DataFrame, limit: float = 1e-6, mode: str = "drop") -> DataFrame:
    """Remove points within ``limit`` of the sensor axis; ``mode="fail"`` raises on one below it."""
    rho = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    if mode == "fail":
        stop = F.raise_error(F.lit("point on the sensor axis")).cast("double")
        points = points.withColumn("x", F.when(rho < limit, stop).otherwise(F.col("x")))
    return points.where(rho > limit)


def finite(points: DataFrame) -> DataFrame:
    """Rows with three proper coordinates."""
    return points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & F.col("x").isNotNull()
                        & F.col("y").isNotNull() & F.col("z").isNotNull())


def mapped_categories(points: DataFrame, category: str = "category") -> DataFrame:
    return points.where(F.col(category).isin(*MAPPED_CATEGORIES))


def score_above(points: DataFrame, limit: float = 0.1, score: str = "score") -> DataFrame:
    """Keep scores strictly above the limit."""
    return points.where(F.col(score) > limit)


def score_not_below(points: DataFrame, limit: float, score: str = "score") -> DataFrame:
    """Keep scores equal to the limit as well."""
    return points.where(F.col(score) >= limit)


def in_ball(p: Vec, centre: Vec, radius: float) -> Column:
    return sq_distance(p, centre) < F.lit(radius * radius)


def ball_crop(points: DataFrame, centre: tuple[float, float, float], radius: float,
              share: float = 1.0) -> DataFrame:
    """Points strictly inside a ball; ``share`` shrinks it (0.99 for re-projection)."""
    return points.where(in_ball(xyz(), Vec.of(*(F.lit(float(c)) for c in centre)), radius * share))


def height_band(points: DataFrame, low: float, high: float, plane: Plane | None = None) -> DataFrame:
    """Points whose height (or distance to ``plane``) is in [low, high]."""
    height = plane_distance(plane, xyz()) if plane else F.col("z")
    return points.where(height.between(low, high))


def frame_bounds(points: DataFrame, by: list[str], margin: float) -> DataFrame:
    """Axis-aligned box of each frame, widened by ``margin``."""
    return points.groupBy(*by).agg(
        *((F.min(a) - margin).alias("lo_" + a) for a in "xyz"),
        *((F.max(a) + margin).alias("hi_" + a) for a in "xyz"))


def inside_bounds() -> Column:
    keep = F.lit(True)
    for a in "xyz":
        keep = keep & F.col(a).between(F.col("lo_" + a), F.col("hi_" + a))
    return keep


def crop_to_bounds(points: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    names = [f"{s}_{a}" for a in "xyz" for s in ("lo", "hi")]
    return points.join(bounds, by).where(inside_bounds()).drop(*names)


def off_ground(points: DataFrame, plane: Plane, gap: float = 0.2, classif: str = "classif") -> DataFrame:
    """Points clearly off the ground plane whose class is neither uncertain nor ground."""
    return points.where((plane_distance(plane, xyz()) > gap) & (F.col(classif) > 1.5))


def vertical_normals(points: DataFrame, degrees: float = 10.0) -> DataFrame:
    return points.where(verticality("nz") < degrees * math.pi / 180)


def drop_ignored(confusion: DataFrame, ignored: list[int], truth: str = "truth",
                 pred: str = "pred") -> DataFrame:
    """Confusion cells without the rows and columns of ignored labels."""
    out = confusion
    for c in (truth, pred):
        out = out.where(~F.col(c).isin(*ignored))
    return out


def attentive(cells: DataFrame, by: list[str], version: int = 2, seed: int = 42,
              neg_ratio: float = 1.0, gt_sum: str = "gt_sum", pred_sum: str = "pred_sum",
              dilated: str = "dilated_gt", cell_key: tuple[str, ...] = ("t_idx", "px", "py")) -> DataFrame:
    """Cells that count in a masked loss, per group.

    0: all cells; 1: the dilated truth plus random others; 2: positive truth
    plus random others, their share derived from the share of positive cells.
    The draw is a hash of the cell, so it is repeatable.
    """
    if version == 0:
        return cells
    if version == 1:
        sure, positive = F.col(dilated) > 0.01, F.col(gt_sum) > 0.01
    else:
        sure = F.col(gt_sum) > 0.05
        positive = sure | (F.col(pred_sum) > 0.05)
    share = cells.groupBy(*by).agg(F.avg(positive.cast("double")).alias("_p"))
    threshold = F.when(F.col("_p") < 0.99, 1 - F.col("_p") * neg_ratio / (1 - F.col("_p"))).otherwise(0.0)
    draw = uniform(seed, *by, *cell_key)
    keep = sure | (draw > F.least(threshold, F.lit(0.99)))
    return cells.join(share, by).where(keep).drop("_p")


def label_fallback(points: DataFrame, names: tuple[str, ...] = ("category", "cat"),
                   out: str = "label") -> DataFrame:
    """First of the optional label columns that exists; -1 where there is none."""
    present = [F.col(n).cast("int") for n in names if n in points.columns]
    return points.withColumn(out, F.coalesce(*present, F.lit(-1)))


def remap_labels(points: DataFrame, table: DataFrame, label: str = "label", source: str = "label",
                 target: str = "mapped") -> DataFrame:
    """Replace labels through a lookup table; labels that are not in it become -1.

    The lookup is the label dictionary, one row per class; Catalyst broadcasts
    it when its size allows.
    """
    lookup = table.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    return (points.join(lookup, F.col(label) == F.col("_from"), "left")
            .withColumn(label, F.coalesce("_to", F.lit(-1))).drop("_from", "_to"))


def frame_indicators(points: DataFrame, n: int, age: str = "age") -> DataFrame:
    """One column per merged frame: 1 for points of that age."""
    return points.withColumns({f"frame_{k}": (col(age) == k).cast("double") for k in range(n)})
