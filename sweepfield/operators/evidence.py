"""Ray evidence: which map points were seen occupied and which were seen through."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (Vec, XYZ, cell, cells, movable_ramp, polar_ray, polar_wrapped,
                                  still_ramp, xyz)
from ..functions.rigid import MATRIX, Rigid, move_points
from ..schema import GROUND, LONG_T, SHORT_T, STILL, UNCERTAIN
from .filters import inside_bounds
from .voxels import VOXEL, spread

TILE = 8.0
# Polar cells along a side of a sector.
SECTOR = 8


def occupied_hits(points: DataFrame, map_points: DataFrame, frame: list[str], dl: float,
                  map_id: str = "map_id") -> DataFrame:
    """(frame, map point) pairs where a frame point lies in the voxel block around the map point.

    ``points`` are in map coordinates. Frame voxels are made distinct before
    the 27-fold spread. With several map points in a voxel the lowest id stands for it.
    """
    seen = points.select(*frame, *(c.alias(n) for n, c in cells(dl).items())).distinct()
    block = spread(seen, VOXEL).distinct()
    first = (map_points.select(map_id, *(c.alias(n) for n, c in cells(dl).items()))
             .groupBy(*VOXEL).agg(F.min(map_id).alias(map_id)))
    return block.join(first, VOXEL).select(*frame, map_id)


def frame_frustum(points: DataFrame, frame: list[str], theta_dl: float, phi_dl: float,
                  margin: float) -> tuple[DataFrame, DataFrame]:
    """Free range per polar cell of each frame (sensor coordinates), and the grid of each frame."""
    polar = polar_ray(xyz())
    p = points.select(*frame, polar.rho.alias("rho"), polar.theta.alias("theta"), polar.phi.alias("phi"))
    grid = p.groupBy(*frame).agg(
        (F.min("theta") - 0.5 * theta_dl).alias("theta0"), (F.min("phi") - 0.5 * phi_dl).alias("phi0"),
        F.max("theta").alias("theta_max"), F.max("phi").alias("phi_max"), F.max("rho").alias("rho_max"))
    placed = p.join(grid.select(*frame, "theta0", "phi0"), frame)
    r = F.min("rho")
    free = placed.groupBy(*frame, *(c.alias(n) for n, c in _polar_cell(theta_dl, phi_dl).items())).agg(
        (r - F.greatest(F.lit(margin), r * (theta_dl / 2))).alias("free"))
    return free, grid


def _polar_cell(theta_dl: float, phi_dl: float):
    return {"i_theta": F.floor((F.col("theta") - F.col("theta0")) / theta_dl).cast("long"),
            "i_phi": F.floor((F.col("phi") - F.col("phi0")) / phi_dl).cast("long")}


def free_pyramid(free: DataFrame, frame: list[str], width: int = SECTOR, value: str = "free",
                 cells_: tuple[str, str] = ("i_theta", "i_phi")) -> DataFrame:
    """The largest range of a frame (``farthest``) and of its sectors of ``width`` x ``width`` polar cells.

    ``sectors`` lists them row by row, ``wide`` to a row, 0 where no ray went: a
    table of one short row per frame that answers most questions about its
    cells, which are many, without meeting them.
    """
    i, j = (F.floor(F.col(c) / width).cast("int").alias(n) for c, n in zip(cells_, "ij"))
    most = free.select(*frame, i, j, value).groupBy(*frame, "i", "j").agg(F.max(value).alias("far"))
    shape = most.groupBy(*frame).agg(F.max("far").alias("farthest"), (F.max("i") + 1).alias("high"), (F.max("j") + 1).alias("wide"))
    placed = most.join(shape, frame).select(*frame, (F.col("i") * F.col("wide") + F.col("j")).alias("k"), "far")
    holes = shape.select(*frame, F.explode(F.sequence(F.lit(0), F.col("high") * F.col("wide") - 1)).alias("k"), F.lit(0.0).alias("far"))
    dense = placed.unionByName(holes).groupBy(*frame, "k").agg(F.max("far").alias("far"))
    rows = dense.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("k", "far"))).alias("_s"))
    return shape.drop("high").join(rows.select(*frame, F.transform("_s", lambda s: s["far"]).alias("sectors")), frame)


def sector_range(i: Column, j: Column, width: int = SECTOR) -> Column:
    """The largest range of the sector that holds cell (i, j); 0 outside the frame's sectors."""
    row, column = F.floor(i / width).cast("int"), F.floor(j / width).cast("int")
    inside = (row >= 0) & (column >= 0) & (column < F.col("wide"))
    return F.when(inside, F.coalesce(F.get("sectors", row * F.col("wide") + column), F.lit(0.0))).otherwise(0.0)


def tiles_in_reach(table: DataFrame, tile: float, keys: tuple[str, str], low: tuple[Column, Column], high: tuple[Column, Column], reach: Column) -> DataFrame:
    """A row of ``table`` for each ground tile between ``low`` and ``high`` that is within ``reach`` of the sensor (t0, t1)."""
    gap = F.lit(0.0)
    for k, t, lo, hi in zip(keys, ("t0", "t1"), low, high):
        table = table.withColumn(k, F.explode(F.sequence(cell(lo, tile), cell(hi, tile))))
        off = F.greatest(F.col(k) * tile - F.col(t), F.col(t) - (F.col(k) + 1) * tile, F.lit(0.0))
        gap = gap + off * off
    return table.where(gap <= reach * reach * (1 + 1e-9))


def frustum_candidates(points: DataFrame, poses: DataFrame, map_points: DataFrame, frame: list[str],
                       theta_dl: float, phi_dl: float, dl: float, map_id: str = "map_id",
                       tile: float = TILE) -> tuple[DataFrame, DataFrame]:
    """(frame, map point) pairs within a frame's box, ranges and angles, and the free ranges of the frames' polar cells.

    A candidate has its range ``rho``, its polar cell and ``sector_free``, the
    largest free range of the sector around it. Tiles beyond a frame's farthest
    free range are not looked at.
    """
    free, grid = frame_frustum(points, frame, theta_dl, phi_dl, dl)
    placed = move_points(points, poses, frame)
    bounds = placed.groupBy(*frame).agg(
        *((F.min(a) - dl).alias("lo_" + a) for a in XYZ), *((F.max(a) + dl).alias("hi_" + a) for a in XYZ))
    table = bounds.join(grid, frame).join(poses.select(*frame, *MATRIX), frame).join(free_pyramid(free, frame), frame)
    tiles = tiles_in_reach(table, tile, ("tx", "ty"), (F.col("lo_x"), F.col("lo_y")), (F.col("hi_x"), F.col("hi_y")), F.col("farthest"))
    m = map_points.select(map_id, *XYZ, "nx", "ny", "nz", *(cell(a, tile).alias("t" + a) for a in "xy"))
    cand = m.join(tiles, ["tx", "ty"]).where(inside_bounds())
    r = Rigid.named()
    local = r.unapply(xyz()).columns("_x", "_y", "_z") | r.unrotate(Vec.of("nx", "ny", "nz")).columns("_nx", "_ny", "_nz")
    cand = cand.withColumns(local)
    p, n = Vec.of("_x", "_y", "_z"), Vec.of("_nx", "_ny", "_nz")
    polar = polar_ray(p)
    cand = cand.withColumns({"rho": polar.rho, "theta": polar.theta, "phi": polar.phi})
    level = F.abs(F.col("_nz")) > 0.5
    angle = F.acos(F.least(F.abs(F.try_divide(p.dot(n), F.col("rho"))), F.lit(1.0)))
    cand = cand.where(
        (F.col("rho") > 2 * dl) & (F.col("rho") < F.col("rho_max"))
        & F.col("theta").between(F.col("theta0"), F.col("theta_max") + theta_dl)
        & F.col("phi").between(F.col("phi0"), F.col("phi_max") + phi_dl)
        & (level | (angle < 5 * math.pi / 12)))
    at = _polar_cell(theta_dl, phi_dl)
    return cand.select(*frame, map_id, "rho", *(c.alias(k) for k, c in at.items()), sector_range(*at.values()).alias("sector_free")), free


def seen_through(points: DataFrame, poses: DataFrame, map_points: DataFrame, frame: list[str],
                 theta_dl: float, phi_dl: float, dl: float, map_id: str = "map_id",
                 tile: float = TILE) -> DataFrame:
    """(frame, map point) pairs where the frame's rays pass the map point freely.

    Map points meet only the frames whose bounding box touches their tile (an
    equi-join), and need range in (2 dl, free). A coarse-to-fine image of each
    frame's free ranges (frame, sector, cell) drops what lies behind walls:
    only points nearer than the farthest free ray of their sector are shuffled
    by polar cell. Near-horizontal normals seen at a grazing angle do not count.
    """
    cand, free = frustum_candidates(points, poses, map_points, frame, theta_dl, phi_dl, dl, map_id, tile)
    open_ = cand.where(F.col("rho") < F.col("sector_free")).drop("sector_free")
    hit = open_.join(free, [*frame, "i_theta", "i_phi"])
    return hit.where(F.col("rho") < F.col("free")).select(*frame, map_id)


def pruning(points: DataFrame, poses: DataFrame, map_points: DataFrame, frame: list[str],
            theta_dl: float, phi_dl: float, dl: float, map_id: str = "map_id", tile: float = TILE) -> DataFrame:
    """Per frame: map points within its box and angles, those in front of their sector's farthest free ray, and those seen through."""
    cand, free = frustum_candidates(points, poses, map_points, frame, theta_dl, phi_dl, dl, map_id, tile)
    ahead = F.col("rho") < F.col("sector_free")
    both = cand.join(free, [*frame, "i_theta", "i_phi"], "left")
    return both.groupBy(*frame).agg(F.count(F.lit(1)).alias("n_frustum"), F.count_if(ahead).alias("n_sector"),
                                    F.count_if(F.coalesce(F.col("rho") < F.col("free"), F.lit(False))).alias("n_through"))


def ray_evidence(points: DataFrame, poses: DataFrame, map_points: DataFrame, frame: list[str],
                 theta_dl: float, phi_dl: float, dl: float, by: list[str] = (),
                 map_id: str = "map_id", tile: float = TILE) -> DataFrame:
    """Per map point: frames that judged it (``count``) and frames that saw through it (``prob``).

    ``points`` are in sensor coordinates, ``poses`` hold one matrix per frame.
    An occupied sighting overrides a pass of the same frame. ``by`` (a subset of
    ``frame``) keeps the evidence apart, per session for one. Map points that no
    frame judged have no row.
    """
    hits = occupied_hits(move_points(points, poses, frame), map_points, frame, dl, map_id)
    passes = seen_through(points, poses, map_points, frame, theta_dl, phi_dl, dl, map_id, tile)
    both = hits.withColumn("_occ", F.lit(1)).unionByName(passes.withColumn("_occ", F.lit(0)))
    per_frame = both.groupBy(*frame, map_id).agg(F.max("_occ").alias("_occ"))
    return per_frame.groupBy(*by, map_id).agg(
        F.count(F.lit(1)).alias("count"), F.sum(1 - F.col("_occ")).alias("prob"))


# --- probabilities and classes -----------------------------------------------


def movable_probabilities(evidence: DataFrame, min_rays: int = 10, mode: str = "annotate") -> DataFrame:
    """Short-term and long-term probability from the counters.

    ``annotate``: both lowered by 2 below ``min_rays``; ``negative``: -1 where
    nothing was counted; ``zero``: 0 below ``min_rays``.
    """
    ratio = F.col("prob") / (F.col("count") + 1e-6)
    few = F.col("count") < min_rays
    if mode == "annotate":
        short, long = F.when(few, ratio - 2).otherwise(ratio), F.when(few, -1 - ratio).otherwise(1 - ratio)
    elif mode == "negative":
        none = F.col("count") < 1e-6
        short, long = F.when(none, -1.0).otherwise(ratio), F.when(none, -1.0).otherwise(1 - ratio)
    else:
        short, long = F.when(few, 0.0).otherwise(ratio), F.when(few, 0.0).otherwise(1 - ratio)
    return evidence.withColumns({"short_prob": short, "long_prob": long})


def strongest_over_sessions(probabilities: DataFrame, map_id: str = "map_id",
                            values: list[str] = ("short_prob",)) -> DataFrame:
    """Highest probability per map point over all sessions."""
    return probabilities.groupBy(map_id).agg(*(F.max(v).alias(v) for v in values))


def clean_map(map_points: DataFrame, movable: DataFrame, ground: DataFrame, threshold: float = 0.9,
              map_id: str = "map_id", value: str = "short_prob") -> DataFrame:
    """Map without its movable points; ground points always stay."""
    safe = ground.select(map_id).withColumn("_g", F.lit(True))
    joined = map_points.join(movable.select(map_id, value), map_id, "left").join(safe, map_id, "left")
    prob = F.when(F.col("_g"), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
    return joined.where(prob < threshold).select(*map_points.columns)


def classify_map(map_points: DataFrame, probabilities: DataFrame, still: DataFrame, ground: DataFrame,
                 short_threshold: float = 0.7, long_threshold: float = 0.6, map_id: str = "map_id") -> DataFrame:
    """Class of each map point: ground over still over long-term over short-term over uncertain."""
    flags = (map_points.join(probabilities.select(map_id, "short_prob", "long_prob"), map_id, "left")
             .join(still.select(map_id).withColumn("_s", F.lit(True)), map_id, "left")
             .join(ground.select(map_id).withColumn("_g", F.lit(True)), map_id, "left"))
    classif = (F.when(F.col("_g"), GROUND).when(F.col("_s"), STILL)
               .when(F.col("long_prob") > long_threshold, LONG_T)
               .when(F.col("short_prob") > short_threshold, SHORT_T).otherwise(UNCERTAIN))
    return flags.withColumn("classif", classif.cast("int")).select(*map_points.columns, "classif")


def polar_image_evidence(points: DataFrame, poses: DataFrame, map_points: DataFrame, frame: list[str],
                         map_id: str = "map_id", theta_res: float = math.radians(1.29),
                         phi_ratio: float = 0.2, order: str = "id", tile: float = TILE) -> DataFrame:
    """Evidence from a polar image with one range per cell (the last point written stays).

    Map points inside the frame's angular range count if their cell's range
    exceeds 1 and lies at most 0.15 in front of them; the range gap gives the
    movable and still ramps, summed over frames. Only tiles within the frame's
    longest range are looked at (nothing farther can pass the 0.15 test).
    """
    pol = polar_wrapped(xyz())
    p = points.select(*frame, order, pol.rho.alias("rho"), pol.theta.alias("theta"), pol.phi.alias("phi"))
    box = p.groupBy(*frame).agg(*(f(a).alias(f"{a}_{n}") for a in ("theta", "phi")
                                  for n, f in (("lo", F.min), ("hi", F.max))), F.max("rho").alias("rho_max"))
    row, colm = F.floor(F.col("theta") / theta_res), F.floor(F.col("phi") / phi_ratio / theta_res)
    image = p.groupBy(*frame, row.alias("i"), colm.alias("j")).agg(F.max_by("rho", order).alias("range"))
    table = box.join(poses.select(*frame, *MATRIX), frame).join(free_pyramid(image, frame, value="range", cells_=("i", "j")), frame)
    far = F.col("farthest") + 0.15
    t0, t1 = F.col("t0"), F.col("t1")
    tiles = tiles_in_reach(table, tile, ("_x", "_y"), (t0 - far, t1 - far), (t0 + far, t1 + far), far)
    m = map_points.select(map_id, *XYZ, *(cell(a, tile).alias("_" + a) for a in "xy"))
    cand = m.join(tiles, ["_x", "_y"])
    local = polar_wrapped(Rigid.named().unapply(xyz()))
    cand = cand.withColumns({"rho": local.rho, "theta": local.theta, "phi": local.phi}).where(
        (F.col("theta") > F.col("theta_lo")) & (F.col("theta") < F.col("theta_hi"))
        & (F.col("phi") > F.col("phi_lo")) & (F.col("phi") < F.col("phi_hi")))
    # The farthest range of a sector decides most points before they are shuffled by cell.
    cand = cand.where(F.col("rho") < sector_range(row, colm) + 0.15)
    hit = cand.select(*frame, map_id, "rho", row.alias("i"), colm.alias("j")).join(image, [*frame, "i", "j"])
    gap = F.col("range") - F.col("rho")
    hit = hit.withColumn("gap", gap).where((F.col("range") > 1.0) & (F.col("gap") > -0.15))
    return hit.groupBy(map_id).agg(F.sum(movable_ramp("gap")).alias("movable"),
                                   F.sum(still_ramp("gap")).alias("still"), F.count(F.lit(1)).alias("count"))
