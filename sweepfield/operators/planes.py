"""Plane search and plane segmentation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (Plane, Vec, XYZ, cells, clip, in_plane, plane_from_points, xyz)
from ..functions.hashed import shuffle_key
from ..runtime import checkpointed, one_row, small_enough
from .filters import vertical_normals
from .neighbors import proximity
from .scans import top_k
from .selection import group_quantile
from .shape import fit_planes
from .voxels import VOXEL

PLANE = ("a", "b", "c", "d")


# Groups whose planes may be sent to all tasks: about 5 KB each for 100 draws.
FEW_GROUPS = 1 << 10


def _sent(groups: DataFrame) -> DataFrame:
    """``groups``, a stored row a group, broadcast if they are few, so that a few large groups do not become a few tasks."""
    return F.broadcast(groups) if small_enough(groups, FEW_GROUPS) else groups


def ransac_plane(points: DataFrame, by: list[str], threshold: float = 0.1, draws: int = 100,
                 seed: int = 42, p_id: str = "id", min_votes: int = 3) -> DataFrame:
    """Plane with most inliers among ``draws`` random triples, per group.

    Triples come from three hashed points of a sample of 3 * ``draws`` (a fixed
    number) per group; all points vote. The first best draw wins and needs
    more than ``min_votes`` votes. Votes are counted map-side, so the only
    shuffle carries at most ``draws`` rows per group and task, and points are
    not shuffled unless there are very many groups.
    """
    by = list(by)
    key = by or ["_all"]
    if not by:
        points = points.withColumn("_all", F.lit(0))
    order = shuffle_key(seed, *key, p_id)
    sample = top_k(points.select(*key, p_id, *XYZ).withColumn("_h", order), key, ["_h", p_id], 3 * draws)
    pool = sample.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", *XYZ))).alias("_pool"))
    drawn = pool.where(F.size("_pool") >= 3).select(
        *key, "_pool", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    size = F.size("_pool")
    # First point by hash, the other two at distinct hashed steps from it.
    drawn = drawn.withColumns({
        "_i": F.pmod(shuffle_key(seed + 1, *key, "draw"), size).cast("int"),
        "_s1": F.pmod(shuffle_key(seed + 2, *key, "draw"), size - 1).cast("int") + 1,
        "_s2": F.pmod(shuffle_key(seed + 3, *key, "draw"), F.greatest(size - 2, F.lit(1))).cast("int") + 1})
    third = F.col("_s2") + F.when(F.col("_s2") >= F.col("_s1"), 1).otherwise(0)
    picked = drawn.select(*key, "draw", F.get("_pool", F.col("_i")).alias("_p0"),
                          F.get("_pool", (F.col("_i") + F.col("_s1")) % size).alias("_p1"),
                          F.get("_pool", (F.col("_i") + third) % size).alias("_p2"))
    corners = [Vec(*(F.col(p)[a] for a in XYZ)) for p in ("_p0", "_p1", "_p2")]
    planes = picked.select(*key, "draw", *(c.alias(n) for n, c in zip(PLANE, plane_from_points(*corners))))
    # Collinear triples have NULL planes, which get no votes.
    packed = planes.groupBy(*key).agg(F.collect_list(F.struct("draw", *PLANE)).alias("_planes"))

    # Without groups the other side is a single row of at most ``draws`` planes.
    packed = _sent(checkpointed(packed)) if by else F.broadcast(packed)
    voters = points.select(*key, *XYZ).join(packed, key).select(
        *key, *XYZ, F.explode("_planes").alias("_pl"))
    near = in_plane(Plane(*(F.col("_pl")[c] for c in PLANE)), xyz(), threshold)
    votes = voters.where(near).groupBy(*key, F.col("_pl").alias("_pl")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*key).agg(
        F.max_by(F.struct("_pl", "votes"), F.struct(F.col("votes"), -F.col("_pl")["draw"])).alias("_b"))
    out = best.where(F.col("_b")["votes"] > min_votes)
    return out.select(*by, *(F.col("_b")["_pl"][c].alias(c) for c in PLANE), F.col("_b")["votes"].alias("votes"))


def mark_in_plane(points: DataFrame, planes: DataFrame, by: list[str], threshold: float,
                  out: str = "in_plane") -> DataFrame:
    """Flag points near the plane of their group; groups without a plane have none."""
    side = planes.select(*by, *(F.col(c).alias("_" + c) for c in PLANE))
    if by:
        joined = points.join(side, by, "left")
    else:
        # One plane at most, so the other side of the join is a single row.
        joined = points.withColumn("_k", F.lit(0)).join(
            F.broadcast(one_row(side, "plane without a group").withColumn("_k", F.lit(0))), "_k", "left").drop("_k")
    near = in_plane(Plane(*(F.col("_" + c) for c in PLANE)), xyz(), threshold)
    return joined.withColumn(out, F.coalesce(near, F.lit(False))).drop(*("_" + c for c in PLANE))


def extract_ground(points: DataFrame, by: list[str] = (), vertical_deg: float = 10.0,
                   threshold: float = 0.15, remove_dist: float = 0.15, seed: int = 42,
                   p_id: str = "id", draws: int = 100, planes: DataFrame | None = None) -> DataFrame:
    """Ground points: near the best plane of vertical-normal points, away from everything else.

    Points of the plane whose nearest other point is within ``remove_dist`` are
    left out, which cleans the foot of walls and objects.
    """
    by = list(by)
    if planes is None:
        # A row per group that both sides of the proximity join read.
        planes = checkpointed(ransac_plane(vertical_normals(points, vertical_deg), by, threshold, draws, seed, p_id))
        planes = _sent(planes) if by else planes
    marked = mark_in_plane(points, planes, by, threshold)
    flat = marked.where("in_plane").drop("in_plane")
    others = marked.where(~F.col("in_plane"))
    return proximity(flat, others, remove_dist, "far", by, p_id)


def ground_height(points: DataFrame, by: list[str], band: float = 0.05) -> DataFrame:
    """Median z of the points within ``band`` of the lowest one."""
    low = points.groupBy(*by).agg(F.min("z").alias("_z0"))
    near = points.join(low, by).where(F.col("z") < F.col("_z0") + band)
    return group_quantile(near, by, "z", 0.5, "ground_z")


# --- segmentation ------------------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node id of the component of every node that has an edge.

    Each round every root hooks onto its smallest neighbour, chains of hooks
    are shortened by pointer jumping, and the edges are contracted; the graph
    at least halves, so rounds grow with the logarithm of its size.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = checkpointed(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = None
    while not e.isEmpty():
        hook = e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        hook = checkpointed(hook)
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("g"))
            jumped = checkpointed(hook.join(up, "p").select("u", F.col("g").alias("p"), (F.col("p") != F.col("g")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.drop("moved")
            if not moved:
                break
        if label is None:
            label = hook.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = hook.select(F.col("u").alias("component"), F.col("p").alias("_to"))
            label = checkpointed(label.join(step, "component", "left").select(
                "node", F.coalesce("_to", "component").alias("component")))
        pu = hook.select("u", F.col("p").alias("pu"))
        pv = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = checkpointed(e.join(pu, "u").join(pv, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
                         .where("u <> v").distinct())
    if label is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).where(F.lit(False))
    return label


def _smooth_edges(pairs: DataFrame, max_angle: float, max_dist: float) -> DataFrame:
    """Pairs whose normals and mutual plane distances agree (columns with suffix 0 and 1)."""
    p0, p1 = (Vec(*(F.col(a + s) for a in XYZ)) for s in "01")
    n0, n1 = (Vec(*(F.col("n" + a + s) for a in XYZ)) for s in "01")
    gap = p1.minus(p0)
    angle = F.acos(clip(F.abs(n0.dot(n1)), 0.0, 1.0))
    return pairs.where((angle <= max_angle) & (F.abs(gap.dot(n0)) <= max_dist) & (F.abs(gap.dot(n1)) <= max_dist))


def _suffixed(df: DataFrame, keys: list[str], s: str, p_id: str) -> DataFrame:
    cols = [p_id, *XYZ, *("n" + a for a in XYZ)]
    return df.select(*keys, *(F.col(c).alias(c + s) for c in cols))


def voxel_plane_edges(voxels: DataFrame, dl: float, max_angle: float, max_dist: float,
                      p_id: str = "id") -> DataFrame:
    """Adjacent map voxels (26 neighbours, each pair once) that may share a plane."""
    keyed = voxels.withColumns(cells(dl))
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    table = F.array(*(F.struct(*(F.lit(o).alias(n) for n, o in zip(VOXEL, g))) for g in half))
    left = _suffixed(keyed, VOXEL, "0", p_id).withColumn("_o", F.explode(table))
    left = left.withColumns({v: F.col(v) + F.col("_o")[v] for v in VOXEL}).drop("_o")
    pairs = left.join(_suffixed(keyed, VOXEL, "1", p_id), VOXEL)
    return _smooth_edges(pairs, max_angle, max_dist).select(F.col(p_id + "0").alias("a"), F.col(p_id + "1").alias("b"))


def scan_plane_edges(image: DataFrame, by: list[str], max_angle: float, max_dist: float,
                     line: str = "line", column: str = "column", p_id: str = "id") -> DataFrame:
    """Neighbours in the scan image: lines within 1, columns from 5 before to 4 after."""
    keys = [*by, line, column]
    near = [(i, j) for i in (-1, 0, 1) for j in range(-5, 5) if (i, j) != (0, 0)]
    table = F.array(*(F.struct(F.lit(i).alias("l"), F.lit(j).alias("c")) for i, j in near))
    left = _suffixed(image, keys, "0", p_id).withColumn("_o", F.explode(table))
    left = left.withColumns({line: F.col(line) + F.col("_o")["l"], column: F.col(column) + F.col("_o")["c"]}).drop("_o")
    pairs = left.join(_suffixed(image, keys, "1", p_id), keys)
    return _smooth_edges(pairs, max_angle, max_dist).select(F.col(p_id + "0").alias("a"), F.col(p_id + "1").alias("b"))


def plane_segments(points: DataFrame, edges: DataFrame, min_points: int = 10, max_planes: int | None = None,
                   p_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Points with their plane (the smallest member id) and the table of fitted planes.

    A deterministic variant of region growing: regions are the connected
    components of the pairwise-compatible edges, whatever the seed order.
    """
    component = connected_components(edges).select(F.col("node").alias(p_id), F.col("component").alias("plane_id"))
    members = points.join(component, p_id)
    planes = fit_planes(members, ["plane_id"], min_points, max_planes)
    return members.join(planes.select("plane_id"), "plane_id", "left_semi"), planes


def segment_voxels(voxels: DataFrame, dl: float, max_angle: float = math.radians(10), max_dist: float = 0.1,
                   min_points: int = 10, max_planes: int | None = None, p_id: str = "id"):
    return plane_segments(voxels, voxel_plane_edges(voxels, dl, max_angle, max_dist, p_id), min_points,
                          max_planes, p_id)


def segment_scan(image: DataFrame, by: list[str], max_angle: float = math.radians(10), max_dist: float = 0.1,
                 min_points: int = 10, max_planes: int | None = None, p_id: str = "id", **names):
    return plane_segments(image, scan_plane_edges(image, by, max_angle, max_dist, p_id=p_id, **names),
                          min_points, max_planes, p_id)
