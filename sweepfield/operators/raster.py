"""2D rasters over time: visibility, future occupancy, errors, diffusion, maxima."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import (Plane, cell, lift_positive, logit_cross_entropy, plane_distance, sigmoid,
                                  soft_hysteresis, xyz)
from ..runtime import checkpointed
from ..schema import LONG_T, SHORT_T, STILL
from .neighbors import grid_node_pairs, grid_side
from .scans import prefix_scan, running
from .shape import convolve

# --- visibility around a centre ----------------------------------------------

HALF_DEGREE = 0.5 * math.pi / 180


def _band(points: DataFrame, low: float, high: float, ground: Plane | None) -> DataFrame:
    height = plane_distance(ground, xyz()) if ground else F.col("z")
    return points.where(height.between(low, high))


def _angle_bin(dx, dy, res: float, n: int):
    # atan2 reaches +pi, which belongs to the last bin.
    return F.least(F.floor((F.atan2(dy, dx) + F.lit(math.pi)) / F.lit(res)).cast("int"), F.lit(n - 1))


def visibility_ranges(points: DataFrame, by: list[str], low: float, high: float,
                      centre: tuple[str, str] = ("cx", "cy"), res: float = HALF_DEGREE,
                      fill: str = "linear", ground: Plane | None = None) -> DataFrame:
    """Smallest horizontal range per angle bin around each group's centre, gaps filled around the circle.

    ``fill="next"`` copies the next valid bin instead of interpolating. The
    filling works on the few hundred bins of a group, never on its points.
    """
    n = int(math.floor(2 * math.pi / res)) + 1
    dx, dy = F.col("x") - F.col(centre[0]), F.col("y") - F.col(centre[1])
    hit = _band(points, low, high, ground).select(
        *by, _angle_bin(dx, dy, res, n).alias("bin"), F.sqrt(dx * dx + dy * dy).alias("r"))
    bins = hit.where("r > 0").groupBy(*by, "bin").agg(F.min("r").alias("r"))
    dense = (bins.select(*by).distinct()
             .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(bins, [*by, "bin"], "left"))
    known = F.when(F.col("r").isNotNull(), F.struct("bin", "r"))
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    framed = dense.withColumns({
        "_p": F.last(known, True).over(up), "_n": F.last(known, True).over(down),
        "_first": F.min(known).over(whole), "_last": F.max(known).over(whole)})
    framed = framed.withColumns({
        "_pb": F.coalesce(F.col("_p")["bin"], F.col("_last")["bin"] - n), "_pr": F.coalesce(F.col("_p")["r"], F.col("_last")["r"]),
        "_nb": F.coalesce(F.col("_n")["bin"], F.col("_first")["bin"] + n), "_nr": F.coalesce(F.col("_n")["r"], F.col("_first")["r"])})
    share = F.try_divide(F.col("bin") - F.col("_pb"), F.col("_nb") - F.col("_pb"))
    filled = F.col("_nr") if fill == "next" else (1 - share) * F.col("_pr") + share * F.col("_nr")
    return framed.select(*by, "bin", F.coalesce("r", filled).alias("range"), F.col("r").isNotNull().alias("seen"))


def grid_visibility(points: DataFrame, by: list[str], dl: float, low: float, high: float,
                    centre: tuple[str, str] = ("cx", "cy"), res: float = HALF_DEGREE,
                    ground: Plane | None = None) -> DataFrame:
    """Share of the rays in a pixel's angle bin that reach past the pixel, over the group's bounding box.

    Rays and pixels of a bin are ordered by distance together and the rays
    beyond each pixel are counted by a running sum, so no ray-pixel pairs arise.
    Pixels without rays in their bin score 0.
    """
    n = int(math.floor(2 * math.pi / res)) + 1
    box = points.groupBy(*by).agg(*(F.first(c).alias(c) for c in centre),
                                  *(f(cell(a, dl)).alias(f"{k}{a}") for a in "xy" for k, f in (("lo", F.min), ("hi", F.max))))
    rows = box.withColumn("px", F.explode(F.sequence("lox", "hix"))).repartition(*by, "px")
    pixels = rows.withColumn("py", F.explode(F.sequence("loy", "hiy")))
    pdx, pdy = (F.col("px") + 0.5) * dl - F.col(centre[0]), (F.col("py") + 0.5) * dl - F.col(centre[1])
    pixels = pixels.select(*by, "px", "py", _angle_bin(pdx, pdy, res, n).alias("bin"),
                           (pdx * pdx + pdy * pdy).alias("d2"), F.lit(1).alias("_pix"))
    dx, dy = F.col("x") - F.col(centre[0]), F.col("y") - F.col(centre[1])
    rays = _band(points, low, high, ground).select(
        *by, _angle_bin(dx, dy, res, n).alias("bin"), (dx * dx + dy * dy).alias("d2"), F.lit(0).alias("_pix"))
    both = pixels.unionByName(rays, allowMissingColumns=True)
    # Going inwards, a pixel (flag 1) comes before the rays of exactly its distance.
    chunk = F.floor(F.sqrt("d2") / (8 * dl)).cast("long")
    keys = [*by, "bin"]
    counted = prefix_scan(both, keys, ["d2", "_pix"], chunk, {
        "_beyond": running("sum", 1 - F.col("_pix"), reverse=True)}).where("_pix = 1")
    totals = rays.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    scored = counted.join(totals, keys, "left")
    return scored.select(*by, "px", "py", F.coalesce(F.col("_beyond") / F.col("_all"), F.lit(0.0)).alias("score"),
                         F.coalesce("_all", F.lit(0).cast("long")).alias("rays"))


# --- future occupancy --------------------------------------------------------


def layer_times(n_frames: int, horizon: float, n_layers: int) -> list[float]:
    dt = horizon / n_layers
    count = math.ceil((horizon + 0.5 * dt + (n_frames - 1) * dt) / dt - 1e-9)
    return [-(n_frames - 1) * dt + k * dt for k in range(count)]


def future_occupancy(cloud: DataFrame, by: list[str], n_frames: int, horizon: float, n_layers: int,
                     half_width: float, dl: float, codes: tuple[int, int, int] = (STILL, LONG_T, SHORT_T)) -> DataFrame:
    """Occupancy per time layer and grid node from a 2D+time cloud centred on its group.

    A layer takes points within dt/4 of its time, or up to five times that if
    it would be empty. Still and long-term counts are summed over all layers
    and divided by ``n_layers + n_frames``; short-term counts are clipped to 10
    and divided by 10. Classes whose maximum exceeds 1 are scaled to it, and
    positive values are mapped onto [0.5, 1]. Nodes that no point touches have
    no rows; every other node has a row for each layer.
    """
    times = layer_times(n_frames, horizon, n_layers)
    dt = horizon / n_layers
    half = dt / 2
    k0 = F.floor((F.col("t") - times[0] - 2.5 * half) / dt).cast("int")
    k1 = F.ceil((F.col("t") - times[0] + 2.5 * half) / dt).cast("int")
    near = cloud.withColumn("t_idx", F.explode(F.sequence(k0, k1))).where(F.col("t_idx").between(0, len(times) - 1))
    off = F.abs(F.col("t") - (F.col("t_idx") * dt + times[0]))
    # Smallest e in 1..5 with off < half * e / 2.
    widen = F.when(off < half * 2.5, F.greatest(F.floor(off / (half / 2)).cast("int") + 1, F.lit(1)))
    near = near.withColumn("_e", widen).where(F.col("_e").isNotNull())
    layer = near.groupBy(*by, "t_idx").agg(F.min("_e").alias("_e"))
    chosen = near.join(layer, [*by, "t_idx", "_e"])
    names = ("still", "long_t", "short_t")
    pairs = grid_node_pairs(chosen, half_width, dl, [*by, "t_idx"], ["classif"])
    counts = pairs.groupBy(*by, "t_idx", "px", "py").agg(
        *(F.sum((F.col("classif") == c).cast("double")).alias(n) for n, c in zip(names, codes)))
    node = [*by, "px", "py"]
    fixed = counts.groupBy(*node).agg(*((F.sum(n) / (n_layers + n_frames)).alias(n) for n in names[:2]))
    moving = counts.select(*node, "t_idx", (F.least("short_t", F.lit(10.0)) / 10).alias("short_t"))
    grid = fixed.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(len(times) - 1))))
    out = grid.join(moving, [*node, "t_idx"], "left").fillna(0.0, ["short_t"])
    top = fixed.groupBy(*by).agg(*(F.max(n).alias("_top_" + n) for n in names[:2]))
    out = out.join(top, by)
    scaled = {n: F.when(F.col("_top_" + n) > 1.0, F.col(n) / (F.col("_top_" + n) + 1e-9)).otherwise(F.col(n))
              for n in names[:2]}
    out = out.withColumns(scaled)
    return out.select(*by, "t_idx", "px", "py", *(lift_positive(n).alias(n) for n in names))


def merged_target(grid: DataFrame, by: list[str], reference: int = 0) -> DataFrame:
    """Short-term channel at its maximum over time, the other channels at one layer."""
    at = F.col("t_idx") == reference
    return grid.groupBy(*by, "px", "py").agg(
        F.max(F.when(at, F.col("still"))).alias("still"), F.max(F.when(at, F.col("long_t"))).alias("long_t"),
        F.max("short_t").alias("short_t"))


# --- prediction errors -------------------------------------------------------


def grid_nodes(half_width: float, dl: float) -> int:
    """How many nodes a square grid has, touched or not."""
    return grid_side(half_width, dl) ** 2


def grid_means(grid: DataFrame, by: list[str], channels: list[str], nodes: int) -> DataFrame:
    """Mean of each channel over all ``nodes`` of a group's grid, of which ``grid`` holds those that are not zero."""
    return grid.groupBy(*by).agg(*((F.sum(c) / nodes).alias(c) for c in channels), F.count(F.lit(1)).alias("touched"))


def aligned_grids(pred: DataFrame, truth: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Cells that either of two sparse grids has, as ``cell_errors`` wants them; a value that is absent is 0."""
    p = pred.select(*keys, *(F.col(c).alias("p_" + c) for c in channels))
    g = truth.select(*keys, *(F.col(c).alias("g_" + c) for c in channels))
    return p.join(g, keys, "full").fillna(0.0, [w + c for w in ("p_", "g_") for c in channels])


def cell_errors(cells: DataFrame, by: list[str], channels: list[str], logits: bool = True,
                error: str = "linear", nodes: int | None = None) -> DataFrame:
    """Mean error per time layer and channel: over all cells, over predicted and over true ones.

    ``cells`` has one row per cell with ``p_<channel>`` and ``g_<channel>``.
    ``fp`` averages where the predictions sum to more than 0.1, ``fn`` where
    the truth sums to more than 0.01. All are in percent.

    ``nodes`` says how many cells the grid of each group has: those without a
    row count with ``p`` and ``g`` of 0, as if they were there. A probability of
    0 has no logit, so cross entropy then wants logits.
    """
    if nodes is not None and error == "bce" and not logits:
        raise ValueError("cross entropy over untouched cells needs logits")

    def read(column) -> tuple[dict[str, Column], dict[str, Column], Column, Column]:
        """Predictions, errors and the two masks of a cell whose values ``column(name)`` gives."""
        raw = {c: column("p_" + c) for c in channels}
        g = {c: column("g_" + c) for c in channels}
        p = {c: sigmoid(v) if logits else v for c, v in raw.items()}
        if error == "bce":
            e = {c: logit_cross_entropy(raw[c] if logits else F.log(raw[c] / (1 - raw[c])), g[c]) for c in channels}
        else:
            e = {c: F.abs(p[c] - g[c]) for c in channels}
        p_sum, g_sum = (sum((v[c] for c in channels[1:]), v[channels[0]]) for v in (p, g))
        return p, e, (p_sum > 0.1).cast("double"), (g_sum > 0.01).cast("double")

    _, e, fp, fn = read(F.col)
    _, e0, fp0, fn0 = read(lambda name: F.lit(0.0))
    holes = F.lit(0) if nodes is None else F.lit(nodes) - F.count(F.lit(1))
    masked = cells.withColumns({"_fp": fp, "_fn": fn})
    aggs = []
    for c in channels:
        aggs.append((100 * (F.sum(e[c]) + holes * e0[c]) / (F.count(F.lit(1)) + holes)).alias(c + "_all"))
        for name, mask, mask0 in (("fp", "_fp", fp0), ("fn", "_fn", fn0)):
            total = F.sum(e[c] * F.col(mask)) + holes * mask0 * e0[c]
            aggs.append((100 * total / (F.sum(mask) + holes * mask0 + 1e-9)).alias(f"{c}_{name}"))
    return masked.groupBy(*by).agg(*aggs)


# --- risk diffusion and maxima -----------------------------------------------


def _disc(radius: float, dl: float, power: float) -> list[tuple[tuple[int, int], float]]:
    k = math.ceil(radius / dl)
    out = []
    for i in range(-k, k + 1):
        for j in range(-k, k + 1):
            w = max(0.0, 1.0 - math.hypot(i, j) * dl / radius) ** power
            if w > 0:
                out.append(((i, j), w))
    return out


def diffuse_risk(grid: DataFrame, by: list[str], dl: float, radius: float = 1.5, power: float = 3.0,
                 n_px: int | None = None) -> DataFrame:
    """Risk spread around occupied cells.

    ``grid`` has ``t_idx, px, py, still, long_t, short_t``. The static risk of
    the first layer is spread, divided by its own spread and spread again; the
    moving risk is spread per layer. The ``power``-th roots are scaled to a
    maximum of 1 per group and the larger of the two is kept. ``n_px`` clips
    the result to a square image.
    """
    offsets = _disc(radius, dl, power)
    # Four readers: the static layer, the moving layers, the layer list, the totals.
    grid = checkpointed(grid)
    calm = grid.withColumns({c: soft_hysteresis(c) for c in ("still", "long_t", "short_t")})
    static = calm.where("t_idx = 0").select(*by, "px", "py", F.greatest("still", "long_t").alias("v")).where("v > 0")
    axes = ["px", "py"]

    def clipped(df: DataFrame) -> DataFrame:
        return df if n_px is None else df.where(F.col("px").between(0, n_px - 1) & F.col("py").between(0, n_px - 1))

    once = convolve(static, by, axes, ["v"], offsets)
    ratio = static.join(once.withColumnRenamed("v", "_o"), [*by, *axes]).select(
        *by, *axes, (F.col("v") / (F.col("_o") + 1e-6)).alias("v"))
    still = clipped(convolve(ratio, by, axes, ["v"], offsets)).withColumn("s", F.pow("v", F.lit(1 / power))).drop("v")
    moving = calm.select(*by, "t_idx", *axes, F.col("short_t").alias("v")).where("v > 0")
    moved = clipped(convolve(moving, [*by, "t_idx"], axes, ["v"], offsets)).withColumn("m", F.pow("v", F.lit(1 / power))).drop("v")
    layers = grid.select(*by, "t_idx").distinct()
    tops = (still.groupBy(*by).agg(F.max("s").alias("_s")).join(
        moved.groupBy(*by).agg(F.max("m").alias("_m")), by, "full"))
    base = still.join(layers, by)
    out = base.join(moved, [*by, "t_idx", *axes], "full").join(tops, by)
    s = F.coalesce(F.col("s") / F.col("_s"), F.lit(0.0))
    m = F.coalesce(F.col("m") / F.col("_m"), F.lit(0.0))
    return out.select(*by, "t_idx", *axes, F.greatest(s, m).alias("risk"))


def local_maxima(grid: DataFrame, by: list[str], value: str, size: int = 5, threshold: float = 0.1,
                 smooth: float = -1) -> DataFrame:
    """Cells equal to the maximum of their size x size block if the block spans more than ``threshold``.

    ``grid`` is dense: a missing neighbour is taken to be outside the image.
    ``smooth`` > 0 blurs the values with a 2D Gaussian of that many thirds first.
    """
    axes = ["px", "py"]
    half = size // 2
    cells = grid.select(*by, *axes, F.col(value).alias("v"))
    if smooth > 0:
        cells = _blur(cells, by, axes, smooth / 3, int(smooth * smooth / 3 + 0.5))
    near = cells.withColumns({"_x": F.col("px"), "_y": F.col("py")})
    for a in axes:
        near = near.withColumn(a, F.explode(F.sequence(F.col(a) - half, F.col(a) + half)))
    block = near.groupBy(*by, *axes).agg(F.max("v").alias("_hi"), F.min("v").alias("_lo"))
    return (cells.join(block, [*by, *axes])
            .where((F.col("v") == F.col("_hi")) & (F.col("_hi") - F.col("_lo") > threshold))
            .select(*by, *axes, F.col("v").alias(value)))


def _blur(cells: DataFrame, by: list[str], axes: list[str], sigma: float, reach: int) -> DataFrame:
    raw = {(i, j): math.exp(-(i * i + j * j) / (2 * sigma * sigma))
           for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}
    total = sum(raw.values())
    blurred = convolve(cells, by, axes, ["v"], [(k, w / total) for k, w in raw.items()])
    return cells.select(*by, *axes).join(blurred, [*by, *axes])
