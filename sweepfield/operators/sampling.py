"""Ordering, sampling, packing and augmentation with repeatable randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, XYZ, xyz
from ..functions.hashed import gaussian, shuffle_key, uniform, uniform_between
from ..functions.rigid import axis_angle
from ..runtime import checkpointed
from .scans import greedy_chain, numbered, prefix_scan, running, top_k
from .selection import lowest, lowest_of_groups
from .temporal import asof_bracket


def time_order(frames: DataFrame, by: list[str], t: str, tie: list[str] = ()) -> DataFrame:
    return frames.orderBy(*by, t, *tie)


def lowest_potential(items: DataFrame, k: int, potential: str = "potential", item: str = "id") -> DataFrame:
    """The ``k`` items of lowest potential, equal ones by lowest id; in no order."""
    return lowest(items, k, F.col(potential), [item])


def raise_potential(items: DataFrame, chosen: DataFrame, seed: int, potential: str = "potential",
                    item: str = "id") -> DataFrame:
    """Chosen items move up to the next integer plus a draw from (0.1, 0.2)."""
    mark = chosen.select(item).withColumn("_c", F.lit(True))
    new = F.ceil(potential) + uniform_between(0.1, 0.2, seed, item)
    return (items.join(mark, item, "left")
            .withColumn(potential, F.when(F.col("_c"), new).otherwise(F.col(potential))).drop("_c"))


def balanced_lowest(items: DataFrame, n: int, classes: int, label: str = "label", potential: str = "potential",
                    item: str = "id") -> DataFrame:
    """n // classes + 1 items of lowest potential from every class."""
    return top_k(items, [label], [potential, item], n // classes + 1)


def shuffled(items: DataFrame, seed: int, item: str = "id", key: Column | None = None) -> DataFrame:
    """Items in an order drawn by hash, or in that of a ``key`` of the caller's."""
    return items.orderBy(shuffle_key(seed, item) if key is None else key, item)


def balanced_epoch(items: DataFrame, n: int, classes: int, seed: int, label: str = "label",
                   potential: str = "potential", item: str = "id", key: Column | None = None) -> DataFrame:
    """Class-balanced choice, cut to the first ``n`` of an order drawn by hash (or that of a numeric ``key``), in that order.

    Both cuts are made by value, so no task holds the items of a class or the epoch.
    """
    draw = shuffle_key(seed, item) if key is None else key
    chosen = lowest_of_groups(items, label, n // classes + 1, potential, item)
    return lowest(chosen, n, draw, [draw, item]).orderBy(draw, item)


def sample_to_cap(points: DataFrame, by: list[str], cap: int, seed: int, item: str = "id") -> DataFrame:
    """At most ``cap`` points per group, drawn without replacement."""
    keyed = points.withColumn("_h", shuffle_key(seed, *by, item))
    return top_k(keyed, by, ["_h", item], cap).drop("_h", "rank")


def weighted_sample(points: DataFrame, by: list[str], n: int, weight: str, seed: int, item: str = "id") -> DataFrame:
    """Weighted draw without replacement (exponential keys)."""
    keyed = points.where(F.col(weight) > 0).withColumn("_h", F.log(uniform(seed, *by, item)) / F.col(weight))
    return top_k(keyed, by, [F.desc("_h"), item], n).drop("_h", "rank")


def every_nth(frames: DataFrame, by: list[str], order: str, step: int, chunk: Column) -> DataFrame:
    """Rows 0, step, 2 step, ... of each key."""
    return numbered(frames, by, [order], chunk).where(F.pmod(F.col("rn") - 1, F.lit(step)) == 0).drop("rn")


def repeat_rows(items: DataFrame, times: int) -> DataFrame:
    return items.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def best_and_worst(rows: DataFrame, by: list[str], metric: str, k: int, item: str = "id") -> DataFrame:
    """The k highest and k lowest rows per group with ``side`` and ``rank``."""
    best = top_k(rows, by, [F.desc(metric), item], k).withColumn("side", F.lit("best"))
    worst = top_k(rows, by, [metric, item], k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def top_activations(rows: DataFrame, feature: str, label: str, value: str, k: int, item: str = "id") -> DataFrame:
    """Best ``k`` rows per feature with at most one (the best) row per class."""
    best = rows.groupBy(feature, label).agg(
        F.max_by(F.struct(item, value), F.struct(F.col(value), -F.col(item))).alias("_b"))
    flat = best.select(feature, label, "_b.*")
    return top_k(flat, [feature], [F.desc(value), item], k)


def pack_batches(items: DataFrame, shard: list[str], order: str, size: str, limit: float, chunk: float | None = None,
                 rows: int = 1 << 16) -> DataFrame:
    """Batch numbers from 0 for items taken in order; a batch closes when its total exceeds ``limit``.

    The item that overflows stays in its batch. Sizes must not be negative or
    null. A batch that starts at an item ends at the first item whose running
    sum exceeds the sum before the start by more than ``limit``, which an as-of
    lookup on the running sum finds for all items at once; the starts are then
    the chain of jumps from the first item. ``chunk`` is the stretch of the
    running sum that one task looks up, ``rows`` that of the items whose jumps it follows.
    """
    block = F.floor(F.col(order) / 65536).cast("long")
    # Read by the lookup, from both sides, and by the last scan.
    summed = checkpointed(prefix_scan(items, shard, [order], block, {"_rn": running("sum", F.lit(1).cast("long")), "_run": running("sum", F.col(size).cast("double"))}))
    probe = summed.select(*shard, "_rn", (F.col("_run") - F.col(size).cast("double") + F.lit(float(limit))).alias("_probe"))
    found = asof_bracket(probe, summed.select(*shard, F.col("_run").alias("_sum"), F.col("_rn").alias("_end")), shard, "_probe", "_sum", ["_end"],
                         chunk or 1024.0 * max(float(limit), 1.0), how="any")
    starts = greedy_chain(found.select(*shard, F.col("_rn").alias("pos"), (F.col("_end1") + 1).alias("nxt")), shard, block=rows)
    marked = summed.join(starts.select(*shard, F.col("pos").alias("_rn"), F.lit(1).cast("long").alias("_first")), [*shard, "_rn"], "left")
    # Items of equal order are taken in the order of their numbers here too.
    return (prefix_scan(marked, shard, [order, "_rn"], block, {"_batch": running("sum", "_first")})
            .select(*items.columns, (F.col("_batch") - 1).alias("batch")))


# --- augmentation ------------------------------------------------------------


def augmentation_parameters(groups: DataFrame, by: list[str], seed: int, rotation: str = "vertical",
                            scale: tuple[float, float] = (0.9, 1.1), anisotropic: bool = True,
                            symmetries: tuple[bool, bool, bool] = (True, False, False)) -> DataFrame:
    """One row of rotation matrix and scales per group, from hashes of the group key."""
    angle = uniform(seed, F.lit("angle"), *by) * (2 * math.pi)
    zero, one = F.lit(0.0), F.lit(1.0)
    if rotation == "vertical":
        r = axis_angle(Vec(zero, zero, one), angle)
    elif rotation == "all":
        u = uniform(seed, F.lit("height"), *by) * 2 - 1
        a = uniform(seed, F.lit("turn"), *by) * (2 * math.pi)
        flat = F.sqrt(1 - u * u)
        r = axis_angle(Vec(flat * F.cos(a), flat * F.sin(a), u), angle)
    else:
        r = axis_angle(Vec(zero, zero, one), zero)
    cols = {n: c for n, c in r.columns().items() if n[0] == "r"}
    for i, axis in enumerate(XYZ):
        s = uniform_between(*scale, seed, F.lit("scale" + (axis if anisotropic else "")), *by)
        if symmetries[i]:
            s = s * F.when(uniform(seed, F.lit("flip" + axis), *by) < 0.5, -1.0).otherwise(1.0)
        cols["s" + axis] = s
    return groups.select(*by).distinct().select(*by, *(c.alias(n) for n, c in cols.items()))


def augment(points: DataFrame, parameters: DataFrame, by: list[str], seed: int, noise: float = 0.001,
            item: str = "id", normals: bool = False) -> DataFrame:
    """Rotate, scale, mirror and jitter the points of each group; normals follow the surface."""
    names = [c for c in parameters.columns if c not in by]
    joined = points.join(parameters, by)
    m = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    turn = lambda v: Vec(*(v.x * m[0][j] + v.y * m[1][j] + v.z * m[2][j] for j in range(3)))
    s = Vec.of("sx", "sy", "sz")
    p = turn(xyz())
    moved = {a: p[i] * s[i] + gaussian(seed, F.lit("noise" + a), *by, item) * noise for i, a in enumerate(XYZ)}
    if normals:
        n = turn(Vec.of("nx", "ny", "nz"))
        n = Vec(n.x * s.y * s.z, n.y * s.z * s.x, n.z * s.x * s.y)
        moved |= {"n" + a: n[i] / (n.norm() + 1e-6) for i, a in enumerate(XYZ)}
    return joined.withColumns(moved).drop(*names)


def rotate_groups(points: DataFrame, by: list[str], seed: int, mode: str = "vertical") -> DataFrame:
    """Random rotation per group: vertical, any axis, or a random angle about a random axis."""
    par = augmentation_parameters(points, by, seed, mode, (1.0, 1.0), False, (False, False, False))
    return augment(points, par, by, seed, 0.0)
