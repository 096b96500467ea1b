"""Local shape from second moments: normals, frames, planes, registration residuals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (Vec, XYZ, cell, eigen_ratios, face_sensor, polar_ray, squeeze_phi,
                                  unsigned_normal_error, xyz)
from ..functions.linalg import covariance, eigh3, mean, moment_sums, solve6
from ..runtime import checkpointed
from .neighbors import nearest_join, radius_pairs
from .temporal import scan_line_outliers

EIGENVALUES = ("l0", "l1", "l2")


def local_pca(points: DataFrame, by: list[str], min_points: int = 1) -> DataFrame:
    """Mean, covariance, ascending eigenvalues and eigenvectors (u, v, w) per group."""
    m = points.groupBy(*by).agg(*moment_sums()).where(F.col("n") >= min_points)
    cov = dict(zip(("cxx", "cxy", "cxz", "cyy", "cyz", "czz"), covariance()))
    out = m.withColumns(cov).withColumn("_e", eigh3(*cov))
    return out.select(*by, F.col("n").cast("long").alias("n"),
                      *(c.alias("m" + a) for a, c in zip(XYZ, mean())), *cov, "_e.*")


def group_frame(points: DataFrame, by: list[str]) -> DataFrame:
    """Points of each group in the group's own PCA frame, centred on its mean."""
    frame = local_pca(points, by).drop("n", *EIGENVALUES, "cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    joined = points.join(frame, by)
    rel = xyz().minus(Vec.of("mx", "my", "mz"))
    local = {a: Vec(*(F.col(k + b) for b in XYZ)).dot(rel) for a, k in zip(XYZ, "uvw")}
    return joined.withColumns(local).select(*points.columns)


def angular_resolution(points: DataFrame, by: list[str], n_lines: int) -> DataFrame:
    """(max theta - min theta) / (lines - 1) of each frame, over all its points."""
    polar = points.withColumn("_theta", polar_ray(xyz()).theta)
    return polar.groupBy(*by).agg(
        F.min("_theta").alias("min_theta"), F.max("_theta").alias("max_theta"),
        ((F.max("_theta") - F.min("_theta")) / (n_lines - 1)).alias("angle_res"))


def frame_normals(points: DataFrame, by: list[str], n_lines: int, h_scale: float = 0.5,
                  r_scale: float = 4.0, p_id: str = "id", outlier_jump: float = 0.003,
                  passes: int = 2, first_point: str = "keep", queries: DataFrame | None = None) -> DataFrame:
    """Normals of lidar frames in sensor coordinates.

    Neighbours are sought in scaled polar space (log range, polar angle,
    squeezed azimuth) within 1.5 times the angular resolution; the PCA is on
    Cartesian positions. Scan-line outliers and points with fewer than four
    neighbours get score -1 and no normal. ``queries`` (thinned frames, say)
    get normals from the neighbours among ``points`` instead; outliers are then
    not looked for, since the queries are no scan lines.
    """
    res = angular_resolution(points, by, n_lines)
    radius = F.col("angle_res") * 1.5
    axes = ("_u", "_v", "_w")

    def scaled(df: DataFrame) -> DataFrame:
        polar = polar_ray(xyz())
        factor = F.try_divide(radius, r_scale * F.log(F.try_divide(1 + radius, 1 - radius)))
        return df.select(*by, p_id, *XYZ).join(res, by).withColumns({
            "_u": F.log(polar.rho) * factor, "_v": polar.theta, "_w": squeeze_phi(polar.phi, h_scale)})

    def unit(df: DataFrame) -> DataFrame:
        # In units of its own radius every frame has neighbours within 1.
        return df.withColumns({a: F.try_divide(F.col(a), radius) for a in axes})

    if queries is None:
        line = F.floor(F.try_divide(F.col("_v") - F.col("min_theta"), F.col("angle_res")) + 0.5).cast("int")
        lined = scan_line_outliers(scaled(points).withColumn("_line", line), by, "_line", p_id, "_u",
                                   outlier_jump, passes, first_point)
        # Query and support of the join below; two passes of windows lie behind it.
        support = checkpointed(unit(lined).select(*by, p_id, *XYZ, *axes, "outlier"))
        asked = support.where(~F.col("outlier"))
    else:
        support, asked = unit(scaled(points)), unit(scaled(queries))
    s = support.select(*by, F.col(p_id).alias("_s"), *axes, *(F.col(a).alias("_p" + a) for a in XYZ))
    q = asked.select(*by, p_id, *axes, *(F.col(a).alias("_o" + a) for a in XYZ))
    pairs = radius_pairs(q, s, 1.0, by, p_id, "_s", axes=axes, carry=["_p" + a for a in XYZ],
                         q_carry=["_o" + a for a in XYZ])
    rel = Vec(*(F.col("_p" + a) - F.col("_o" + a) for a in XYZ))
    m = pairs.groupBy(*by, p_id).agg(*moment_sums(rel)).where(F.col("n") >= 4)
    e = m.withColumn("_e", eigh3(*covariance())).select(*by, p_id, "_e.*")
    wanted = points if queries is None else queries
    joined = wanted.join(e, [*by, p_id], "left")
    normal = face_sensor(Vec.of("ux", "uy", "uz"), xyz()).columns("nx", "ny", "nz")
    ratios = eigen_ratios(*EIGENVALUES)
    return joined.select(
        *wanted.columns, *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in normal.items()),
        *(F.coalesce(ratios[k], F.lit(-1.0)).alias(k) for k in ("planarity", "linearity", "score")))


# --- dominant normals --------------------------------------------------------


def gaussian_offsets(dims: int, size: int = 5) -> list[tuple[tuple[int, ...], float]]:
    """Offsets and normalised weights of a discrete Gaussian with sigma (size/2 - 0.5)/2."""
    sigma = (size / 2 - 0.5) / 2
    half = size // 2
    grid = [()]
    for _ in range(dims):
        grid = [g + (k,) for g in grid for k in range(-half, half + 1)]
    raw = {g: math.exp(-sum(k * k for k in g) / (2 * sigma * sigma + 1e-6)) for g in grid}
    total = sum(raw.values())
    return [(g, w / total) for g, w in raw.items()]


def convolve(cells: DataFrame, by: list[str], axes: list[str], values: list[str],
             offsets: list[tuple[tuple[int, ...], float]]) -> DataFrame:
    """Weighted sum of sparse cells over an offset table: spread, then aggregate."""
    table = F.array(*(F.struct(*(F.lit(k).alias(f"_d{i}") for i, k in enumerate(g)),
                               F.lit(float(w)).alias("_w")) for g, w in offsets))
    spread = cells.withColumn("_o", F.explode(table))
    moved = spread.select(
        *by, *((F.col(a) + F.col("_o")[f"_d{i}"]).alias(a) for i, a in enumerate(axes)),
        *((F.col(v) * F.col("_o")["_w"]).alias(v) for v in values))
    return moved.groupBy(*by, *axes).agg(*(F.sum(v).alias(v) for v in values))


def normal_histogram(points: DataFrame, by: list[str] = (), size: float = 0.05) -> DataFrame:
    """Occupied bins of the normals with raw and Gaussian-smoothed counts."""
    by = list(by)
    bins = points.select(*by, *(cell("n" + a, size).alias("b" + a) for a in XYZ))
    axes = ["bx", "by", "bz"]
    counted = bins.groupBy(*by, *axes).agg(F.count(F.lit(1)).alias("n"))
    smooth = convolve(counted.withColumn("smooth", F.col("n").cast("double")), by, axes, ["smooth"],
                      gaussian_offsets(3, 5))
    return counted.join(smooth, [*by, *axes])


def _with_limit(hist: DataFrame, limit: DataFrame, by: list[str]) -> DataFrame:
    """The limit beside every bin; without groups it is one row, which is broadcast."""
    return hist.join(limit, by) if by else hist.withColumn("_k", F.lit(0)).join(F.broadcast(limit.withColumn("_k", F.lit(0))), "_k").drop("_k")


def dominant_normal_weights(points: DataFrame, by: list[str], size: float = 0.05,
                            share: float = 0.8) -> DataFrame:
    """Weight 1 for points in bins whose smoothed count exceeds the percentile over bins, else 0."""
    hist = normal_histogram(points, by, size)
    limit = hist.groupBy(*by).agg(F.percentile("smooth", share).alias("_limit"))
    marked = (_with_limit(hist, limit, by)
              .select(*by, "bx", "by", "bz", (F.col("smooth") > F.col("_limit")).cast("double").alias("weight")))
    keyed = points.withColumns({"b" + a: cell("n" + a, size) for a in XYZ})
    return keyed.join(marked, [*by, "bx", "by", "bz"]).drop("bx", "by", "bz")


def normals_orientation(points: DataFrame, by: list[str], size: float = 0.05, share: float = 0.8) -> DataFrame:
    """Principal axes of the dominant normal bins (uncentred second moments of bin centres)."""
    hist = normal_histogram(points, by, size)
    limit = hist.groupBy(*by).agg(F.percentile("smooth", share).alias("_limit"))
    top = _with_limit(hist, limit, by).where(F.col("smooth") > F.col("_limit"))
    centre = Vec(*((F.col("b" + a) + 0.5) * size for a in XYZ))
    m = top.groupBy(*by).agg(*moment_sums(centre))
    raw = [F.col(k) / F.col("n") for k in ("sxx", "sxy", "sxz", "syy", "syz", "szz")]
    return m.withColumn("_e", eigh3(*raw)).select(*by, F.col("n").cast("long").alias("bins"), "_e.*")


# --- fitted planes -----------------------------------------------------------


def fit_planes(members: DataFrame, by: list[str], min_points: int = 0, max_planes: int | None = None,
               within: list[str] = ()) -> DataFrame:
    """Least-squares plane a x + b y + c z = d of each group with its size and RMS distance."""
    e = local_pca(members, by, min_points=3).where(F.col("n") > min_points)
    d = F.col("ux") * F.col("mx") + F.col("uy") * F.col("my") + F.col("uz") * F.col("mz")
    rms = F.sqrt(F.greatest(F.col("l0"), F.lit(0.0)))
    planes = e.select(*by, "n", F.col("ux").alias("a"), F.col("uy").alias("b"), F.col("uz").alias("c"),
                      d.alias("d"), rms.alias("rms"))
    if max_planes is None:
        return planes
    if within:
        from .scans import top_k
        rest = [k for k in by if k not in within]
        return top_k(planes, list(within), [F.desc("n"), *rest], max_planes).drop("rank")
    return planes.orderBy(F.desc("n"), *by).limit(max_planes)


def normal_errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """RMSE of the unsigned angle between predicted (n*) and true (g*) normals."""
    e = unsigned_normal_error(Vec.of("nx", "ny", "nz"), Vec.of("gx", "gy", "gz"))
    return pairs.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


# --- registration residuals --------------------------------------------------


def matched_points(points: DataFrame, map_points: DataFrame, max_pair: float, max_planar: float,
                   p_id: str = "id", map_id: str = "map_id") -> DataFrame:
    """Frame points with their nearest map point, its normal and the planar distance."""
    carried = map_points.select(map_id, *XYZ, "nx", "ny", "nz",
                                *(F.col(a).alias("m" + a) for a in XYZ))
    hit = nearest_join(points, carried, [], p_id, map_id, carry=["mx", "my", "mz", "nx", "ny", "nz"],
                       max_distance=max_pair)
    both = points.join(hit, p_id).where(F.col("d2") < max_pair * max_pair)
    gap = Vec.of("mx", "my", "mz").minus(xyz())
    planar = F.abs(gap.dot(Vec.of("nx", "ny", "nz")))
    return both.withColumn("planar", planar).where(F.col("planar") < max_planar)


def registration_residuals(matches: DataFrame, by: list[str], legacy_prms: bool = False) -> DataFrame:
    """Point RMS and planar RMS per frame.

    ``legacy_prms`` takes the root of the mean planar distance, not of its square.
    """
    planar = F.col("planar") if legacy_prms else F.col("planar") * F.col("planar")
    return matches.groupBy(*by).agg(F.sqrt(F.avg("d2")).alias("rms"), F.sqrt(F.avg(planar)).alias("planar_rms"),
                                    F.count(F.lit(1)).alias("n"))


def point_to_plane_sums(matches: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Normal equations of the linearised point-to-plane problem: 21 + 6 sums per frame."""
    p, n, q = xyz(), Vec.of("nx", "ny", "nz"), Vec.of("mx", "my", "mz")
    row = [*p.cross(n), *n]
    rhs = n.dot(q.minus(p))
    w = F.col(weight) if weight else F.lit(1.0)
    upper = [F.sum(w * row[i] * row[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)]
    return matches.groupBy(*by).agg(*upper, *(F.sum(w * row[i] * rhs).alias(f"b{i}") for i in range(6)))


def point_to_plane_step(matches: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """One refinement step for all frames at once: rotation vector and translation per frame."""
    sums = point_to_plane_sums(matches, by, weight)
    upper = F.array(*(f"a{i}{j}" for i in range(6) for j in range(i, 6)))
    rhs = F.array(*(f"b{i}" for i in range(6)))
    solved = sums.withColumn("_x", solve6(upper, rhs))
    return solved.select(*by, *(F.col("_x")[i].alias(k) for i, k in enumerate(("rx", "ry", "rz", "tx", "ty", "tz"))))
