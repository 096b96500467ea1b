"""Scalar geometry on plain double columns.

Every function takes and returns Columns, so Catalyst sees the whole
expression and it stays within one code-generated stage.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
TWO_PI = 2.0 * math.pi


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


class Vec(NamedTuple):
    """Three double columns handled together."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, x, y, z) -> "Vec":
        return cls(col(x), col(y), col(z))

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(
            self.y * o.z - self.z * o.y,
            self.z * o.x - self.x * o.z,
            self.x * o.y - self.y * o.x,
        )

    def minus(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def plus(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def times(self, s) -> "Vec":
        return Vec(self.x * s, self.y * s, self.z * s)

    def sq_norm(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.sq_norm())

    def columns(self, *names: str) -> dict[str, Column]:
        return dict(zip(names or ("x", "y", "z"), self))


class Polar(NamedTuple):
    rho: Column
    theta: Column
    phi: Column


XYZ = ("x", "y", "z")


def xyz(prefix: str = "", suffix: str = "") -> Vec:
    return Vec(*(F.col(f"{prefix}{a}{suffix}") for a in XYZ))


def clip(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def sq_distance(a: Vec, b: Vec) -> Column:
    return a.minus(b).sq_norm()


# --- polar coordinates -------------------------------------------------------


def polar_wrapped(p: Vec) -> Polar:
    """Sensor convention with phi = (3pi/2 - atan2(y, x)) mod 2pi (clockwise from -y)."""
    return Polar(
        p.norm(),
        F.atan2(F.sqrt(p.x * p.x + p.y * p.y), p.z),
        F.pmod(F.lit(1.5 * PI) - F.atan2(p.y, p.x), F.lit(TWO_PI)),
    )


def polar_ray(p: Vec) -> Polar:
    """Ray-casting convention with phi = atan2(y, x) + pi/2, not wrapped."""
    return Polar(
        p.norm(),
        F.atan2(F.sqrt(p.x * p.x + p.y * p.y), p.z),
        F.atan2(p.y, p.x) + F.lit(PI / 2),
    )


def cartesian_spherical(p: Polar) -> Vec:
    """Textbook spherical to Cartesian with the raw phi.

    Not an inverse of either polar convention above; see
    :func:`cartesian_from_wrapped` and :func:`cartesian_from_ray` for those.
    """
    return Vec(
        p.rho * F.sin(p.theta) * F.cos(p.phi),
        p.rho * F.sin(p.theta) * F.sin(p.phi),
        p.rho * F.cos(p.theta),
    )


def cartesian_from_wrapped(p: Polar) -> Vec:
    return cartesian_spherical(Polar(p.rho, p.theta, F.lit(1.5 * PI) - p.phi))


def cartesian_from_ray(p: Polar) -> Vec:
    return cartesian_spherical(Polar(p.rho, p.theta, p.phi - F.lit(PI / 2)))


def log_range(rho, polar_r: float, r_scale: float) -> Column:
    """ln(r) stretched so that a relative neighbourhood ``polar_r`` has size ``polar_r / r_scale``."""
    factor = polar_r / (r_scale * math.log((1 + polar_r) / (1 - polar_r)))
    return F.log(col(rho)) * F.lit(factor)


def squeeze_phi(phi, h_scale: float) -> Column:
    return col(phi) / F.lit(h_scale)


# --- grids -------------------------------------------------------------------


def cell(c, size: float) -> Column:
    """Index of the grid cell that holds ``c``; cells are half open."""
    return F.floor(col(c) / F.lit(float(size))).cast("long")


def cells(size: float, names=XYZ, prefix: str = "v") -> dict[str, Column]:
    return {prefix + n: cell(n, size) for n in names}


# --- planes and normals ------------------------------------------------------


class Plane(NamedTuple):
    """a x + b y + c z = d with a unit normal."""

    a: Column
    b: Column
    c: Column
    d: Column

    @property
    def normal(self) -> Vec:
        return Vec(self.a, self.b, self.c)


def plane_from_points(p0: Vec, p1: Vec, p2: Vec) -> Plane:
    """Plane through three points; NULL for collinear ones."""
    n = p1.minus(p0).cross(p2.minus(p0))
    length = n.norm()
    unit = Vec(*(F.when(length > 0, v / length) for v in n))
    return Plane(*unit, unit.dot(p0))


def plane_from_normal(p: Vec, n: Vec) -> Plane:
    return Plane(*n, n.dot(p))


def plane_distance(pl: Plane, p: Vec) -> Column:
    return F.abs(pl.normal.dot(p) - pl.d)


def plane_sq_distance(pl: Plane, p: Vec) -> Column:
    gap = pl.normal.dot(p) - pl.d
    return gap * gap


def in_plane(pl: Plane, p: Vec, threshold: float) -> Column:
    return plane_distance(pl, p) < F.lit(threshold)


def verticality(nz) -> Column:
    """Angle between a normal and the vertical axis, whichever way it points."""
    return F.acos(F.abs(clip(nz, -1.0, 1.0)))


def face_sensor(n: Vec, p: Vec) -> Vec:
    """Turn the normal of a point in sensor coordinates towards the origin."""
    away = n.dot(p) > 0
    return Vec(*(F.when(away, -v).otherwise(v) for v in n))


def eigen_ratios(l0, l1, l2) -> dict[str, Column]:
    """Planarity, linearity and normal score from ascending eigenvalues."""
    l0, l1, l2 = col(l0), col(l1), col(l2)
    top = l2 + F.lit(1e-9)
    return {"planarity": (l1 - l0) / top, "linearity": 1 - l1 / top, "score": 1 - l0 / top}


def normal_quality(score, rho, angle) -> Column:
    """Score of a normal weighed by incidence (steep part) and range (bell part), at most 1."""
    score, rho, angle = col(score), col(rho), col(angle)
    steep = 5 * PI / 12
    slope = 0.2 / (PI / 2 - steep)
    bell = 0.2 + 0.8 * F.exp(-0.01 * (rho - 2) * (rho - 2))
    weighed = F.when(angle > steep, score * slope * (PI / 2 - angle)).otherwise(score * bell)
    return F.least(weighed, F.lit(1.0))


def range_score(score, rho) -> Column:
    rho = col(rho)
    return col(score) * (1.5 - F.exp(-(rho / 5) * (rho / 5)))


def incidence(n: Vec, p: Vec) -> Column:
    """Angle between the viewing ray of ``p`` and the line of normal ``n``."""
    return F.acos(F.least(F.abs(F.try_divide(n.dot(p), p.norm())), F.lit(1.0)))


def unsigned_normal_error(n: Vec, g: Vec) -> Column:
    ratio = F.abs(n.dot(g)) / (n.norm() * g.norm() + 1e-6)
    return F.acos(F.least(ratio, F.lit(1.0)))


# --- scalar ramps and kernels ------------------------------------------------


def movable_ramp(dr) -> Column:
    return clip((col(dr) - 0.05) / 0.10, 0.0, 1.0)


def still_ramp(dr) -> Column:
    return clip((F.abs(col(dr)) - 0.15) / -0.10, 0.0, 1.0)


def gaussian_weight(sq_dist, sigma: float) -> Column:
    return F.exp(-col(sq_dist) / F.lit(2.0 * sigma * sigma + 1e-9))


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def softmax(array) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    array = col(array)
    exps = F.transform(array, lambda v: F.exp(v - F.array_max(array)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(exps, lambda v: v / total)


def logit_cross_entropy(logit, target) -> Column:
    """Binary cross-entropy on a logit in its overflow-safe form."""
    logit, target = col(logit), col(target)
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def to_byte(p) -> Column:
    return F.floor(col(p) * 255).cast("short")


def from_byte(b) -> Column:
    return col(b).cast("double") / 255


def soft_hysteresis(v) -> Column:
    """0 up to 0.05, a smooth step between 0.05 and 0.08, the value itself above."""
    v = col(v)
    ease = 1 - F.pow((v - 0.08) / 0.03, 2)
    return F.when(v <= 0.05, F.lit(0.0)).when(v < 0.08, v * ease * ease).otherwise(v)


def lift_positive(v) -> Column:
    """Map positive cells onto [0.5, 1]; cells up to 0.01 are left alone."""
    v = col(v)
    return F.when(v > 0.01, 0.5 * (v + 1)).otherwise(v)


def balance_factor(class_share, row_sum) -> Column:
    return col(class_share) / (col(row_sum) + 1e-6)
