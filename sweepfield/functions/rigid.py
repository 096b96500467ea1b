"""Rigid transforms as twelve (or quaternion: seven) double columns.

A matrix is kept as separate columns, not an array: columns take part in
code generation and in column pruning.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import Vec, clip, col

MATRIX = tuple(f"r{i}{j}" for i in range(3) for j in range(3)) + ("t0", "t1", "t2")
QUATERNION = ("qx", "qy", "qz", "qw")
POSITION = ("px", "py", "pz")


class Rigid(NamedTuple):
    """Rotation rows and a translation."""

    r0: Vec
    r1: Vec
    r2: Vec
    t: Vec

    @classmethod
    def named(cls, prefix: str = "") -> "Rigid":
        c = [F.col(prefix + n) for n in MATRIX]
        return cls(Vec(*c[0:3]), Vec(*c[3:6]), Vec(*c[6:9]), Vec(*c[9:12]))

    @property
    def cols(self) -> tuple[Vec, Vec, Vec]:
        return tuple(Vec(self.r0[k], self.r1[k], self.r2[k]) for k in range(3))

    def rotate(self, v: Vec) -> Vec:
        return Vec(self.r0.dot(v), self.r1.dot(v), self.r2.dot(v))

    def apply(self, p: Vec) -> Vec:
        return self.rotate(p).plus(self.t)

    def unapply(self, p: Vec) -> Vec:
        return self.unrotate(p.minus(self.t))

    def unrotate(self, v: Vec) -> Vec:
        return Vec(*(c.dot(v) for c in self.cols))

    def inverse(self) -> "Rigid":
        c = self.cols
        return Rigid(*c, Vec(*(-k.dot(self.t) for k in c)))

    def then(self, outer: "Rigid") -> "Rigid":
        """``outer`` after ``self`` (matrix product outer * self)."""
        c = self.cols
        rows = [Vec(*(r.dot(k) for k in c)) for r in (outer.r0, outer.r1, outer.r2)]
        return Rigid(*rows, outer.apply(self.t))

    def columns(self, prefix: str = "") -> dict[str, Column]:
        return dict(zip((prefix + n for n in MATRIX), (*self.r0, *self.r1, *self.r2, *self.t)))


def normalised(q: tuple[Column, ...]) -> tuple[Column, ...]:
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return tuple(F.try_divide(c, n) for c in q)


def rigid_from_quaternion(q, t: Vec) -> Rigid:
    """Matrix of the quaternion (x, y, z, w), which need not have unit length."""
    x, y, z, w = (col(c) for c in q)
    s = F.try_divide(F.lit(2.0), x * x + y * y + z * z + w * w)
    return Rigid(
        Vec(1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)),
        Vec(s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)),
        Vec(s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)),
        t,
    )


def rigid_from_euler(roll, pitch, heading, t: Vec, degrees: bool = True) -> Rigid:
    """Rz(heading) Ry(pitch) Rx(roll)."""
    k = math.pi / 180 if degrees else 1.0
    r, p, h = (col(a) * F.lit(k) for a in (roll, pitch, heading))
    sr, cr, sp, cp, sh, ch = F.sin(r), F.cos(r), F.sin(p), F.cos(p), F.sin(h), F.cos(h)
    return Rigid(
        Vec(ch * cp, ch * sp * sr - sh * cr, ch * sp * cr + sh * sr),
        Vec(sh * cp, sh * sp * sr + ch * cr, sh * sp * cr - ch * sr),
        Vec(-sp, cp * sr, cp * cr),
        t,
    )


def with_slerp(df: DataFrame, q0, q1, fraction) -> DataFrame:
    """Add ``qx, qy, qz, qw``: the shortest-arc interpolation between two quaternions.

    Linear where they nearly agree. Built up in steps, since a quaternion that
    is written out inside its own norm several times over makes an expression
    far larger than the computation.
    """
    a, b = ["_a" + n for n in QUATERNION], ["_b" + n for n in QUATERNION]
    unit = dict(zip(a, normalised(tuple(col(c) for c in q0)))) | dict(zip(b, normalised(tuple(col(c) for c in q1))))
    df = df.withColumns(unit | {"_f": col(fraction)})
    dot = sum((F.col(u) * F.col(v) for u, v in zip(a[1:], b[1:])), F.col(a[0]) * F.col(b[0]))
    df = df.withColumn("_dot", dot)
    df = df.withColumns({"_sign": F.when(F.col("_dot") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
                         "_omega": F.acos(F.least(F.abs("_dot"), F.lit(1.0)))})
    f, omega, near = F.col("_f"), F.col("_omega"), F.abs("_dot") > 0.9995
    s = F.sin(omega)
    df = df.withColumns({
        "_wa": F.when(near, 1 - f).otherwise(F.try_divide(F.sin((1 - f) * omega), s)),
        "_wb": F.when(near, f).otherwise(F.try_divide(F.sin(f * omega), s)) * F.col("_sign")})
    mixed = ["_m" + n for n in QUATERNION]
    df = df.withColumns({m: F.col("_wa") * F.col(u) + F.col("_wb") * F.col(v) for m, u, v in zip(mixed, a, b)})
    df = df.withColumns(dict(zip(QUATERNION, normalised(tuple(F.col(m) for m in mixed)))))
    return df.drop(*a, *b, *mixed, "_f", "_dot", "_sign", "_omega", "_wa", "_wb")


def lerp(a, b, fraction) -> Column:
    f = col(fraction)
    return (1 - f) * col(a) + f * col(b)


def translation_gap(a: Rigid, b: Rigid) -> Column:
    return b.t.minus(a.t).norm()


def rotation_gap(a: Rigid, b: Rigid) -> Column:
    """Angle of b.R * a.R^T."""
    trace = a.r0.dot(b.r0) + a.r1.dot(b.r1) + a.r2.dot(b.r2)
    return F.acos(clip((trace - 1) / 2, -1.0, 1.0))


def axis_angle(axis: Vec, angle) -> Rigid:
    """Rodrigues rotation about a unit axis."""
    angle = col(angle)
    c, s = F.cos(angle), F.sin(angle)
    k = 1 - c
    x, y, z = axis
    zero = F.lit(0.0)
    return Rigid(
        Vec(c + k * x * x, k * x * y - s * z, k * x * z + s * y),
        Vec(k * x * y + s * z, c + k * y * y, k * y * z - s * x),
        Vec(k * x * z - s * y, k * y * z + s * x, c + k * z * z),
        Vec(zero, zero, zero),
    )


def matrices_of(poses: DataFrame) -> DataFrame:
    """Pose rows with quaternions become pose rows with matrix columns."""
    rigid = rigid_from_quaternion(QUATERNION, Vec(*(F.col(c) for c in POSITION)))
    kept = [c for c in poses.columns if c not in POSITION + QUATERNION]
    return poses.select(*kept, *(c.alias(n) for n, c in rigid.columns().items()))


def move_points(points: DataFrame, poses: DataFrame, on: list[str], inverse: bool = False,
                normals: bool = False) -> DataFrame:
    """Bring points into the frame of their pose row (or back, with ``inverse``).

    ``poses`` has one row of matrix columns per key; Catalyst picks a broadcast
    when its statistics prove it small and a shuffled join otherwise.
    """
    r = Rigid.named("_m_")
    marked = poses.select(*on, *(F.col(n).alias("_m_" + n) for n in MATRIX))
    joined = points.join(marked, on)
    place = Vec(*(F.col(a) for a in "xyz"))
    moved = (r.unapply if inverse else r.apply)(place).columns("x", "y", "z")
    if normals:
        n = Vec(F.col("nx"), F.col("ny"), F.col("nz"))
        moved |= (r.unrotate if inverse else r.rotate)(n).columns("nx", "ny", "nz")
    return joined.withColumns(moved).drop(*("_m_" + n for n in MATRIX))
