"""Batched small linear algebra: the only place where whole Arrow batches go to numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import Vec, col

EIGEN_FIELDS = ("l0", "l1", "l2", "ux", "uy", "uz", "vx", "vy", "vz", "wx", "wy", "wz")
EIGEN_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in EIGEN_FIELDS])
SOLVE_TYPE = T.ArrayType(T.DoubleType())
MOMENTS = ("n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


@F.pandas_udf(EIGEN_TYPE)
def eigh3(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series,
          f: pd.Series) -> pd.DataFrame:
    """Ascending eigenvalues and eigenvectors of [[a,b,c],[b,d,e],[c,e,f]] for a whole batch."""
    m = np.stack([a, b, c, b, d, e, c, e, f], axis=1).astype(float).reshape(-1, 3, 3)
    bad = ~np.isfinite(m).all(axis=(1, 2))
    m[bad] = 0.0
    values, vectors = np.linalg.eigh(m)
    rows = np.concatenate([values, vectors.transpose(0, 2, 1).reshape(-1, 9)], axis=1)
    rows[bad] = np.nan
    return pd.DataFrame(rows, columns=list(EIGEN_FIELDS))


@F.pandas_udf(SOLVE_TYPE)
def solve6(upper: pd.Series, rhs: pd.Series) -> pd.Series:
    """Solve symmetric 6x6 systems given the 21 upper-triangle sums and 6 right-hand sums.

    Singular systems are solved in the least-squares sense.
    """
    n = len(upper)
    a = np.zeros((n, 6, 6))
    i, j = np.triu_indices(6)
    if n:
        flat = np.stack(upper.to_list()).astype(float)
        a[:, i, j] = flat
        a[:, j, i] = flat
        b = np.stack(rhs.to_list()).astype(float)
        x = np.einsum("nij,nj->ni", np.linalg.pinv(a, hermitian=True), b)
    else:
        x = np.zeros((0, 6))
    return pd.Series(list(x))


def moment_sums(p: Vec | None = None, weight=None) -> list[Column]:
    """The ten mergeable sums from which a mean and a covariance follow."""
    p = p or Vec.of("x", "y", "z")
    w = F.lit(1.0) if weight is None else col(weight)
    terms = (w, w * p.x, w * p.y, w * p.z, w * p.x * p.x, w * p.x * p.y, w * p.x * p.z,
             w * p.y * p.y, w * p.y * p.z, w * p.z * p.z)
    return [F.sum(t).alias(n) for t, n in zip(terms, MOMENTS)]


def covariance(divide: bool = True) -> tuple[Column, ...]:
    """Six covariance entries from moment columns (scatter matrix if ``divide`` is off)."""
    n, sx, sy, sz, sxx, sxy, sxz, syy, syz, szz = (F.col(m) for m in MOMENTS)
    raw = (sxx - sx * sx / n, sxy - sx * sy / n, sxz - sx * sz / n,
           syy - sy * sy / n, syz - sy * sz / n, szz - sz * sz / n)
    return tuple(c / n for c in raw) if divide else raw


def mean() -> Vec:
    return Vec(F.col("sx") / F.col("n"), F.col("sy") / F.col("n"), F.col("sz") / F.col("n"))
