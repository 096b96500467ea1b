"""Pose, calibration and odometry tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Vec
from ..functions.rigid import MATRIX, Rigid, rigid_from_euler, rigid_from_quaternion
from ..operators.temporal import pick_by_priority
from .logs import numbered_lines
from .ply import path_session


def _csv(spark: SparkSession, path: str, width: int, header: bool) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(width))
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=True, ignoreLeadingWhiteSpace=True)


def read_legacy_poses(spark: SparkSession, path: str) -> DataFrame:
    """Older pose CSV: one header row, time in column 0, position in 5-7, quaternion in 8-11."""
    raw = _csv(spark, path, 12, True)
    names = ("px", "py", "pz", "qx", "qy", "qz", "qw")
    return raw.select(path_session(F.input_file_name()).alias("session"), F.col("c0").cast("double").alias("t"),
                      *(F.col(f"c{i + 5}").cast("double").alias(n) for i, n in enumerate(names)))


def read_euler_poses(spark: SparkSession, path: str, degrees: bool = False, header: bool = True) -> DataFrame:
    """Pose CSV with t, x, y, z, roll, pitch, heading; matrix columns out."""
    raw = _csv(spark, path, 7, header)
    v = [F.col(f"c{i}").cast("double") for i in range(7)]
    r = rigid_from_euler(v[4], v[5], v[6], Vec(v[1], v[2], v[3]), degrees)
    return raw.select(F.input_file_name().alias("path"), v[0].alias("t"), *(c.alias(n) for n, c in r.columns().items()))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Sensor-to-body transform composed from the transforms in rows 1, 4 and 7 of the file.

    Translation in columns 2-4, quaternion in 5-8. One row per file.
    """
    fields = numbered_lines(spark, path).select("path", "line", F.transform(F.split("text", ","), lambda s: F.trim(s)).alias("w"))
    at = lambda i: F.get("w", F.lit(i)).cast("double")
    step = rigid_from_quaternion([at(i) for i in (5, 6, 7, 8)], Vec(at(2), at(3), at(4)))
    rows = fields.where(F.col("line").isin(1, 4, 7)).select("path", "line", *(c.alias(n) for n, c in step.columns().items()))
    wide = rows.groupBy("path").agg(*(F.max(F.when(F.col("line") == l, F.col(n))).alias(f"m{l}_{n}")
                                      for l in (1, 4, 7) for n in MATRIX))
    whole = Rigid.named("m1_").then(Rigid.named("m4_")).then(Rigid.named("m7_"))
    return wide.select("path", *(c.alias(n) for n, c in whole.columns().items()))


def read_odometry(spark: SparkSession, path: str, t0: float, t1: float, names: list[str], header: bool = True) -> DataFrame:
    """Odometry rows with t0 <= t <= t1; the first column is the time."""
    raw = _csv(spark, path, len(names) + 1, header)
    rows = raw.select(F.col("c0").cast("double").alias("t"),
                      *(F.col(f"c{i + 1}").cast("double").alias(n) for i, n in enumerate(names)))
    return rows.where(F.col("t").between(t0, t1))


def poses_with_fallback(poses: DataFrame, sessions: DataFrame, kinds: list[str]) -> DataFrame:
    """Poses of the first kind each session has; a session with none of them is an error."""
    picked = pick_by_priority(poses, kinds, ["session"])
    joined = sessions.select("session").join(picked, "session", "left")
    missing = F.raise_error(F.concat(F.lit("no poses for session "), "session")).cast("double")
    return joined.withColumn("t", F.coalesce("t", missing))
