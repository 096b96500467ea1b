"""Listings: frames, sessions, map versions, finished work, prediction snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import class_iou, confusion
from ..storage import Files
from .ply import decode_files, list_files, path_session, path_stamp


def frame_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Frames below ``path`` by session and time; only file listings are read."""
    files = list_files(spark, path).select("path", "length", "modificationTime")
    return (files.select(path_session().alias("session"), path_stamp().alias("frame_ts"), "path", "length")
            .where(F.col("frame_ts").isNotNull()).orderBy("session", "frame_ts"))


def catalogue_with_fallback(spark: SparkSession, path: str, folders: tuple[str, str]) -> DataFrame:
    """Frames of the first of two folders that a session has."""
    files = list_files(spark, path).select("path", "length")
    kind = F.when(F.col("path").contains(f"/{folders[0]}/"), 0).when(F.col("path").contains(f"/{folders[1]}/"), 1)
    rows = files.select(path_session().alias("session"), path_stamp().alias("frame_ts"), "path", "length",
                        kind.alias("_k")).where("_k IS NOT NULL AND frame_ts IS NOT NULL")
    best = rows.groupBy("session").agg(F.min("_k").alias("_k"))
    return rows.join(best, ["session", "_k"]).drop("_k").orderBy("session", "frame_ts")


def session_filter(days: list[str] | None = None, first: str | None = None, last: str | None = None,
                   session: str = "session") -> Column:
    """Sessions by list, or by inclusive name range; prunes partitions."""
    c = F.col(session)
    if days is not None:
        return c.isin(*days)
    keep = F.lit(True)
    if first is not None:
        keep = keep & (c >= first)
    if last is not None:
        keep = keep & (c <= last)
    return keep


def not_done(work: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without an entry in the manifest."""
    return work.join(manifest.select(*keys), keys, "left_anti")


def map_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    return sorted(int(n.split("=")[1]) for n in Files(spark, path).names() if n.startswith("version="))


def latest_map(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Newest version of a map table (partitioned by ``version``)."""
    newest = map_versions(spark, path)[-1]
    return spark.read.parquet(f"{path}/version={newest}"), newest


def write_map_version(points: DataFrame, path: str, version: int) -> bool:
    """Add a version; older ones stay.

    The files are written to a staging folder, which readers of ``path`` do not
    see, and published by one rename. A version that is there already stays as it
    is, so a job that is run again changes nothing; the answer says whether this
    call published it.
    """
    files, name = Files(points.sparkSession, path), f"version={version}"
    if files.exists(name):
        return False
    staged = f"_staging/{uuid.uuid4().hex}"
    points.write.parquet(f"{path}/{staged}")
    # Another writer may have been faster; a rename onto a folder would put this one inside it.
    if files.exists(name):
        files.delete(staged)
        return False
    files.rename(staged, name)
    return True


def unexpected_files(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """Files whose path below the session matches none of the allowed patterns (a report only)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length"))
    rest = F.regexp_extract("path", r"\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}/(.*)$", 1)
    known = F.lit(False)
    for pattern in allowed:
        known = known | rest.rlike(pattern)
    return files.select(path_session().alias("session"), rest.alias("file"), "path", "length").where(
        (F.col("session") != "") & ~known)


def snapshot_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Points of ``val_preds_<epoch>`` folders with their epoch; sub-sampled copies are skipped."""
    files = list_files(spark, path).where(~F.col("path").rlike(r"sub\.ply$") & F.col("path").rlike(r"val_preds_\d+"))
    points = decode_files(files, schema)
    return points.withColumn("epoch", F.regexp_extract("path", r"val_preds_(\d+)", 1).cast("int"))


def snapshot_iou(points: DataFrame, labels: list[int], truth: str, pred: str, ignored: list[int] = ()) -> DataFrame:
    """IoU per epoch and class from snapshot points."""
    kept = [l for l in labels if l not in ignored]
    return class_iou(confusion(points, kept, truth, pred, ["epoch"]), ["epoch"])
