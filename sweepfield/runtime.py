"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sweepfield")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SWEEPFIELD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through reliable storage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    session without one (a test) gets a temporary folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without one, a temporary folder, which only a local master may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="sweepfield-")


def one_row(df: DataFrame, what: str) -> DataFrame:
    """``df``, which must have at most one row; a second one fails the query."""
    packed = df.agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*df.columns)).alias("_row")).where("_n > 0")
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"more than one {what}"))).otherwise(F.col("_row"))
    return packed.select(checked.alias("_row")).select("_row.*")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` is proven to have at most ``max_rows`` rows.

    Reads no more than ``max_rows + 1`` rows; used before a broadcast.
    """
    return df.limit(max_rows + 1).count() <= max_rows
