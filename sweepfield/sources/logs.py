"""Text logs of training and validation runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_root
from ..storage import lots


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with their number in the file.

    Line numbers need the file whole; these logs are a few lines per epoch. Very many files (in several folders, as
    of ``folder/*``) are read in lots, whose lines are kept as Parquet: the driver never holds the listing of all.
    """
    parts = lots(spark, path)
    if len(parts) == 1:
        return _lines(spark, path)
    # Small files of a task; the session's own settings stay.
    apart, kept = spark.newSession(), f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    apart.conf.set("spark.sql.files.openCostInBytes", "64k")
    for part in parts:
        _lines(apart, part).write.mode("append").parquet(kept)
    return spark.read.parquet(kept)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return lines.where(F.trim("text") != "")


def _numbers(text="text"):
    return F.filter(F.split(F.trim(text), r"[\s,\[\]]+"), lambda s: s != "")


def read_confusions(spark: SparkSession, path: str, n_class: int) -> DataFrame:
    """One flattened n x n matrix per line as (epoch, truth, pred, n)."""
    cells = numbered_lines(spark, path).select("path", F.col("line").alias("epoch"), F.posexplode(_numbers()).alias("i", "v"))
    return cells.select("path", "epoch", F.floor(F.col("i") / n_class).cast("int").alias("truth"),
                        (F.col("i") % n_class).alias("pred"), F.col("v").cast("double").cast("long").alias("n"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows after the header; the last two losses are NULL in logs that lack them."""
    words = numbered_lines(spark, path).where("line > 0").select("path", "line", _numbers().alias("w"))
    names = (("epoch", "int"), ("step", "int"), ("loss_out", "double"), ("loss_p", "double"),
             ("acc", "double"), ("t", "double"), ("loss_init", "double"), ("loss_prop", "double"))
    return words.select("path", "line", *(F.get("w", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)))


def read_single_iou(spark: SparkSession, path: str) -> DataFrame:
    """One list of class IoUs per line as (epoch, label, iou)."""
    return numbered_lines(spark, path).select(
        "path", F.col("line").alias("epoch"), F.posexplode(_numbers()).alias("label", "v")).select(
        "path", "epoch", "label", F.col("v").cast("double").alias("iou"))


def read_multi_iou(spark: SparkSession, path: str) -> DataFrame:
    """Objects separated by slashes, class IoUs within, as (epoch, object, label, iou)."""
    parts = numbered_lines(spark, path).select(
        "path", F.col("line").alias("epoch"), F.posexplode(F.split("text", "/")).alias("object", "o"))
    cells = parts.where(F.trim("o") != "").select("path", "epoch", "object", F.posexplode(_numbers("o")).alias("label", "v"))
    return cells.select("path", "epoch", "object", "label", F.col("v").cast("double").alias("iou"))
