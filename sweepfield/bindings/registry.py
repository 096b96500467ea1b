"""Registration of queries and the shared views of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; without SQL only its rows are checked."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Points on an integer lattice: sums are exact, so the order of additions does not show.
def lattice(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(
        (F.col("l_suppkey") % 8).alias("session"),
        F.datediff(F.col("l_shipdate"), F.lit("1970-01-01")).cast("long").alias("frame"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"),
        F.round(F.col("l_tax") * 100).alias("z"), F.col("l_linenumber").cast("long").alias("label"),
        F.floor("l_extendedprice").cast("double").alias("price"))


LATTICE = """
pts AS (SELECT l_suppkey % 8 AS session, CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS frame,
  l_quantity AS x, round(l_discount*100) AS y, round(l_tax*100) AS z, CAST(l_linenumber AS BIGINT) AS label,
  floor(l_extendedprice) AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
LATTICE_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous points: the first three components of the embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")),
        F.col("label").cast("long").alias("label"), F.col("embedding")[3].cast("double").alias("f"))


VECTORS = """
vec AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS label, CAST(embedding[4] AS DOUBLE) AS f FROM embeddings)"""


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Timed rows per session with a planar pose made from the value."""
    t = table(spark, sf, "events")
    half = F.col("value") * (3.141592653589793 / 500)
    return t.select(
        F.col("user_id").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        "event_id", "event_type", "value", F.col("value").alias("px"), (F.col("value") / 2).alias("py"),
        F.lit(0.0).alias("pz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"),
        F.sin(half).alias("qz"), F.cos(half).alias("qw"))


# The same timeline; frames are the views and clicks, poses everything else.
TIMELINE = """
ev AS (SELECT user_id AS session, epoch_us(ts)/1e6 AS t, event_id, event_type, value,
  value AS px, value/2 AS py, value*2*pi()/500 AS yaw FROM events),
frames AS (SELECT * FROM ev WHERE event_type IN ('view','click')),
poses AS (SELECT * FROM ev WHERE event_type NOT IN ('view','click'))"""



def frames_and_poses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = timeline(spark, sf)
    is_frame = F.col("event_type").isin("view", "click")
    frames = ev.where(is_frame).select("session", F.col("t").alias("frame_ts"), "event_id")
    return frames, ev.where(~is_frame)
