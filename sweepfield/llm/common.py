"""Helpers the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..runtime import checkpointed


def free_name(taken: list[str]) -> str:
    """A column name that is not in ``taken``, whatever the case of its letters."""
    name, low = "__text", {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores more as it takes to be none of ``taken``, whatever the case of its letters."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def few_rows_a_batch(spark: SparkSession) -> None:
    """Whole documents are large rows: Spark hands Python 1,024 of them at a time instead of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, few at a time, so that what is made of them in Python stays small beside Spark's own batches."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def per_text(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[str], tuple]], fields: list[StructField]) -> DataFrame:
    """``keep`` columns and what ``make()`` computes from each whole text (null: empty).

    ``make`` runs once in each task and returns the function for one text, so
    models and compiled patterns are built once. Rows are streamed by Arrow
    batches; extra columns of ``df`` are not read.
    """
    schema = StructType([df.schema[k] for k in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in small(batches):
            made = [each(t) for t in b.column(len(keep)).to_pylist()]
            cols = zip(*made) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free_name(keep))).mapInArrow(run, schema)


def with_text(df: DataFrame, text: str, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """All columns of ``df``, with ``text`` rewritten; a null text stays null."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in small(batches):
            done = pa.array([None if t is None else each(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_share(*cols: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage through the shared checkpoint folder."""
    return checkpointed(df)


def shared_folder(df: DataFrame) -> str:
    """A new path below the shared checkpoint folder."""
    checkpointed(df.sparkSession.range(1))
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def both_ways(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Two rows for each one, the columns of ``first`` and those of ``second``, in the partitions of ``rows``."""
    pair = [F.struct(*(F.col(c).alias(n) for c, n in zip(cols, names))) for cols in (first, second)]
    return rows.select(F.explode(F.array(*pair)).alias("_r")).select("_r.*")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``: the smallest node reachable.

    Alternates large-star and small-star steps on the edge list until it is a
    forest of stars. Each step is a grouped minimum and a join, so a node with
    very many links is combined map-side and its join side is split by AQE.
    """
    e = stored(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())

    def settled(t: DataFrame) -> bool:
        """No node has two parents, and none is parent and child."""
        ends = both_ways(t.withColumns({"c": F.lit(1), "p": F.lit(0)}), ("a", "c"), ("b", "p"), ("node", "child"))
        return ends.groupBy("node").agg(F.sum("child").alias("n"), F.min("child").alias("least")).where("n > 1 or (n = 1 and least = 0)").isEmpty()

    for _ in range(rounds):
        if settled(e):
            break
        both = both_ways(e, ("a", "b"), ("b", "a"), ("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = stored(both_ways(large.join(least, "a"), ("b", "m"), ("a", "m"), ("a", "b")).where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return both_ways(e, ("a", "b"), ("b", "b"), ("node", "root")).distinct()


def in_blocks(rows: DataFrame, queries: DataFrame, key: list[str], n_rows: int, n_queries: int, shard_rows: int, block_rows: int, search, schema: StructType) -> DataFrame:
    """``search(rows, queries)`` on Arrow tables for every shard of ``rows`` and every block of ``queries``.

    Both sides are dealt by a hash of ``key``, so a task holds about
    ``shard_rows`` and ``block_rows`` rows whatever the input; a shard is sent
    once for each block of queries.
    """
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // block_rows))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return dealt.groupBy("_shard", "_block").cogroup(asked.groupBy("_shard", "_block")).applyInArrow(search, schema)
