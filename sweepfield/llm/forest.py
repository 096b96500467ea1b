"""Nearest neighbours by inner product from a forest of sorted hash strings.

Every tree gives each vector a long string of bits, the sides of random planes
it lies on, and keeps the strings sorted. A query descends to its longest
matching prefix in every tree, then ascends in all trees at once, a bit at a
time, until the prefixes cover enough candidates; these are scored exactly.
Vectors are first lifted to the unit sphere, where the nearest by angle is the
largest inner product. The forest is built for each shard of the vectors, and
blocks of queries visit every shard, so no task holds more than a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import in_blocks, stored

TREES = 128
BITS = 32
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
COVER = 1.0


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part.

    Null ids, null, empty and zero vectors and those with null or non-finite
    components do not; nor do vectors whose length is not the commonest one
    (of equally common, the longer). Repeated ids are merged to their smallest
    vector.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    rows = rows.where(F.size("v") == (width["d"] if width else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def planes(dim: int, seed: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Random planes, (dimensions, trees * bits)."""
    return np.random.default_rng(seed).normal(size=(dim, trees * bits))


def hash_strings(x: np.ndarray, plane: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(trees, rows): each vector's string of bits in each tree, the first plane in the highest bit."""
    out = np.empty((plane.shape[1] // bits, len(x)), np.int64)
    weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for t in range(len(out)):
        out[t] = (x @ plane[:, t * bits:(t + 1) * bits] > 0) @ weight
    return out


def prefix_ranges(trees: np.ndarray, asked: np.ndarray, want: float, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """For sorted strings (trees, rows) and query strings (trees, queries): the rows of each tree, from and to, that
    share the longest prefix at which all trees together hold at least ``want`` rows."""
    n_trees, n_queries = asked.shape
    lo, hi = np.zeros((n_trees, n_queries), np.int64), np.full((n_trees, n_queries), trees.shape[1], np.int64)
    level = np.full(n_queries, bits)
    open_ = np.arange(n_queries)
    while len(open_):
        step = 1 << (bits - level[open_]).astype(np.int64)
        a, b = np.empty((n_trees, len(open_)), np.int64), np.empty((n_trees, len(open_)), np.int64)
        for t in range(n_trees):
            start = asked[t, open_] // step * step
            a[t], b[t] = np.searchsorted(trees[t], start), np.searchsorted(trees[t], start + step)
        done = ((b - a).sum(axis=0) >= want) | (level[open_] == 0)
        lo[:, open_[done]], hi[:, open_[done]] = a[:, done], b[:, done]
        level[open_] -= 1
        open_ = open_[~done]
    return lo, hi


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 5, cover: float = COVER,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query, ties to the smaller id.

    ``is_query`` is a condition on ``id``. A query's own row is no candidate.
    ``cover`` is the share of a shard's rows, counted over all trees, that a
    query collects at least: the candidates grow with the data, as they must
    where vectors have no structure. An empty table gives no rows.
    """
    rows = stored(usable(vectors, key, vector))
    facts = rows.agg(F.count("*").alias("n"), F.max(_norm(F.col("v"))).alias("top"), F.max(F.size("v")).alias("d"), F.count(F.when(is_query, 1)).alias("q")).first()
    n, top, dim = facts["n"], facts["top"] or 1.0, facts["d"] or 1
    schema = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])
    names = schema.names

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if shard.num_rows and block.num_rows:
            ids, qids = shard.column("id").to_numpy(), block.column("id").to_numpy()
            x, q = (t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim) for t in (shard, block))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            plane = planes(dim + 1, seed)
            scaled = x / top
            lift = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
            strings = hash_strings(np.column_stack([scaled, lift]), plane)
            asked = hash_strings(np.column_stack([q, np.zeros(len(q))]), plane)
            sorted_rows = np.argsort(strings, axis=1, kind="stable")
            trees = np.take_along_axis(strings, sorted_rows, axis=1)
            # The nearest k and the query's own row may lie in every tree's range without saying anything of the rest.
            lo, hi = prefix_ranges(trees, asked, cover * len(ids) + len(trees) * (k + 1))
            for i in range(len(q)):
                near = np.zeros(len(ids), bool)
                for t in range(len(trees)):
                    near[sorted_rows[t, lo[t, i]:hi[t, i]]] = True
                near &= ids != qids[i]
                rows_ = np.flatnonzero(near)
                score = (x[rows_] * q[i]).sum(axis=1)
                best = np.argsort(-score, kind="stable")[:k]  # rows are in order of id
                found[0] += [qids[i]] * len(best)
                found[1] += ids[rows_[best]].tolist()
                found[2] += score[best].tolist()
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in zip(names, found)})

    hits = in_blocks(rows, rows.where(is_query), ["id"], n, facts["q"], shard_rows, block_rows, search, schema)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
