"""Ordered operators that stay distributed when one key holds most of the rows.

A plain window sorts a whole key in one task. Here every key is cut into
ordered chunks (a time bucket, a block of ids); windows run per chunk, one
total per chunk is carried forward over the few chunks of a key, and both are
combined. A hot key is thus spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.geometry import col
from ..runtime import checkpointed


class Scan(NamedTuple):
    """One running value: ``kind`` is sum, min, max or last (last non-null)."""

    kind: str
    value: Column
    exclusive: bool = False
    reverse: bool = False


def running(kind: str, value, exclusive: bool = False, reverse: bool = False) -> Scan:
    return Scan(kind, col(value), exclusive, reverse)


def previous(value) -> Scan:
    """The row before, like lag(1), but for nulls, which it passes over."""
    return Scan("last", col(value), True, False)


def following(value) -> Scan:
    return Scan("last", col(value), True, True)


_WINDOWED = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + local, carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


# Rows of a partition of a large scan.
PART_ROWS = 1 << 18


def parts_for(df: DataFrame) -> int | None:
    """Partitions of about ``PART_ROWS`` rows each; None where the session's number of them is enough."""
    parts = -(-df.count() // PART_ROWS)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                scans: dict[str, Scan], partitions: int | None = None) -> DataFrame:
    """Add running values over ``order`` within ``keys``.

    ``chunk`` must rise with ``order`` and be the same for equal leading order
    values. Keys and chunk must not be null. ``partitions`` (see ``parts_for``)
    deals a large table to more tasks than the session's number of shuffle
    partitions, so that a task sorts no more of it.
    """
    parts = [*keys, "_chunk"]
    dealt = lambda d, by: d if partitions is None else d.repartition(partitions, *by)
    base = dealt(df.withColumn("_chunk", chunk), parts)
    up = Window.partitionBy(*parts).orderBy(*order)
    down = Window.partitionBy(*parts).orderBy(*(F.desc(o) for o in order))
    key_up = Window.partitionBy(*keys).orderBy("_chunk")
    key_down = Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
    position = F.struct(*order)

    local, totals, carries = {}, [], {}
    for name, s in scans.items():
        end = -1 if s.exclusive else Window.currentRow
        w = (down if s.reverse else up).rowsBetween(Window.unboundedPreceding, end)
        local["_l_" + name] = _WINDOWED[s.kind](s.value).over(w)
        if s.kind == "last":
            pick = F.min_by if s.reverse else F.max_by
            total = pick(s.value, F.when(s.value.isNotNull(), position))
        else:
            total = _WINDOWED[s.kind](s.value)
        totals.append(total.alias("_t_" + name))
        kw = (key_down if s.reverse else key_up).rowsBetween(Window.unboundedPreceding, -1)
        carries["_c_" + name] = _WINDOWED[s.kind](F.col("_t_" + name)).over(kw)

    carried = (dealt(base.groupBy(*parts).agg(*totals), keys)
               .select(*parts, *(c.alias(n) for n, c in carries.items())))
    joined = base.withColumns(local).join(carried, parts)
    done = {n: _combine(s.kind, F.col("_c_" + n), F.col("_l_" + n)) for n, s in scans.items()}
    return joined.withColumns(done).drop("_chunk", *local, *carries)


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
             name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Row numbers from 1 within each key."""
    return prefix_scan(df, keys, order, chunk, {name: running("sum", F.lit(1).cast("long"))}, partitions)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank",
          salts: int = 64) -> DataFrame:
    """First ``k`` rows per key with their rank.

    Up to k = 1000 Spark drops the rest before the shuffle by itself (window
    group limit). Beyond that rows are ranked per (key, salt) first, so that a
    hot key is never sorted whole in one task.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    if k > 1000:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part))
              .where(F.col("_r") <= k).drop("_salt", "_r"))
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def greedy_chain(links: DataFrame, keys: list[str], pos: str = "pos", nxt: str = "nxt", block: int | None = None) -> DataFrame:
    """Rows visited when each key starts at its first ``pos`` and jumps to ``nxt``.

    Greedy rules ("keep the next one far enough from the last kept") are chains
    of jumps. Jump lengths double every round, so a chain of n rows takes log n
    joins instead of one long fold in a single task. ``nxt`` must exceed
    ``pos``; it is null at the end.

    ``block`` is for whole positions that are unique in a key and dense enough for
    ``block`` of them to fit a task (row numbers); keys must then not be null.
    Chains are followed within blocks, and only the jumps between blocks are doubled.
    """
    if block is not None:
        return _chain_in_blocks(links, keys, pos, nxt, block)
    jumps = checkpointed(links.select(*keys, F.col(pos).alias("_p"), F.col(nxt).alias("_n"))
                         .where(F.col("_n").isNotNull()))
    reached = checkpointed(links.groupBy(*keys).agg(F.min(pos).alias("_p")))
    while True:
        fresh = checkpointed(reached.join(jumps, [*keys, "_p"]).select(*keys, F.col("_n").alias("_p")))
        if fresh.isEmpty():
            return reached.withColumnRenamed("_p", pos)
        reached = reached.unionByName(fresh)
        hop = jumps.select(*keys, F.col("_p").alias("_n"), F.col("_n").alias("_far"))
        jumps = checkpointed(jumps.join(hop, [*keys, "_n"]).select(*keys, "_p", F.col("_far").alias("_n")))


def _chain_in_blocks(links: DataFrame, keys: list[str], pos: str, nxt: str, block: int) -> DataFrame:
    """See ``greedy_chain``.

    Wherever chains enter a block, they leave it at few places; those are the only positions that a chain may
    enter the next one at. The chain over these is found by doubling and then followed within its blocks.
    """
    number = lambda c: F.floor(F.col(c) / block).cast("long").alias("_b")
    steps = checkpointed(links.select(*keys, number(pos), F.col(pos).cast("long").alias("_p"), F.col(nxt).cast("long").alias("_n")))
    grouped = [*keys, "_b"]
    plain = StructType([steps.schema[k] for k in keys] + [StructField("_p", LongType())])

    def jumps(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, where they lead (-1: nowhere, as null), the index of that in the block or the own one, and whether there is one."""
        order = np.argsort(t.column("_p").to_numpy(), kind="stable")
        p = t.column("_p").to_numpy()[order]
        ends = t.column("_n").is_null().to_numpy()[order]
        n = t.column("_n").fill_null(-1).to_numpy()[order]
        at = np.minimum(np.searchsorted(p, n), len(p) - 1)
        stays = (p[at] == n) & ~ends
        return p, n, ends, np.where(stays, at, np.arange(len(p))), stays

    def last(go: np.ndarray) -> np.ndarray:
        """The index each chain comes to last."""
        while True:
            far = go[go]
            if (far == go).all():
                return go
            go = far

    def table(t: pa.Table, schema: StructType, **columns: np.ndarray) -> pa.Table:
        rows = len(next(iter(columns.values())))
        own = [pa.repeat(t.column(k)[0], rows) for k in keys]
        return pa.table([*own, *(pa.array(c, pa.int64()) for c in columns.values())], names=schema.names)

    def exits(t: pa.Table) -> pa.Table:
        p, n, ends, go, _ = jumps(t)
        out = np.unique(last(go))
        return table(t, plain, _p=np.unique(n[out[~ends[out]]]))

    between = StructType([*plain.fields, StructField("_n", LongType())])

    def through(t: pa.Table, entered: pa.Table) -> pa.Table:
        if not t.num_rows or not entered.num_rows:
            return table(t if t.num_rows else entered, between, _p=np.zeros(0, np.int64), _n=np.zeros(0, np.int64))
        p, n, ends, go, _ = jumps(t)
        at = np.flatnonzero(np.isin(p, entered.column("_p").to_numpy()))
        out = last(go)[at]
        at, out = at[~ends[out]], out[~ends[out]]
        return table(t, between, _p=p[at], _n=n[out])

    def visited(t: pa.Table, entered: pa.Table) -> pa.Table:
        if not entered.num_rows:
            return table(t, plain, _p=np.zeros(0, np.int64))
        seen = set(entered.column("_p").to_pylist())
        if t.num_rows:
            p, _, _, go, stays = jumps(t)
            for i in np.flatnonzero(np.isin(p, entered.column("_p").to_numpy())).tolist():
                while stays[i]:
                    i = go[i]
                    seen.add(int(p[i]))
        return table(entered, plain, _p=np.array(sorted(seen), np.int64))

    first = steps.groupBy(*keys).agg(F.min("_p").alias("_p"))
    left = steps.groupBy(*grouped).applyInArrow(exits, plain)
    entries = checkpointed(first.unionByName(left).distinct().withColumn("_b", number("_p")))
    hops = steps.groupBy(*grouped).cogroup(entries.groupBy(*grouped)).applyInArrow(through, between)
    # A key whose chain never leaves its first block has no hop.
    chain = greedy_chain(hops, keys, "_p", "_n").unionByName(first).distinct().withColumn("_b", number("_p"))
    return steps.groupBy(*grouped).cogroup(chain.groupBy(*grouped)).applyInArrow(visited, plain).withColumnRenamed("_p", pos)
