"""Distance joins by grid cells.

A distance predicate alone would be a cross product. With cells at least as
wide as the radius, all neighbours of a point lie in the 3x3x3 block around its
cell, so the join becomes an equi-join on (group, cell) that Spark hashes,
sorts, spills and, when a cell is hot, splits by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, IntegerType, IntegralType, StringType, StructField,
                               StructType)

from ..functions.geometry import Vec, XYZ, cell
from ..functions.linalg import covariance, eigh3, moment_sums
from ..runtime import checkpointed, small_enough
from .octree import nearest_runs
from .scans import top_k
from .voxels import spread

# A hair more than the radius: floor() of a rounded quotient can then not skip a cell.
_SLACK = 1 + 1e-9
# Queries that one search may always hold, and pairs of a query and a support that it looks at at once.
QUERY_ROWS, PAIRS = 1 << 12, 1 << 18
# A block has two to this many cells a side; a search may hold this part of all queries, but so many queries and neighbours at most.
_SHIFT, _PART, MOST_ROWS, _MOST_KEPT = 2, 10, 1 << 16, 1 << 22
# Fewer pairs of a query and a support are all looked at.
_FEW_PAIRS = 1 << 14
# Cells by which a proximity is told apart first: so many distances wide, the largest index, and so many may be sent to all tasks.
_COARSE, _LAST_CELL, FEW_CELLS = 4, 1e15, 1 << 14


def _keyed(df: DataFrame, size: float, axes: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    names = ["_c" + a for a in axes]
    return df.withColumns({n: cell(a, size) for n, a in zip(names, axes)}), names


def _d2(axes: tuple[str, ...], left: str = "_q", right: str = "_s") -> Column:
    total = None
    for a in axes:
        d = F.col(left + a) - F.col(right + a)
        total = d * d if total is None else total + d * d
    return total


def radius_pairs(queries: DataFrame, supports: DataFrame, radius: float, by: list[str] = (),
                 q_id: str = "q_id", s_id: str = "s_id", axes: tuple[str, ...] = XYZ,
                 carry: list[str] = (), q_carry: list[str] = (),
                 explode: str = "query") -> DataFrame:
    """All (query, support) pairs of one group closer than ``radius`` (strictly).

    ``carry`` and ``q_carry`` name support and query columns to take along.
    ``explode`` picks the side that is copied to the 27 cells: the smaller one.
    """
    by, carry, q_carry = list(by), list(carry), list(q_carry)
    q = queries.select(*by, q_id, *q_carry, *(F.col(a).cast("double").alias("_q" + a) for a in axes))
    s = supports.select(*by, s_id, *carry, *(F.col(a).cast("double").alias("_s" + a) for a in axes))
    size = radius * _SLACK
    names = ["_c" + a for a in axes]
    q = q.withColumns({n: cell("_q" + a, size) for n, a in zip(names, axes)})
    s = s.withColumns({n: cell("_s" + a, size) for n, a in zip(names, axes)})
    if explode == "query":
        q = spread(q, names)
    else:
        s = spread(s, names)
    near = q.join(s, [*by, *names]).withColumn("d2", _d2(axes)).where(F.col("d2") < radius * radius)
    return near.select(*by, q_id, *q_carry, s_id, *carry, "d2")


def radius_neighbours(queries: DataFrame, supports: DataFrame, radius: float, by: list[str] = (),
                      q_id: str = "q_id", s_id: str = "s_id", limit: int | None = None,
                      **options) -> DataFrame:
    """Radius join with neighbours ranked by distance, equal distances by lowest id.

    ``limit`` keeps the nearest few of each query; the other pairs are dropped
    where they are found.
    """
    if limit is not None and limit <= 1000 and _plain(queries, by):
        return _searched(queries, supports, radius, list(by), q_id, s_id, limit, **options)
    pairs = radius_pairs(queries, supports, radius, by, q_id, s_id, **options)
    keys = [*by, q_id]
    if limit is not None:
        return top_k(pairs, keys, ["d2", s_id], limit)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("d2", s_id)))


def index_ordered_neighbours(queries: DataFrame, supports: DataFrame, radius: float,
                             by: list[str] = (), q_id: str = "q_id", s_id: str = "s_id") -> DataFrame:
    """Radius join whose neighbours are listed by support id, not by distance.

    All pairs are the result, but none is shuffled or sorted.
    """
    if _plain(queries, by):
        return _searched(queries, supports, radius, list(by), q_id, s_id)
    return _by_index(radius_pairs(queries, supports, radius, by, q_id, s_id), [*by, q_id], s_id)


def _by_index(pairs: DataFrame, keys: list[str], s_id: str) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(s_id)))


def _plain(queries: DataFrame, by: list[str]) -> bool:
    """Whether neighbouring rows of a batch can be told apart by the columns ``by``."""
    return all(isinstance(queries.schema[k].dataType, IntegralType | StringType | BooleanType | DateType) for k in by)


def _searched(queries: DataFrame, supports: DataFrame, radius: float, by: list[str], q_id: str, s_id: str,
              limit: int | None = None, axes: tuple[str, ...] = XYZ, carry: list[str] = (), q_carry: list[str] = (),
              explode: str = "support") -> DataFrame:
    """``radius_pairs`` with ``rank``: by support id, or the ``limit`` nearest by distance, then support id.

    Space is cut into blocks of 4 x 4 x 4 cells, and supports are copied to all blocks beside them (3.4 on average), so a
    query's neighbours come to the one place where it is, in the order of their ids. They are ranked there as they pass,
    and pairs are neither shuffled, sorted nor spilled. Blocks with too many queries for one search are halved down to single cells; the
    queries of still fuller cells are dealt to several searches, which get copies of the supports. As a search may hold a
    tenth of the queries, up to ``MOST_ROWS``, the copies of a support do not grow with the number of points until then.
    Queries whose id comes again are ranked together, by a window.
    """
    again = queries.groupBy(*by, q_id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    if not again.isEmpty():
        named = again.toDF(*(f"_k{i}" for i in range(len(by) + 1)))
        same = F.lit(True)
        for i, k in enumerate([*by, q_id]):
            same = same & queries[k].eqNullSafe(named[f"_k{i}"])
        pairs = radius_pairs(queries.join(named, same, "left_semi"), supports, radius, by, q_id, s_id, axes, carry, q_carry)
        together = top_k(pairs, [*by, q_id], ["d2", s_id], limit) if limit is not None else _by_index(pairs, [*by, q_id], s_id)
        queries = queries.join(named, same, "left_anti")

    # Names of the caller's columns are only used here and in the last step.
    size, cells_ = radius * _SLACK, ["_c" + a for a in axes]
    groups = [f"_by{i}" for i in range(len(by))]
    place = [*groups, *cells_]

    def side(df: DataFrame, row: list[str], name: str) -> DataFrame:
        points = df.select(*(F.col(k).alias(g) for k, g in zip(by, groups)), *(F.col(a).cast("double").alias("_p" + a) for a in axes),
                           F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(row))).alias(name))
        known = points.dropna(subset=[*groups, *("_p" + a for a in axes)])
        return known.withColumns({n: cell("_p" + a, size) for n, a in zip(cells_, axes)})

    blocks = ["_b" + a for a in axes]
    at_level = lambda shift: [F.shiftright(c, shift).alias(n) for c, n in zip(cells_, blocks)]
    asks = side(queries, [*by, q_id, *q_carry], "_ask")
    hits = side(supports, [s_id, *carry], "_hit")
    total, fullest = asks.groupBy(*groups, *at_level(_SHIFT)).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    most = max(QUERY_ROWS, min((total or 0) // _PART, MOST_ROWS))
    if limit is not None:
        most = max(1, min(most, _MOST_KEPT // max(limit, 1)))
    asks = asks.select("*", *at_level(_SHIFT), F.lit(_SHIFT).alias("_level"))
    hits = hits.withColumn("_level", F.lit(_SHIFT))
    for c, n in zip(cells_, blocks):
        hits = hits.withColumn(n, F.explode(F.sequence(F.shiftright(F.col(c) - 1, _SHIFT), F.shiftright(F.col(c) + 1, _SHIFT))))
    place = [*groups, "_level", *blocks]
    for shift in range(_SHIFT, -1, -1):
        # Very few blocks: each has more than ``most`` queries.
        full = asks.where(F.col("_level") == shift).groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("_of")).where("_of > 1") if (fullest or 0) > most else None
        rows = full.collect() if full is not None else []
        if not rows:
            break
        full = F.broadcast(asks.sparkSession.createDataFrame(rows, full.schema))
        asks, hits = asks.join(full, place, "left"), hits.join(full, place, "left")
        if shift == 0:
            break
        asks = asks.withColumns({n: F.when(F.col("_of") > 1, F.shiftright(c, shift - 1)).otherwise(F.col(n)) for c, n in zip(cells_, blocks)})
        for c, n in zip(cells_, blocks):
            inner = F.sequence(F.greatest(F.shiftright(F.col(c) - 1, shift - 1), 2 * F.col(n)), F.least(F.shiftright(F.col(c) + 1, shift - 1), 2 * F.col(n) + 1))
            hits = hits.withColumn(n, F.explode(F.when(F.col("_of") > 1, inner).otherwise(F.array(n))))
        deeper = F.when(F.col("_of") > 1, F.lit(shift - 1)).otherwise(F.col("_level"))
        asks, hits = asks.withColumn("_level", deeper).drop("_of"), hits.withColumn("_level", deeper).drop("_of")
    if "_of" not in asks.columns:
        asks, hits = asks.withColumn("_of", F.lit(1).cast("long")), hits.withColumn("_of", F.lit(1).cast("long"))
    of = F.coalesce("_of", F.lit(1).cast("long"))
    asks = asks.withColumn("_share", F.pmod(F.xxhash64("_ask"), of)).withColumn("_first", F.lit(True)).drop("_of", *cells_)
    hits = hits.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), of - 1))).withColumn("_first", F.lit(False)).drop("_of", *cells_)
    both = asks.unionByName(hits, allowMissingColumns=True)
    place = [*place, "_share"]
    # The work grows with the pairs, not with the bytes by which Spark would put partitions together.
    shuffles = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(4 * shuffles, (total or 0) >> 8), (total or 0) // MOST_ROWS)
    dealt = both.repartition(parts, *place).sortWithinPartitions(*place, F.desc("_first"), F.col("_hit.c0"))
    schema = StructType([dealt.schema["_ask"], dealt.schema["_hit"], StructField("d2", DoubleType()), StructField("rank", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, at = None, None
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            for k in place:
                c = b.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            new[:1] = at != tuple(b.column(k)[0].as_py() for k in place)
            at = tuple(b.column(k)[-1].as_py() for k in place)
            starts = np.flatnonzero(new)
            for a, z in zip([0, *starts], [*starts, b.num_rows]):
                if a in starts:
                    if search is not None:
                        yield from search.rest()
                    search = _Search(axes, size, radius * radius, limit, schema.names)
                if z > a:
                    yield from search.pairs(b.slice(a, z - a))
        if search is not None:
            yield from search.rest()

    found = dealt.mapInArrow(run, schema)
    n = len(by)
    out = found.select(*(F.col(f"_ask.c{i}").alias(k) for i, k in enumerate([*by, q_id, *q_carry])),
                       *(F.col(f"_hit.c{i}").alias(k) for i, k in enumerate([s_id, *carry])), "d2", "rank")
    return out if again.isEmpty() else out.unionByName(together)


class _Search:
    """The neighbours of the queries of one block among supports that come in the order of their ids."""

    def __init__(self, axes: tuple[str, ...], size: float, reach: float, limit: int | None, names: list[str]):
        self.axes, self.size, self.reach, self.limit, self.names = axes, size, reach, limit, names
        self.held: list[pa.RecordBatch] = []
        self.points: list[np.ndarray] | None = None

    def pairs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Takes queries, which come first, or looks at supports; the pairs that are known to be part of the result."""
        n = int(b.column("_first").to_numpy(zero_copy_only=False).sum())
        if n:
            self.held.append(b.slice(0, n))
        if n == b.num_rows or not (self.held or self.points):
            return
        if self.points is None:
            points = [np.concatenate([h.column("_p" + a).to_numpy() for h in self.held]) for a in self.axes]
            cells_ = [np.floor(p / self.size) for p in points]
            order = np.lexsort(cells_)
            self.points, cells_ = [p[order] for p in points], [c[order] for c in cells_]
            self.asks = pa.concat_arrays([h.column("_ask") for h in self.held]).take(pa.array(order))
            # Queries of one cell are beside each other.
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cells_], axis=0)
            starts = np.flatnonzero(new)
            self.cells = [(a, z, [c[a] for c in cells_]) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])]
            self.seen = np.zeros(len(self.asks), np.int64)
            if self.limit is not None:
                self.best = np.full((len(self.asks), self.limit), np.inf)
                self.which = np.full((len(self.asks), self.limit), -1)
                self.hits = b.column("_hit").slice(0, 0)
            self.held.clear()
        b = b.slice(n)
        own, hits = [b.column("_p" + a).to_numpy() for a in self.axes], b.column("_hit")
        for first, last, sel in self._beside(own):
            yield from self._look(first, last, [s[sel] for s in own], hits, sel)
        if self.limit is not None:
            used, to = np.unique(self.which, return_inverse=True)
            free = int(used[0] < 0)
            self.hits = pa.concat_arrays([self.hits, hits]).take(pa.array(used[free:]))
            self.which = to.reshape(self.which.shape) - free

    def _beside(self, own: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Queries of a cell, and the supports in that cell and beside it."""
        if len(self.asks) * len(own[0]) <= _FEW_PAIRS:
            yield 0, len(self.asks), np.arange(len(own[0]))
            return
        cells_ = [np.floor(s / self.size) for s in own]
        for first, last, at in self.cells:
            near = np.ones(len(own[0]), bool)
            for c, k in zip(cells_, at):
                near &= np.abs(c - k) <= 1
            sel = np.flatnonzero(near)
            if len(sel):
                yield first, last, sel

    def _look(self, first: int, last: int, own: list[np.ndarray], hits: pa.Array, sel: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // len(sel))
        for a in range(first, last, step):
            z, d2 = min(a + step, last), None
            for q, s in zip(self.points, own):
                d = q[a:z, None] - s[None, :]
                d2 = d * d if d2 is None else d2 + d * d
            near = d2 < (self.reach if self.limit is None else np.minimum(self.best[a:z, -1:], self.reach))
            row, at = np.nonzero(near)
            if not len(row):
                continue
            if self.limit is None:
                many = near.sum(axis=1)
                rank = self.seen[a + row] + np.arange(len(row)) - (np.cumsum(many) - many)[row] + 1
                self.seen[a:z] += many
                yield self._rows(a + row, hits.take(pa.array(sel[at])), d2[near], rank)
            else:
                self._keep(a, z, row, d2[near], sel[at] + len(self.hits))

    def _keep(self, a: int, z: int, row: np.ndarray, d2: np.ndarray, at: np.ndarray) -> None:
        """The best ones of queries ``a`` to ``z``, with those at ``row``; later supports have larger ids."""
        old_row, old_place = np.nonzero(self.which[a:z] >= 0)
        row = np.concatenate([old_row, row])
        d2 = np.concatenate([self.best[a:z][old_row, old_place], d2])
        at = np.concatenate([self.which[a:z][old_row, old_place], at])
        order = np.lexsort((at, d2, row))
        row, d2, at = row[order], d2[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.limit
        self.best[a + row[kept], place[kept]], self.which[a + row[kept], place[kept]] = d2[kept], at[kept]

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The pairs that were only known to be part of the result when all supports had been seen."""
        if self.points is None or self.limit is None:
            return
        row, place = np.nonzero(self.which >= 0)
        yield self._rows(row, self.hits.take(pa.array(self.which[row, place])), self.best[row, place], place + 1)

    def _rows(self, row: np.ndarray, hits: pa.Array, d2: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.asks.take(pa.array(row)), hits, pa.array(d2), pa.array(rank, pa.int32())], names=self.names)


# --- nearest neighbour -------------------------------------------------------

def nearest_join(queries: DataFrame, supports: DataFrame, by: list[str] = (), q_id: str = "q_id",
                 s_id: str = "s_id", carry: list[str] = (), axes: tuple[str, ...] = XYZ,
                 max_distance: float | None = None) -> DataFrame:
    """Exact nearest support of every query: ``s_id``, ``carry`` columns and ``d2``.

    Ties go to the lowest support id. Queries without any support in their
    group (or within ``max_distance``, inclusive), and those with a coordinate
    that is null or not a number, get NULLs; such supports, and supports with a
    null in ``by``, are left out. Query ids may repeat.
    """
    return nearest_runs(queries, supports, list(by), q_id, s_id, list(carry), tuple(axes), max_distance)


def transfer_labels(points: DataFrame, labelled: DataFrame, labels: list[str], by: list[str] = (),
                    point_id: str = "id", labelled_id: str = "id", **options) -> DataFrame:
    """Give every point the labels of its nearest labelled point."""
    labelled = labelled.withColumnRenamed(labelled_id, "_near") if labelled_id != "_near" else labelled
    hit = nearest_join(points, labelled, by, point_id, "_near", carry=labels, **options)
    return points.join(hit.drop("_near", "d2"), [*by, point_id])


def proximity(candidates: DataFrame, others: DataFrame, distance: float, keep: str = "far",
              by: list[str] = (), c_id: str = "id", axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Candidates whose nearest other point is farther (``far``) or nearer (``near``) than ``distance``.

    A nearest point at exactly ``distance`` satisfies neither.
    """
    by, axes = list(by), tuple(axes)
    spots = others.select(*by, *axes).withColumn("_o", F.lit(0))
    asking, apart = candidates.select(*by, c_id, *axes), None
    if distance > 0:
        asking, apart, spots = _contested(asking, spots, distance, by, axes)
    hit = nearest_join(asking, spots, by, c_id, "_o", axes=axes,
                       max_distance=distance).select(*by, c_id, "d2")
    if keep == "near":
        return candidates.join(hit.where(F.col("d2") < distance * distance).drop("d2"), [*by, c_id])
    far = hit.where(F.col("d2").isNull()).drop("d2")
    return candidates.join(far if apart is None else far.unionByName(apart.select(*by, c_id)), [*by, c_id])


def _contested(candidates: DataFrame, others: DataFrame, distance: float, by: list[str],
               axes: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates whose cell has another point in or beside it, the other candidates, and the points beside such cells.

    Cells are wider than ``distance``, so what is left out is farther than that from everything. Of either
    side only its occupied cells are shuffled, unless very many cells are contested.
    """
    size, names = _COARSE * distance, ["_c" + a for a in axes]

    def placed(df: DataFrame) -> DataFrame:
        # Cells beyond the largest ones are one, which leaves out less.
        ends = (F.lit(-_LAST_CELL), F.lit(_LAST_CELL))
        return df.withColumns({n: F.floor(F.least(F.greatest(F.col(a).cast("double") / F.lit(size), ends[0]), ends[1])).cast("long") for n, a in zip(names, axes)})

    key = [*by, *names]
    asking, spots = placed(candidates), placed(others)
    beside = spread(spots.select(*key).distinct(), names)
    cells_ = checkpointed(asking.select(*key).distinct().join(beside, key, "left_semi"))
    around = spread(cells_, names).distinct()
    if small_enough(cells_, FEW_CELLS):
        cells_, around = F.broadcast(cells_), F.broadcast(around)
    near = checkpointed(asking.join(cells_, key, "left_semi").drop(*names))
    return near, asking.join(cells_, key, "left_anti").drop(*names), checkpointed(spots.join(around, key, "left_semi").drop(*names))


def still_points(points: DataFrame, margin: float = 0.1, non_still: DataFrame | None = None,
                 count: str = "count", by: list[str] = (), p_id: str = "id") -> DataFrame:
    """Points that re-project onto the still part of a map.

    Old-map points (count below -0.5) and new points within ``margin`` of one;
    of these, none that is within ``margin`` of a point outside the set.
    """
    old = points.where(F.col(count) < -0.5)
    new = points.where(F.col(count) >= -0.5)
    near_old = proximity(new, old, margin, "near", by, p_id)
    still = old.unionByName(near_old.select(*old.columns))
    rest = points.join(still.select(*by, p_id), [*by, p_id], "left_anti") if non_still is None else non_still
    return proximity(still, rest, margin, "far", by, p_id)


# --- pooling -----------------------------------------------------------------


def pool(queries: DataFrame, supports: DataFrame, radius: float, features: list[str],
         how: str = "max", by: list[str] = (), q_id: str = "q_id", s_id: str = "s_id",
         shadow_zero: bool = False) -> DataFrame:
    """Maximum or mean of support features around each query.

    Copies at one position are merged before the join. With ``shadow_zero`` the
    neighbour lists count as padded with zeros to the longest list of the whole
    input, which is what a dense neighbour matrix does.
    """
    by = list(by)
    spot = [*by, *XYZ]
    merged = supports.groupBy(*spot).agg(
        F.min(s_id).alias(s_id), F.count(F.lit(1)).alias("_w"),
        *(F.sum(f).alias("_sum_" + f) for f in features),
        *(F.max(f).alias("_max_" + f) for f in features))
    taken = ["_w", *("_sum_" + f for f in features), *("_max_" + f for f in features)]
    pairs = radius_pairs(queries, merged, radius, by, q_id, s_id, carry=taken)
    out = pairs.groupBy(*by, q_id).agg(
        F.sum("_w").alias("n"),
        *(F.sum("_sum_" + f).alias("_sum_" + f) for f in features),
        *(F.max("_max_" + f).alias("_max_" + f) for f in features))
    out = queries.select(*by, q_id).join(out, [*by, q_id], "left").fillna(0, ["n"])
    width = F.col("n")
    if shadow_zero:
        widest = out.agg(F.max("n").alias("_width")).withColumn("_k", F.lit(0))
        out = out.withColumn("_k", F.lit(0)).join(F.broadcast(widest), "_k").drop("_k")
        width = F.col("_width")
    pooled = {}
    for f in features:
        if how == "max":
            v = F.coalesce(F.col("_max_" + f).cast("double"), F.lit(0.0))
            if shadow_zero:
                v = F.when(F.col("n") < width, F.greatest(v, F.lit(0.0))).otherwise(v)
        else:
            v = F.when(width > 0, F.coalesce(F.col("_sum_" + f), F.lit(0.0)) / width).otherwise(0.0)
        pooled[f] = v
    return out.select(*by, q_id, "n", *(v.alias(f) for f, v in pooled.items()))


def closest_pool(queries: DataFrame, supports: DataFrame, radius: float, features: list[str],
                 by: list[str] = (), q_id: str = "q_id", s_id: str = "s_id") -> DataFrame:
    """Features of the closest support within ``radius``; zero where there is none."""
    hit = nearest_join(queries, supports, by, q_id, s_id, carry=features, max_distance=radius)
    inside = F.col("d2") < radius * radius
    return hit.select(*by, q_id, *(F.when(inside, F.col(f)).otherwise(F.lit(0)).alias(f) for f in features))


def grid_pool_indices(points: DataFrame, half_width: float, dl: float, by: list[str] = (),
                      p_id: str = "id", limit: int = 20) -> DataFrame:
    """For each node of a square grid the up to ``limit`` nearest points within dl/sqrt(2).

    Nodes are at -half_width + k dl. The nodes near a point are computed from its
    coordinates, so neither the grid nor a join is needed; nodes without a
    point simply have no row.
    """
    pairs = grid_node_pairs(points, half_width, dl, by, [p_id])
    return top_k(pairs, [*by, "px", "py"], ["d2", p_id], limit)


def grid_side(half_width: float, dl: float) -> int:
    return max(0, math.ceil(2 * half_width / dl - 1e-9))


def grid_node_pairs(points: DataFrame, half_width: float, dl: float, by: list[str] = (),
                    carry: list[str] = ()) -> DataFrame:
    """(node, point) pairs closer than dl/sqrt(2), with ``px``, ``py`` the node indices."""
    side = grid_side(half_width, dl)
    reach2 = dl * dl / 2

    def nearby(axis: str) -> Column:
        at = F.floor((F.col(axis) + half_width) / dl).cast("int")
        return F.explode(F.sequence(at - 1, at + 2))

    grid = points.withColumn("px", nearby("x")).where(F.col("px").between(0, side - 1))
    grid = grid.withColumn("py", nearby("y")).where(F.col("py").between(0, side - 1))
    dx = F.col("x") - (F.col("px") * dl - half_width)
    dy = F.col("y") - (F.col("py") * dl - half_width)
    return (grid.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < reach2)
            .select(*by, "px", "py", *carry, "d2"))


def neighbourhood_moments(queries: DataFrame, supports: DataFrame, radius: float,
                          by: list[str] = (), q_id: str = "q_id", s_id: str = "s_id") -> DataFrame:
    """Ten moment sums of the supports around each query, taken relative to the query.

    Relative coordinates keep the sums well conditioned far from the origin.
    """
    by = list(by)
    merged = supports.groupBy(*by, *XYZ).agg(F.min(s_id).alias(s_id), F.count(F.lit(1)).alias("_w"))
    merged = merged.select(*by, s_id, "_w", *XYZ, *(F.col(a).alias("_n" + a) for a in XYZ))
    origin = queries.select("*", *(F.col(a).alias("_o" + a) for a in XYZ))
    pairs = radius_pairs(origin, merged, radius, by, q_id, s_id,
                         carry=["_w", *("_n" + a for a in XYZ)], q_carry=["_o" + a for a in XYZ])
    rel = Vec(*(F.col("_n" + a) - F.col("_o" + a) for a in XYZ))
    return pairs.groupBy(*by, q_id).agg(*moment_sums(rel, F.col("_w").cast("double")))


def neighbourhood_frames(queries: DataFrame, supports: DataFrame, radius: float, by: list[str] = (),
                         q_id: str = "q_id", s_id: str = "s_id", strict: bool = True) -> DataFrame:
    """Right-handed PCA frame of each neighbourhood.

    Axes follow ascending eigenvalues of the scatter matrix; the first two point
    away from the neighbourhood's centroid as seen from the query, the third is
    their cross product. A query without neighbours is an error unless
    ``strict`` is off.
    """
    by = list(by)
    m = neighbourhood_moments(queries, supports, radius, by, q_id, s_id)
    m = queries.select(*by, q_id, *XYZ).join(m, [*by, q_id], "left")
    if strict:
        lonely = F.raise_error(F.lit("a query has no neighbour"))
        m = m.withColumn("n", F.when(F.col("n").isNull(), lonely.cast("double")).otherwise(F.col("n")))
    m = m.withColumn("_e", eigh3(*covariance(divide=False)))
    centre = Vec(F.col("sx") / F.col("n"), F.col("sy") / F.col("n"), F.col("sz") / F.col("n"))
    axes = []
    for letter in "uv":
        axis = Vec(*(F.col("_e")[letter + a] for a in XYZ))
        flip = F.when(axis.dot(centre) < 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        axes.append(axis.times(flip))
    third = axes[0].cross(axes[1])
    named = {f"{letter}{a}": c for letter, axis in zip("uvw", (*axes, third)) for a, c in zip(XYZ, axis)}
    return m.select(*by, q_id, "n", *(F.col("_e")[k].alias(k) for k in ("l0", "l1", "l2")),
                    *(c.alias(n) for n, c in named.items()),
                    *((F.col(a) + c).alias("c" + a) for a, c in zip(XYZ, centre)))


# --- calibration of neighbour counts -----------------------------------------


def neighbour_limit(queries: DataFrame, supports: DataFrame, radius: float, by: list[str] = (),
                    q_id: str = "q_id", s_id: str = "s_id", keep: float = 0.9) -> DataFrame:
    """Number of histogram bins of neighbour counts whose running total stays under ``keep``."""
    counts = pool(queries, supports, radius, [], "max", by, q_id, s_id).select("n")
    return histogram_limit(counts, "n", keep)


def histogram_limit(counts: DataFrame, n: str, keep: float = 0.9) -> DataFrame:
    """Bins 0..max are dense, so the limit counts empty bins too.

    With sorted values the first bin whose running total reaches the share is
    the (exclusive) limit itself; only the distinct counts go through a window.
    """
    hist = counts.groupBy(F.col(n).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    run = hist.withColumns({"cum": F.sum("c").over(w), "total": F.sum("c").over(total)})
    return run.agg(F.min(F.when(F.col("cum") >= keep * F.col("total"), F.col("bin"))).alias("bin_limit"),
                   F.max("total").alias("total"))


def size_limit(groups: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Percentile of group sizes with linear interpolation."""
    sizes = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.percentile("n", share).alias("size_limit"))
