"""Nearest neighbours over a linear octree.

Supports and queries are put in the order of their Morton codes, which is the
order of the leaves of an octree, and cut into runs of bounded length. Only runs
are ever shuffled together: a query is sent to the runs whose box may hold
something nearer than what its neighbours in the order already bound. Within a
run the tree's cells are split while they are too full, so a crowded corner is
refined and an empty one is not. No step depends on one cell size for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from ..functions.geometry import XYZ
from ..runtime import checkpointed

# Bits of a cell index along each axis; masks that put two zeros after each of them (fixed values).
_BITS = 20
_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
# Rows of a run, and how many runs there may be: beyond that runs grow, so that their boxes stay a table of bounded size.
RUN_ROWS, MOST_RUNS = 1 << 15, 1 << 16
# A cell with more points is split; a box of the tree above the leaves has so many children.
LEAF, FAN = 32, 8
# Rows of a partition in the Morton order, and pairs of a query and a box, or of a query and a point, held at once.
PART_ROWS, WIDE = 1 << 18, 1 << 18
# Queries searched at once, and neighbours in the order that give a first bound, to each side.
_BATCH, _SIDE = 2048, 4


def morton(axes: list[Column]) -> Column:
    """One number whose bits are those of the (at most three) cell indices in turn."""
    code = None
    for place, c in enumerate(axes):
        for shift, mask in _STEPS:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        c = F.shiftleft(c, place)
        code = c if code is None else code.bitwiseOR(c)
    return code


class BoxTree:
    """Boxes in Morton order under boxes of ``FAN`` consecutive ones; ``g0`` to ``g1`` is the range of a box's groups."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, g0: np.ndarray, g1: np.ndarray):
        self.levels = [(lo, hi, g0, g1)]
        while len(lo) > FAN:
            at = np.arange(0, len(lo), FAN)
            lo, hi, g0, g1 = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(g0, at), np.maximum.reduceat(g1, at)
            self.levels.append((lo, hi, g0, g1))

    def slices(self, p: np.ndarray, g: np.ndarray, bound: np.ndarray, first: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``within`` for consecutive stretches of the queries, halved until about ``WIDE`` pairs are held; each with its first query."""
        found = self.within(p, g, bound, WIDE if len(p) > 1 else None)
        if found is not None:
            yield first, *found
            return
        half = len(p) // 2
        yield from self.slices(p[:half], g[:half], bound[:half], first)
        yield from self.slices(p[half:], g[half:], bound[half:], first + half)

    def within(self, p: np.ndarray, g: np.ndarray, bound: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """``(query, box)`` pairs in the order of queries that may hold a point of the query's group within ``bound``, and the bound.

        ``bound`` is a squared distance; a box of the one group lowers it to its farthest corner.
        None if more than ``most`` pairs would have to be held.
        """
        bound = bound.copy()
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(p)), top), np.tile(np.arange(top), len(p))
        for depth in range(len(self.levels) - 1, -1, -1):
            lo, hi, g0, g1 = self.levels[depth]
            if depth < len(self.levels) - 1:
                if most is not None and len(q) * FAN > most:
                    return None
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(lo)
                q, node = q[there], node[there]
            mine = (g0[node] <= g[q]) & (g[q] <= g1[node])
            q, node = q[mine], node[mine]
            below, above = lo[node] - p[q], p[q] - hi[node]
            low = _squares(np.maximum(np.maximum(below, above), 0.0))
            near = low <= bound[q]
            q, node, low = q[near], node[near], low[near]
            pure = g0[node] == g1[node]
            np.minimum.at(bound, q[pure], _squares(np.maximum(np.abs(below[near][pure]), np.abs(above[near][pure]))))
            near = low <= bound[q]
            q, node = q[near], node[near]
        return q, node, bound


def _squares(d: np.ndarray) -> np.ndarray:
    total = d[:, 0] * d[:, 0]
    for k in range(1, d.shape[1]):
        total = total + d[:, k] * d[:, k]
    return total


def _groups(tables: list[pa.Table], by: list[str]) -> list[np.ndarray]:
    """Group numbers of the rows of ``tables``, equal exactly where all columns ``by`` are."""
    sizes = np.cumsum([0, *(t.num_rows for t in tables)])
    number = np.zeros(sizes[-1], np.int64)
    for k in by:
        codes = pa.concat_arrays([c for t in tables for c in t.column(k).chunks] or [pa.array([], tables[0].schema.field(k).type)]).dictionary_encode().indices
        _, number = np.unique(number * (len(codes) + 2) + codes.fill_null(-1).to_numpy(zero_copy_only=False) + 1, return_inverse=True)
    return [number[a:b] for a, b in zip(sizes[:-1], sizes[1:])]


def leaves(code: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where the leaves start in points sorted by group and code.

    A cell is full if the code ``LEAF`` places on is still in it. A point's leaf
    is the child of the smallest full cell around it.
    """
    n = len(code)
    if n <= LEAF:
        return np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    # Levels that two codes share, from the highest bit in which they differ; -1 across groups.
    differ = (code[LEAF:] ^ code[:-LEAF]).astype(np.float64)
    shared = np.where(differ > 0, _BITS - 1 - (np.frexp(np.maximum(differ, 1.0))[1] - 1) // 3, _BITS)
    shared = np.where(group[LEAF:] == group[:-LEAF], shared, -1)
    wide = np.concatenate([np.full(LEAF, -1), shared, np.full(LEAF, -1)])
    level = np.minimum(np.lib.stride_tricks.sliding_window_view(wide, LEAF + 1).max(axis=1) + 1, _BITS)
    key = code >> (3 * (_BITS - level))
    new = (np.diff(key, prepend=-1) != 0) | (np.diff(level, prepend=-1) != 0) | (np.diff(group, prepend=group[:1] - 1) != 0)
    return np.flatnonzero(new)


def _points(t: pa.Table) -> np.ndarray:
    return np.column_stack([t.column("_p" + a).to_numpy() for a in XYZ])


def _in_order(both: DataFrame, by: list[str], rows: int, parts: int | None = None) -> DataFrame:
    """The rows in Morton order with ``_run``, and for queries the squared distance ``_bound`` to a support nearby in the order.

    Supports and queries are numbered apart, about ``rows`` of either to a run, so that many queries among few
    supports, or few among many, make no more runs than they must.

    Copies of a support in one run are left out but for the lowest id, which comes first. ``_asker`` is the ``_row`` of
    the query that asks for all queries at its place of one run.
    """
    schema = StructType(both.schema.fields).add("_run", "long").add("_bound", "double").add("_asker", "long")

    def place(t: pa.Table, run: int, chunk: int) -> pa.Table:
        p, asks, (group,) = _points(t), t.column("_asks").to_numpy(), _groups([t], by)
        s = np.flatnonzero(~asks)
        copy = np.zeros(len(asks), bool)
        copy[s[1:]] = (p[s[1:]] == p[s[:-1]]).all(axis=1) & (group[s[1:]] == group[s[:-1]])
        s, q = s[~copy[s]], np.flatnonzero(asks)
        bound = np.full(len(asks), np.inf)
        if len(s):
            at = np.searchsorted(s, q)
            for k in range(-_SIDE, _SIDE):
                other = s[np.clip(at + k, 0, len(s) - 1)]
                bound[q] = np.fmin(bound[q], np.where(group[other] == group[q], _squares(p[other] - p[q]), np.inf))
        new = np.ones(len(q), bool)
        new[1:] = (p[q[1:]] != p[q[:-1]]).any(axis=1) | (group[q[1:]] != group[q[:-1]])
        asker = np.zeros(len(asks), np.int64)
        asker[q] = t.column("_row").to_numpy(zero_copy_only=False)[q[new]].astype(np.int64)[np.cumsum(new) - 1] if len(q) else 0
        out = t.append_column("_run", pa.array(np.where(asks, chunk, run))).append_column("_bound", pa.array(bound)).append_column("_asker", pa.array(asker))
        return out.filter(pa.array(~copy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, number, count = [], [first, first], [0, 0]

        def flush() -> pa.Table:
            out = place(pa.Table.from_batches(held), *number)
            queries = int(out.column("_asks").to_numpy().sum())
            for k, n in enumerate((out.num_rows - queries, queries)):
                count[k] += n
                if count[k] >= rows:
                    number[k], count[k] = number[k] + 1, 0
            held.clear()
            return out

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= rows:
                yield from flush().to_batches(10_000)
        if held:
            yield from flush().to_batches(10_000)

    keys = ["_g", "_code", "_fine", *("_p" + a for a in XYZ), "_first", "_row"]
    spread = both.repartitionByRange(*keys) if parts is None else both.repartitionByRange(parts, *keys)
    return spread.sortWithinPartitions(*keys).mapInArrow(run, schema)


def nearest_runs(queries: DataFrame, supports: DataFrame, by: list[str], q_id: str, s_id: str, carry: list[str],
                 axes: tuple[str, ...], max_distance: float | None) -> DataFrame:
    """See ``neighbors.nearest_join``."""
    point = {"_p" + a: F.col(a).cast("double") if a in axes else F.lit(0.0) for a in XYZ}
    hash_ = F.xxhash64(*by) if by else F.lit(0).cast("long")
    # Names of the caller's columns are only used here and in the last step.
    groups = {f"_by{i}": F.col(k) for i, k in enumerate(by)}
    hit = F.struct(F.col(s_id).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    known = F.lit(True)
    for c in [*point.values(), *groups.values()]:
        known = known & c.isNotNull()
    s = supports.where(known).select(*(c.alias(n) for n, c in (groups | point).items()), hash_.alias("_g"), F.lit(False).alias("_asks"), hit.alias("_hit"))
    for a in XYZ:
        s = s.where(~F.isnan("_p" + a))
    q = queries.select(*(F.coalesce(c, F.lit(float("nan"))).alias(n) if n in point else c.alias(n) for n, c in (groups | point).items()),
                       hash_.alias("_g"), F.lit(True).alias("_asks"), F.col(q_id).alias("_ask"), F.monotonically_increasing_id().alias("_row"))
    both = s.unionByName(q, allowMissingColumns=True)
    finite = F.when(~F.isnan("_px") & ~F.isnan("_py") & ~F.isnan("_pz"), F.lit(True))
    ends = both.agg(F.count(F.lit(1)).alias("n"), *(f(F.when(finite, F.col("_p" + a))).alias(w + a) for a in XYZ for w, f in (("lo", F.min), ("hi", F.max)))).first()
    size = max((ends["hi" + a] - ends["lo" + a] for a in XYZ if ends["lo" + a] is not None), default=0.0) / (1 << _BITS) or 1.0
    places = [(F.col("_p" + a) - (ends["lo" + a] or 0.0)) / size for a in XYZ]
    last = F.lit((1 << _BITS) - 1)
    cells = [F.least(F.floor(c).cast("long"), last) for c in places]
    # The place within a cell, so that the order of a crowd in few cells is that of a tree too.
    within = [F.least(F.floor((c - F.floor(c)) * (1 << _BITS)).cast("long"), last) for c in places]
    both = both.withColumns({"_code": F.coalesce(morton(cells), F.lit(0).cast("long")), "_fine": F.coalesce(morton(within), F.lit(0).cast("long")), "_first": F.col("_hit.id")})
    names = list(groups)
    # The memory of a task that sorts does not grow with the tables: there are more tasks.
    parts = -(-ends["n"] // PART_ROWS)
    parts = parts if parts > int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    placed = checkpointed(_in_order(both, names, max(RUN_ROWS, ends["n"] // MOST_RUNS), parts))

    asked, held = placed.where("_asks"), placed.where("not _asks")
    corners = [f("_p" + a).alias(w + a) for w, f in (("lo", F.min), ("hi", F.max)) for a in XYZ]
    # One row a run, so at most about MOST_RUNS of them and one a partition.
    runs = held.groupBy("_run").agg(*corners, F.min("_g").alias("g0"), F.max("_g").alias("g1")).orderBy("_run").toPandas()
    if not len(runs):
        return _answers(asked, None, by, q_id, s_id, carry, supports)
    tree = (runs["_run"].to_numpy(), BoxTree(*(runs[[w + a for a in XYZ]].to_numpy() for w in ("lo", "hi")), runs["g0"].to_numpy(), runs["g1"].to_numpy()))
    shared = placed.sparkSession.sparkContext.broadcast(tree)
    most = float("inf") if max_distance is None else max_distance * max_distance
    sent = StructType([f for f in asked.schema if f.name in (*names, "_px", "_py", "_pz", "_row", "_bound", "_g")]).add("_chunk", LongType()).add("_run", LongType())
    wire = sent.names

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, boxes = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, _BATCH):
                t = pa.Table.from_batches([whole.slice(a, _BATCH)])
                for first, at, box, bound in boxes.slices(_points(t), t.column("_g").to_numpy(), np.minimum(t.column("_bound").to_numpy(), most)):
                    own = t.slice(first, len(bound))
                    own = own.set_column(own.schema.get_field_index("_bound"), "_bound", pa.array(bound)).take(pa.array(at))
                    yield from own.append_column("_run", pa.array(number[box])).select(wire).to_batches()

    asking = asked.where("_row = _asker and not (isnan(_px) or isnan(_py) or isnan(_pz))").withColumnRenamed("_run", "_chunk").select(*wire[:-1])
    routed = checkpointed(asking.mapInArrow(route, sent))
    # A run is copied to every chunk of queries that asks it, so neither side of a group exceeds a run.
    pairs = routed.select("_run", F.col("_chunk").alias("_for")).distinct()
    copies = held.select(*names, "_px", "_py", "_pz", "_code", "_fine", "_hit", "_run").join(pairs, "_run")
    found = StructType([f for f in routed.schema if f.name == "_row"]).add("_d2", "double").add(held.schema["_hit"])
    result = to_arrow_schema(found)

    def search(own: pa.Table, asks: pa.Table) -> pa.Table:
        if not own.num_rows or not asks.num_rows:
            return result.empty_table()
        group, wanted = _groups([own, asks], names)
        order = np.lexsort((own.column("_fine").to_numpy(), own.column("_code").to_numpy(), group))
        p, group = _points(own)[order], group[order]
        # The smallest cells may still be crowded; within them the order goes on.
        starts = leaves(own.column("_code").to_numpy()[order], group)
        place = np.arange(len(p)) - np.repeat(starts, np.diff(starts, append=len(p)))
        starts = np.flatnonzero(place % LEAF == 0)
        sizes = np.diff(starts, append=len(p))
        boxes = BoxTree(np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts), group[starts], group[starts])
        asked_at, limit = _points(asks), asks.column("_bound").to_numpy()
        rows, best, hits = [], [], []
        for a in range(0, len(asked_at), _BATCH):
            one = asked_at[a:a + _BATCH]
            for first, at_leaf, leaf, bound in boxes.slices(one, wanted[a:a + _BATCH], limit[a:a + _BATCH]):
                for low in range(0, len(leaf), WIDE // LEAF):
                    box = leaf[low:low + WIDE // LEAF]
                    many = sizes[box]
                    at = np.repeat(at_leaf[low:low + WIDE // LEAF], many)
                    member = np.repeat(starts[box] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    d2 = _squares(one[at + first] - p[member])
                    np.minimum.at(bound, at, d2)
                    least = d2 == bound[at]
                    rows.append(at[least] + first + a)
                    best.append(d2[least])
                    hits.append(order[member[least]])
        if not rows:
            return result.empty_table()
        rows, hits = np.concatenate(rows), np.concatenate(hits)
        return pa.table([asks.column("_row").take(pa.array(rows)), pa.array(np.concatenate(best)), own.column("_hit").take(pa.array(hits))], names=result.names)

    hits = copies.groupBy("_run", "_for").cogroup(routed.groupBy("_run", "_chunk")).applyInArrow(search, found)
    return _answers(asked, hits, by, q_id, s_id, carry, supports)


def _answers(asked: DataFrame, hits: DataFrame | None, by: list[str], q_id: str, s_id: str, carry: list[str], supports: DataFrame) -> DataFrame:
    """One row for each query: the nearest of its hits, equal distances by lowest id; nulls without any."""
    base = asked.select("_asker", F.struct(*(f"_by{i}" for i in range(len(by))), "_ask").alias("_base"))
    if hits is None:
        none = [F.lit(None).cast(supports.schema[c].dataType).alias(c) for c in (s_id, *carry)]
        return base.select(*(F.col(f"_base._by{i}").alias(k) for i, k in enumerate(by)), F.col("_base._ask").alias(q_id), *none, F.lit(None).cast("double").alias("d2"))
    order = F.struct(F.col("_d2"), F.col("_hit.id"))
    found = hits.groupBy("_row").agg(F.min_by(F.struct("_d2", "_hit"), order).alias("_best")).withColumnRenamed("_row", "_asker")
    best = base.join(found, "_asker", "left")
    return best.select(*(F.col(f"_base._by{i}").alias(k) for i, k in enumerate(by)), F.col("_base._ask").alias(q_id), F.col("_best._hit.id").alias(s_id),
                       *(F.col(f"_best._hit.c{i}").alias(c) for i, c in enumerate(carry)), F.col("_best._d2").alias("d2"))
