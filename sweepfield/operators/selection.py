"""Values by rank without sorting all of them.

A histogram over the interval that holds a rank says which bucket holds it; the
bucket's own least and greatest value are the next interval. A pass counts at
most ``_BUCKETS`` + 2 buckets for each rank asked, combined before the shuffle,
so a group with a third of all rows costs no task more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed

_BUCKETS = 1024
# An interval of so many values or fewer is put into one array and looked at.
LEFT = 4096


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: Column) -> DataFrame:
    """``rank, value`` for each group: the values at places ``ranks`` (from 0) in ascending order.

    ``ranks`` is an array over the column ``n``, the group's number of values;
    ranks outside it give no row. Nulls and NaN are no values; rows with a null
    in ``by`` belong to no group.
    """
    by = list(by)
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)").dropna(subset=by or None, how="any")
    whole = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = whole.where("n > 0").withColumn("rank", F.explode(F.array_distinct(ranks).cast("array<bigint>"))).where("rank >= 0 and rank < n")
    state = checkpointed(asked.select(*by, "rank", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_in"), "_lo", "_hi"))

    def members(intervals: DataFrame) -> DataFrame:
        # No key: the intervals are a row for each rank, and there are few.
        met = v.join(intervals, by) if by else v.join(F.broadcast(intervals))
        return met.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    while True:
        wide = (F.col("_in") > LEFT) & (F.col("_lo") < F.col("_hi"))
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        # Divided before the difference, which could overflow; the ends are buckets of their own, so every pass narrows.
        width = F.col("_hi") / _BUCKETS - F.col("_lo") / _BUCKETS
        inner = F.coalesce(F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(_BUCKETS - 1)), F.lit(0))
        bucket = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), _BUCKETS).otherwise(inner)
        counted = (members(open_).groupBy(*by, "rank", "_below", bucket.alias("_bucket"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        before = Window.partitionBy(*by, "rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        at = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = at.where((F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("_n")))
        state = checkpointed(state.where(~wide).unionByName(hit.select(*by, "rank", "_below", F.col("_n").alias("_in"), "_lo", "_hi")))
    same = state.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias("value"))
    listed = members(state.where("_lo < _hi")).groupBy(*by, "rank", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    return same.unionByName(listed.select(*by, "rank", F.get("_s", (F.col("rank") - F.col("_below")).cast("int")).alias("value")))


def group_quantile(rows: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """The quantile of each group's values, interpolated between the two at its place."""
    place = (F.col("n") - 1) * share
    found = order_statistics(rows, by, value, F.array(F.floor(place), F.ceil(place)))
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ends = found.groupBy(*by).agg(F.min_by("value", "rank").alias("_a"), F.max_by("value", "rank").alias("_b"))
    part = place - F.floor(place)
    return ends.join(counts, by).select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias(out))


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """Rows with their place from 1 in the order of the whole table.

    One range sort; a partition's offset is the number of rows in those before it.
    """
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")
    placed = checkpointed(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), inner))
    # One row for each partition.
    offsets = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(rank, F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def lowest(rows: DataFrame, k: int, value: Column, ties: list) -> DataFrame:
    """The ``k`` rows of lowest ``value`` (null is lowest, NaN highest), equal ones in the order of ``ties``; in no order themselves.

    All but the rows that share the k-th value are told by comparison alone.
    """
    number = F.nanvl(F.coalesce(value.cast("double"), F.lit(float("-inf"))), F.lit(float("inf")))
    keyed = checkpointed(rows.withColumn("_key", number))
    edge = checkpointed(order_statistics(keyed, [], "_key", F.array(F.lit(k - 1))).select(F.col("value").alias("_edge")))
    if k <= 0 or edge.isEmpty():
        return keyed.limit(0).drop("_key") if k <= 0 else keyed.drop("_key")
    marked = keyed.join(F.broadcast(edge))
    below = marked.where("_key < _edge").drop("_key", "_edge")
    need = k - below.count()
    same = ranked(marked.where("_key = _edge").drop("_key", "_edge"), ties, "_rank")
    return below.unionByName(same.where(F.col("_rank") <= need).drop("_rank"))


def lowest_of_groups(rows: DataFrame, by: str, k: int, value: str, item: str) -> DataFrame:
    """The ``k`` rows of lowest ``value`` of each group, equal values by lowest ``item``; rows without a value are left out."""
    edge = order_statistics(rows, [by], value, F.array(F.least(F.col("n") - 1, F.lit(k - 1).cast("long")))).select(by, F.col("value").alias("_edge"))
    met = rows.join(edge, by).where(F.col(value) <= F.col("_edge"))
    below = met.where(F.col(value) < F.col("_edge"))
    need = edge.select(by).join(below.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), by, "left").select(by, (k - F.coalesce("_n", F.lit(0))).alias("_need"))
    from .scans import top_k

    same = top_k(met.where(F.col(value) == F.col("_edge")), [by], [item], k, "_rank").join(need, by).where("_rank <= _need")
    return below.drop("_edge").unionByName(same.drop("_edge", "_rank", "_need"))
