"""How filters interact: what each removes at every place of every order, from sorted posting lists.

Rows are numbered once. Each filter has, for every part and range of row
numbers, the sorted list of the rows that fail it. A merge over the lists of one
part and range gallops: a stretch of one list below all the others' heads is
counted at once. It gives the sizes of all unions of filters; what a filter
removes after others is a difference of two unions. Sizes add up over ranges, so
a part with a third of all rows is as many tasks as it has ranges.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import stored

RANGE_BITS = 14
GOOD, TOXIC = "good", "toxic"


def rule_failures() -> dict[str, Column]:
    """Failure conditions A to D over the columns ``t`` (text, not null) and ``w`` (its words)."""
    words, points = F.size("w"), F.length("t")
    capitals = points - F.length(F.regexp_replace("t", "[A-Z]", ""))
    return {"A": words < 50, "B": 100 * F.size(F.array_distinct("w")) < 65 * words, "C": 100 * capitals > 5 * points, "D": F.col("t").rlike(r"[#$%&*|]")}


def _rows(docs: DataFrame, rules: dict[str, Column], key: str, text: str, part: str) -> DataFrame:
    """``row, id, part, digest`` and a column for each rule, one row for each of ``docs``."""
    read = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = read.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    return words.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), *(c.alias(f"fails_{n}") for n, c in rules.items()))


def posting_lists(rows: DataFrame, rules: list[str], copies: str, labels: DataFrame, key: str) -> DataFrame:
    """``part, range, list, ids``: sorted row numbers of the rows that fail each filter, and of good and toxic ones.

    ``copies`` names the filter that a row fails if a smaller id has its text, anywhere in the table.
    """
    own = rows.select("row", "part", F.explode(F.array_compact(F.array(*(F.when(F.col(f"fails_{n}"), F.lit(n)) for n in rules)))).alias("list"))
    known = rows.where("id is not null").select("row", "part", "id", "digest")
    # The smallest id of each text: joined on the id, so that a text of very many rows is no hot key.
    firsts = known.groupBy("digest").agg(F.min("id").alias("id"))
    later = known.join(firsts, ["id", "digest"], "left_anti").select("row", "part", F.lit(copies).alias("list"))
    marks = labels.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias(GOOD), F.max(F.col("toxic") == 1).alias(TOXIC)).where(f"{GOOD} or {TOXIC}")
    marked = known.join(marks, "id").select("row", "part", F.explode(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in (GOOD, TOXIC))))).alias("list"))
    whole = own.unionByName(later).unionByName(marked).withColumn("range", F.shiftright("row", RANGE_BITS))
    return whole.groupBy("part", "range", "list").agg(F.sort_array(F.collect_list("row")).alias("ids"))


def gallop(ids: list[int], start: int, bound: int) -> int:
    """The first place from ``start`` on whose id is ``bound`` or more."""
    step, n = 1, len(ids)
    while start + step < n and ids[start + step] < bound:
        step *= 2
    return bisect_left(ids, bound, start + step // 2, min(start + step, n))


def regions(lists: list[list[int]]) -> dict[int, int]:
    """How many ids lie in exactly which of the sorted ``lists`` (a bit each), by one merge of all of them."""
    heads = [0] * len(lists)
    out: dict[int, int] = {}
    live = [k for k, ids in enumerate(lists) if ids]
    while live:
        now = [lists[k][heads[k]] for k in live]
        low = min(now)
        least = [k for k, v in zip(live, now) if v == low]
        mask = sum(1 << k for k in least)
        if len(least) == 1:
            k = least[0]
            bound = min((v for v in now if v != low), default=None)
            end = len(lists[k]) if bound is None else gallop(lists[k], heads[k], bound)
            out[mask] = out.get(mask, 0) + end - heads[k]
            heads[k] = end
        else:
            out[mask] = out.get(mask, 0) + 1
            for k in least:
                heads[k] += 1
        live = [k for k in live if heads[k] < len(lists[k])]
    return out


def union_sizes(postings: DataFrame, filters: str) -> DataFrame:
    """``part, subset, n, good, toxic``: sizes of the union of every subset of filters (a bit each), and of what is good and toxic in it."""
    names, subsets = [*filters, GOOD, TOXIC], 1 << len(filters)
    schema = StructType([postings.schema["part"], StructField("subset", IntegerType()), *(StructField(c, LongType()) for c in ("n", GOOD, TOXIC))])

    def sizes(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        lists = dict(zip(got.column("list").to_pylist(), got.column("ids").to_pylist()))
        found = regions([lists.get(n, []) for n in names])
        mask, n = np.array([*found], np.int64), np.array([*found.values()], np.int64)
        out = np.zeros((3, subsets), np.int64)
        for s in range(1, subsets):
            hit = mask & s > 0
            out[:, s] = [n[hit].sum(), n[hit & (mask >> len(filters) & 1 > 0)].sum(), n[hit & (mask >> len(filters) + 1 & 1 > 0)].sum()]
        return pa.table([pa.array([key[0].as_py()] * subsets, pa.string()), pa.array(np.arange(subsets), pa.int32()), *map(pa.array, out)], names=schema.names)

    return postings.groupBy("part", "range").applyInArrow(sizes, schema).groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", GOOD, TOXIC)))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What filters A to E remove from each part, at each step of each of the 120 orders.

    A: under 50 words; B: fewer than 65 distinct words in 100; C: more than 5
    capitals A-Z in 100 code points; D: any of ``#$%&*|``; E: the same text as a
    smaller id anywhere in the table (compared by SHA-256). Null texts are empty,
    a null part is the empty string. A row with a null id never fails E, makes
    no other row fail it and has no label. Rows that repeat an id count each, and
    neither is smaller than the other; if ``labels`` repeats an id, any of its
    rows may make it good or toxic. An empty table gives no rows. Of ``docs`` only
    the three columns are read.
    """
    rules, filters = rule_failures(), "ABCDE"
    rows = stored(_rows(docs, rules, key, text, part))
    postings = stored(posting_lists(rows, [*rules], "E", labels, key))
    everything = (1 << len(filters)) - 1
    table = F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", GOOD, TOXIC))))
    unions = union_sizes(postings, filters).groupBy("part").agg(table.alias("by"))
    total = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")).join(unions, "part", "left")
    dense = [F.expr(f"transform(sequence(0, {everything}), s -> coalesce(by[s].{c}, 0L)) AS u_{c}") for c in ("n", GOOD, TOXIC)]
    weights = [[factorial(s.bit_count()) * factorial(len(filters) - 1 - s.bit_count()) if not s >> k & 1 else 0 for s in range(everything + 1)] for k in range(len(filters))]
    shares = [sum((w * (F.col("u_n")[s | 1 << k] - F.col("u_n")[s]) for s, w in enumerate(ws) if w), F.lit(0).cast("long")) for k, ws in enumerate(weights)]
    facts = total.select("part", "total", *dense).withColumn("shares", F.array(*shares))

    steps = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            k = filters.index(f)
            steps.append({"filter_order": "".join(order), "step": i + 1, "k": k, "own": 1 << k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    steps_type = "array<struct<filter_order: string, step: int, k: int, own: int, before: int, after: int>>"
    each = facts.select("*", F.explode(F.from_json(F.lit(json.dumps(steps)), steps_type)).alias("s")).select("*", "s.*")
    return each.select("part", "filter_order", "step", F.expr("total - u_n[after]").alias("kept"), F.expr("u_n[after] - u_n[before]").alias("removed"),
                       F.expr("u_n[own] - u_n[after] + u_n[before]").alias("redundant"), F.expr(f"u_n[{everything}] - u_n[{everything} - own]").alias("unique_fails"),
                       F.expr(f"u_{GOOD}[after] - u_{GOOD}[before]").alias("good_lost"), F.expr(f"u_{TOXIC}[after] - u_{TOXIC}[before]").alias("toxic_lost"), F.expr("shares[k]").alias("shapley"))
