"""Mixing sources to target weights by a temperature.

Each source's share of tokens is raised to an exponent between 0 (all sources
alike) and 1 (as they are) and normalised. The exponent is found by bisection so
that the weights reach a target entropy, or so that no source repeats more often
than a limit. The weights become token budgets, and each source's budget is
filled by whole passes over its documents in permuted blocks and a last part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import small_enough
from .common import stored

BLOCK_ROWS = 4_096
BROADCAST_ROWS = 50_000
_LAST = (1 << 63) - 1


def token_count(text: str) -> Column:
    """Bytes of the text: the tokens a byte-level vocabulary starts from, which counts every script and every blob alike. Null and empty texts have none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _at(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """At each exponent, the weights' entropy, and how often the most repeated source is read for each
    time the least repeated one is; one pass over the sources."""
    e = shares.where("p > 0").select("p", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("x")).withColumn("u", F.pow("p", F.col("x")))
    r = F.col("u") / F.col("p")
    got = e.groupBy("x").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("h"), (F.max(r) / F.min(r)).alias("r")).collect()
    return {g["x"]: (math.log(g["z"]) - g["h"] / g["z"], g["r"]) for g in got}


def bisect_exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None, steps: int = 6, wide: int = 16) -> float:
    """The smallest exponent in [0, 1] whose weights have at most ``entropy`` (nats), or at which the
    most repeated source is read at most ``repeats`` times as often as the least repeated one.

    Entropy and repetition fall as the exponent grows. Each step cuts the
    interval into ``wide`` parts at once, one pass over the sources. Targets out
    of reach give the nearer end; without tokens the exponent is 1.
    """
    low, high = 0.0, 1.0
    for _ in range(steps):
        grid = [low + (high - low) * i / wide for i in range(wide + 1)]
        at = _at(shares, grid)
        if not at:
            return 1.0
        over = [at[x][0] > entropy if entropy is not None else at[x][1] > repeats for x in grid]
        if not over[0]:
            return grid[0]
        if over[-1]:
            return grid[-1]
        i = max(k for k, far in enumerate(over) if far)
        low, high = grid[i], grid[i + 1]
    return high


def source_weights(docs: DataFrame, source: str, tokens: Column, entropy: float | None = None, repeats: float | None = 1.25) -> tuple[DataFrame, float]:
    """``source``, ``n``, ``tokens``, ``weight``, ``budget`` for each source, and the exponent.

    The whole budget is the least at which every source with tokens is read at
    least once. A null source is a source of its own; one without tokens has
    weight 0 and is read once.
    """
    counts = stored(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens")))
    total = counts.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = counts.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    x = bisect_exponent(shares, entropy, repeats)
    u = F.when(F.col("p") > 0, F.pow("p", F.lit(x))).otherwise(0.0)
    facts = shares.agg(F.sum(u).alias("z"), F.max(F.when(F.col("p") > 0, F.col("p") / u)).alias("m")).first()
    z, m = facts["z"] or 1.0, facts["m"] or 1.0
    budget = F.greatest(F.round(u * m * float(total)).cast("long"), F.col("tokens"))
    return stored(shares.select("source", "n", "tokens", (u / z).alias("weight"), budget.alias("budget"))), x


def _beside(small: DataFrame) -> DataFrame:
    """A table that grows with the sources: broadcast only after its size is checked."""
    return F.broadcast(small) if small_enough(small, BROADCAST_ROWS) else small


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", entropy: float | None = None, repeats: float | None = 1.25, seed: int = 0) -> DataFrame:
    """``docs``, a row for each reading, with ``mix_pass`` (from 0), ``mix_block`` and ``mix_place``, and the source's ``mix_weight``.

    Every document is read once in each whole pass its source's budget allows.
    The last, partial pass takes the source's blocks in permuted order, and in a
    block documents in permuted order, until the budget is reached: the document
    that reaches it is the last one taken, with its exact copies. Sorted by
    ``mix_pass, mix_block, mix_place`` the readings of a source come in the order
    of its permutations, which differ from pass to pass. All columns of ``docs``
    are kept unless they begin with ``mix_``. Null and empty texts cost no
    tokens; a null source is a source of its own; an empty table stays empty.

    Only the totals of blocks of about ``BLOCK_ROWS`` documents are summed up in
    order, and only the block in which a budget ends is looked into, so a source
    with a third of all rows is not in one task. Texts are read twice, once for
    their tokens, and not shuffled.
    """
    mix_id = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))
    sized = stored(docs.select(F.col(source).alias("mix_from"), mix_id.alias("mix_id"), token_count(text).alias("mix_tokens")))
    weights, _ = source_weights(sized, "mix_from", F.col("mix_tokens"), entropy, repeats)
    whole = F.greatest(F.lit(1), F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).cast("int")
    plan = stored(weights.select(F.col("source").alias("mix_source"), whole.alias("mix_whole"), F.col("weight").alias("mix_weight"),
                                 F.greatest(F.col("budget") - F.col("tokens") * whole, F.lit(0)).alias("mix_rest"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).alias("mix_blocks")))
    own = [c for c in docs.columns if not c.startswith("mix_")]

    def permuted(rows: DataFrame, source: str) -> DataFrame:
        dealt = rows.join(_beside(plan), F.col(source).eqNullSafe(F.col("mix_source")))
        return (dealt.withColumn("mix_part", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_id"), F.col("mix_blocks")))
                .withColumn("mix_last", F.xxhash64(F.lit(seed + 3), "mix_whole", "mix_id")))

    turn = F.xxhash64(F.lit(seed + 2), "mix_whole", "mix_source", "mix_part")
    keyed = permuted(sized, "mix_from").where("mix_rest > 0").select("mix_source", "mix_part", "mix_whole", "mix_rest", "mix_last", "mix_tokens")
    totals = stored(keyed.groupBy("mix_source", "mix_part", "mix_whole", "mix_rest").agg(F.sum("mix_tokens").alias("t")))
    before = F.coalesce(F.sum("t").over(W.partitionBy("mix_source").orderBy(turn, "mix_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = stored(totals.withColumn("before", before).where("before < mix_rest"))
    full = reached.where("before + t <= mix_rest").select("mix_source", "mix_part", F.lit(_LAST).alias("mix_limit"))
    ends = reached.where("before + t > mix_rest").select(F.col("mix_source").alias("s"), F.col("mix_part").alias("b"), (F.col("mix_rest") - F.col("before")).alias("left"))
    inside = F.coalesce(F.sum("mix_tokens").over(W.partitionBy("s", "b").orderBy("mix_last").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = (keyed.join(_beside(ends), F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_part") == F.col("b"))).withColumn("inside", inside)
            .where("inside < left").groupBy(F.col("s").alias("mix_source"), F.col("b").alias("mix_part")).agg(F.max("mix_last").alias("mix_limit")))
    limits = stored(full.unionByName(edge)).select(F.col("mix_source").alias("mix_s"), F.col("mix_part").alias("mix_p"), "mix_limit")
    rows = permuted(docs.select(*own, mix_id.alias("mix_id")), source).join(_beside(limits), F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_part") == F.col("mix_p")), "left")
    extra = F.when(F.col("mix_last") <= F.col("mix_limit"), 1).otherwise(0)
    read = rows.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("mix_whole") + extra - 1)))
    return read.select(*own, "mix_pass", F.xxhash64(F.lit(seed + 2), "mix_pass", "mix_source", "mix_part").alias("mix_block"),
                       F.xxhash64(F.lit(seed + 3), "mix_pass", "mix_id").alias("mix_place"), "mix_weight")
