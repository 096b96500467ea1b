"""Quality score from a sparse ensemble of rules.

Shallow trees, boosted on statistics of a bounded sample of labelled documents,
give paths; each path is a rule, a conjunction of bounds on statistics. A
logistic model with an L1 penalty picks and weighs rules. The rules it keeps are
compiled into one Spark column expression over the statistics of all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .boost import Tree, grow, leaves, sigmoid
from .common import hash_share, held_out, per_text

STATS = ("n_bytes", "n_words", "word_bytes", "n_lines", "line_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops", "high", "distinct_words",
         "symbol_ends", "top_word", "repeated_lines", "pair_repeats")

_KIND = bytes(1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if chr(b) in "#$%&*@^~<>=+_{}[]\\/" else 4 if b == 33 else 5 if b == 124 else 6 if chr(b) in ".?" else 7 if b >= 128 else 8 if b <= 32 else 0 for b in range(256))
_SYMBOLS = b"#$%&*@^~<>=+_|!"


def statistics(text: str) -> tuple:
    """The numbers in ``STATS``; zeros for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return (0.0,) * len(STATS)
    kinds = raw.translate(_KIND)
    n = len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    share = [kinds.count(k) / n for k in range(1, 8)]
    m = max(len(words), 1)
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    return (float(n), float(len(words)), (n - kinds.count(8)) / m, float(len(lines)), n / max(len(lines), 1), *share,
            len(counts) / m, sum(w[-1] in _SYMBOLS for w in words) / m, max(counts.values(), default=0) / m,
            1 - len(set(lines)) / max(len(lines), 1), 1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0)


def document_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return per_text(docs, keep, text, lambda: statistics, [StructField(f"s_{s}", DoubleType()) for s in STATS])


@dataclass
class Rule:
    """A conjunction: ``(statistic, is_upper, bound)`` each, with its weight."""

    bounds: list[tuple[int, bool, float]]
    weight: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, upper, bound in self.bounds:
            out &= (x[:, k] <= bound) if upper else (x[:, k] > bound)
        return out


@dataclass
class Ensemble:
    rules: list[Rule]
    bias: float

    def column(self) -> Column:
        """The score as one expression over the columns ``s_<statistic>``."""
        total = F.lit(self.bias)
        for r in self.rules:
            cond = F.lit(True)
            for k, upper, bound in r.bounds:
                c = F.col(f"s_{STATS[k]}")
                cond = cond & ((c <= F.lit(bound)) if upper else (c > F.lit(bound)))
            total = total + F.when(cond, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))


def paths(tree: Tree) -> list[list[tuple[int, bool, float]]]:
    """Every node of the tree but the root, as the bounds on the way to it, tightest bound once a side."""
    out = []

    def walk(node: int, way: dict) -> None:
        if way:
            out.append([(k, upper, b) for (k, upper), b in sorted(way.items())])
        if tree.feature[node] < 0:
            return
        k, bound = tree.feature[node], tree.bound[node]
        walk(tree.left[node], way | {(k, True): min(bound, way.get((k, True), np.inf))})
        walk(tree.right[node], way | {(k, False): max(bound, way.get((k, False), -np.inf))})

    walk(0, {})
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 0.002, steps: int = 400) -> Ensemble:
    """Rules from boosted trees; weights by proximal gradient on the L1-penalised logistic loss."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    bias = float(np.log(rate / (1 - rate)))
    if len(y) < 10 or y.min() == y.max():
        return Ensemble([], bias)
    margin, found = np.full(len(y), bias), {}
    for _ in range(trees):
        p = sigmoid(margin)
        tree = grow(x, y - p, p * (1 - p), depth)
        margin += 0.3 * leaves(tree, x)
        for bounds in paths(tree):
            found[tuple(bounds)] = None
    rules = [Rule(list(b), 0.0) for b in found]
    if not rules:
        return Ensemble([], bias)
    design = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    centre = design.mean(axis=0)
    design -= centre
    lipschitz = 0.25 * np.linalg.norm(design, 2) ** 2 / len(y)
    w, look, b, t = np.zeros(len(rules)), np.zeros(len(rules)), bias, 1.0
    for _ in range(steps):
        miss = sigmoid(design @ look + b) - y
        fresh = look - design.T @ miss / len(y) / lipschitz
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - penalty / lipschitz, 0)
        b -= 4 * miss.mean()
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = fresh + (t - 1) / ahead * (fresh - w), fresh, ahead
    kept = [Rule(r.bounds, float(v)) for r, v in zip(rules, w) if v]
    return Ensemble(kept, float(b - centre @ w))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 20_000) -> Ensemble:
    """Rules from about ``rows``, at most twice as many, labelled documents that are not held out, chosen by a hash of the key."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where(~held_out("k") & F.col("y").isNotNull() & F.col("k").isNotNull()).groupBy("k").agg(F.max("y").alias("y"))
    n = known.count()
    drawn = known.where(hash_share("k", seed=21) < float(rows) / max(n, 1))
    read = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(hash_share("k", seed=21) < float(rows) / max(n, 1))
    got = document_statistics(read.join(drawn, "k"), ["k", "y"], "t").orderBy(F.xxhash64("k"), *[f"s_{s}" for s in STATS]).limit(2 * rows).collect()
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(STATS))
    return fit(x, np.array([r[1] for r in got], float))


def score_quality(docs: DataFrame, ensemble: Ensemble, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``key``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every document, whole texts.

    Null and empty texts have all statistics at zero and are scored like any
    other; repeated rows give repeated rows; an empty table gives none.
    """
    scored = document_statistics(docs, [key], text).withColumn("score", ensemble.column())
    return scored.select(F.col(key), held_out(key).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
