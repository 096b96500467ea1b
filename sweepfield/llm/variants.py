"""Spelling variants: words one edit apart, found in a bit-sliced index of positions.

The vocabulary is dealt to blocks in which every two near words meet. In a block
each (position, letter) has a bitset over the block's words. Running through a
word's letters, machine words of 64 candidates at a time keep four sets: those
that agree so far, and those with one letter replaced, left out or put in, whose
positions are the same, one behind or one ahead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import stored

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, STRONGER = 6, 5, 5
SLIP = 199
# A block has about so many entries; a key of more words is split while it leaves more than one place open.
BLOCK_WORDS, KEY_WORDS, TASK_BLOCKS = 8192, 2048, 8
INDEX_CELLS, CHUNK_WORDS = 1 << 25, 1 << 18


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """``word, n``: the vocabulary of all texts.

    Runs of letters, A-Z in lower case; where ``slip`` divides the crc32 of
    ``<key>:<run>``, the run's code point number crc32 modulo its length is
    left out (a null key is written as nothing). Words have at least
    ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.
    """
    low = F.translate(F.col("r"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("r"))
    runs = runs.where(F.length("r") >= LEAST_LENGTH).withColumn("r", low).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "r").cast("binary")))
    cut = F.expr("concat(substring(r, 1, cast(h % length(r) as int)), substring(r, cast(h % length(r) as int) + 2))")
    words = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("r")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(entries: DataFrame) -> DataFrame:
    """``key`` of an entry: the letters outside the open places [lo, hi) of an alignment of length ``size``."""
    outside = [F.expr("substring(word, 1, lo)"), F.expr("substring(word, length(word) - (size - hi) + 1, size - hi)")]
    return entries.withColumn("key", F.xxhash64("size", "lo", "hi", *outside))


def _halves(vocabulary: DataFrame) -> DataFrame:
    """Four entries for each word. The edit between two near words lies in one half of the shorter one's places, so
    the other half is the same in both; a word is the shorter one at its own length and the longer one at one less."""
    sizes = vocabulary.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    half = F.expr("explode(array(struct(0 as lo, size div 2 as hi), struct(size div 2 as lo, size as hi)))").alias("open")
    return _keyed(sizes.select("word", "n", "size", half).select("word", "n", "size", F.col("open.lo").cast("int").alias("lo"), F.col("open.hi").cast("int").alias("hi")))


def _split(entries: DataFrame) -> DataFrame:
    """Each entry as two, with the first and the second half of its open places."""
    middle = "(lo + hi) div 2"
    half = F.expr(f"explode(array(struct(lo, {middle} as hi), struct({middle} as lo, hi)))").alias("open")
    return _keyed(entries.select("word", "n", "size", half).select("word", "n", "size", F.col("open.lo").cast("int").alias("lo"), F.col("open.hi").cast("int").alias("hi")))


def _entries(vocabulary: DataFrame) -> DataFrame:
    """Entries such that near words share a key, with no key of more than ``KEY_WORDS`` words that could be split.

    With one place open a key has only so many words as there are letters, or pairs of letters.
    """
    entries = _halves(vocabulary)
    while True:
        full = stored(entries.where("hi - lo > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > KEY_WORDS).select("key"))
        if full.isEmpty():
            return entries
        entries = stored(entries.join(full, "key", "left_anti").unionByName(_split(entries.join(full, "key", "left_semi"))))


class PositionIndex:
    """Bitsets over ``words``, code point arrays of one length or lengths next to each other, for queries of ``length`` letters."""

    def __init__(self, words: list[np.ndarray], length: int, letters: np.ndarray):
        self.length, self.letters, places = length, letters, length + 2
        cells = np.zeros((places, len(letters) + 1, -(-len(words) // 64) * 64), bool)
        sizes = np.array([len(w) for w in words])
        for j, w in enumerate(words):
            cells[np.arange(len(w)), np.searchsorted(letters, w), j] = True
        self.at = np.packbits(cells, axis=-1, bitorder="little").view(np.uint64)
        ends = np.zeros((3, cells.shape[-1]), bool)
        for d in range(3):
            ends[d, :len(words)] = sizes == length - 1 + d
        self.ends = np.packbits(ends, axis=-1, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places ``(query, word)`` of all pairs exactly one edit apart; ``queries`` is a matrix of code points."""
        code = np.searchsorted(self.letters, queries)
        same = np.full((len(queries), self.at.shape[-1]), ~np.uint64(0))
        changed, behind, ahead = (np.zeros_like(same) for _ in range(3))
        for i in range(self.length):
            here = self.at[i, code[:, i]]
            ahead = (ahead | same) & self.at[i + 1, code[:, i]]
            behind = (behind & self.at[i - 1, code[:, i]] if i else behind) | same
            changed = changed & here | same & ~here
            same = same & here
        found = changed & self.ends[1] | behind & self.ends[0] | (ahead | same) & self.ends[2]
        hit = np.flatnonzero(found.any(axis=1))
        q, w = np.nonzero(np.unpackbits(np.ascontiguousarray(found[hit]).view(np.uint8), axis=1, bitorder="little"))
        return hit[q], w


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(a, b)`` in the distinct ``words`` of all ordered pairs exactly one edit apart."""
    points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        by_length.setdefault(len(p), []).append(i)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, asked in by_length.items():
        others = [i for d in (-1, 0, 1) for i in by_length.get(length + d, [])]
        if len(others) < 2:
            continue
        letters = np.unique(np.concatenate([points[i] for i in others]))
        queries = np.stack([points[i] for i in asked])
        block = max(64, INDEX_CELLS // ((length + 2) * (len(letters) + 1)) // 64 * 64)
        for a in range(0, len(others), block):
            part = others[a:a + block]
            index = PositionIndex([points[i] for i in part], length, letters)
            chunk = max(1, CHUNK_WORDS // index.at.shape[-1])
            for b in range(0, len(asked), chunk):
                q, w = index.near(queries[b:b + chunk])
                left.append(np.array(asked)[b + q])
                right.append(np.array(part)[w])
    return np.concatenate(left), np.concatenate(right)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, near, near_n`` for all ordered pairs of ``vocabulary(word, n)`` exactly one edit apart; pairs may repeat."""
    entries = _entries(vocabulary)
    blocks = max(1, -(-entries.count() // BLOCK_WORDS))
    schema = StructType([StructField("word", StringType()), StructField("near", StringType()), StructField("near_n", LongType())])

    def block(got: pa.Table) -> pa.Table:
        count = dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist()))
        words = list(count)
        a, b = near_pairs(words)
        return pa.table([pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()), pa.array([count[words[i]] for i in b], pa.int64())], names=schema.names)

    dealt = entries.select("word", "n", F.pmod("key", F.lit(blocks)).cast("int").alias("block"))
    # So many tasks that none has more than some blocks, however few bytes they are.
    return dealt.repartition(-(-blocks // TASK_BLOCKS), "block").groupBy("block").applyInArrow(block, schema)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: from each word of ``forms(word, form)`` on to the last form, by doubling; forms grow fivefold, so few rounds suffice."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def _strongest() -> Column:
    return F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the vocabulary of ``docs`` (see ``word_counts``).

    Words are near if one inserted, left out or replaced code point makes one of
    the other. A word's form is its near word of largest ``n`` (ties: the
    smallest in code-point order) if that is at least five times its own; its
    root is the last of its forms, itself without any. Null and empty texts have
    no words. Rows that repeat count each. An empty table, or one without
    frequent words, gives no rows. Only ``key`` and ``text`` are read.
    """
    vocabulary = stored(word_counts(docs, key, text))
    near = near_words(vocabulary).groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _strongest())
    strong = -F.col("best.n") >= STRONGER * F.col("n")
    whole = stored(vocabulary.join(best, "word", "left").select("word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, -F.col("best.n")).alias("form_n")))
    roots = _roots(whole.where("form is not null").select("word", "form"))
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
