"""Near-duplicate documents by a forest of sorted MinHash orders.

A document is the set of its shingles. Equal sets are merged to classes first.
Each tree sorts the classes by a different sequence of their MinHash values;
neighbours with a long common prefix are candidates. A class looks at a window
of neighbours in the order. Candidates that a short sketch rules out are left;
the others are confirmed on the full sets. The first round takes the best of a
window; the second looks again between classes that the first left apart, at
every pair of a region, the classes that share the first values of a tree. Regions
wider than the window are left to an exact join on the full sets' rarest shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import components, free_names, small, stored

HASHES = 128
TREES = 24
FIRST_TREES = 4
# An entry's key is eight values of two bytes; neighbours share at least the first four, one 64-bit number.
KEY_VALUES = 8
WINDOW = 48
SKETCH_BITS = 4
BLOCK_BYTES = 1 << 19
MOST_BITS = 1 << 24
# The shingles that most sets share, at most so many, are looked up in every task.
MOST_HEAVY = 1 << 16
# Rounds in which members of wide regions are compared with so many leaders of their rare shingles' lists.
LEADER_ROUNDS, LEADERS = 2, 4

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_BASE = np.uint64(_RNG.integers(1 << 62, 1 << 63) | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TURN = [np.uint64(v) for v in _RNG.integers(1 << 62, 1 << 63, 64) | 1]
_MULTIPLY = _RNG.integers(1 << 62, 1 << 63, HASHES).astype(np.uint64) | np.uint64(1)
_ORDERS = np.stack([_RNG.permutation(HASHES)[:KEY_VALUES] for _ in range(TREES)])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The sorted, distinct 64-bit hashes of each text's shingles.

    Words are the stretches without ASCII white space, A-Z in lower case. With
    fewer than ``size`` words the whole sequence is the one shingle; without
    words the set is empty.
    """
    out: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0
    for t in texts:
        block.append(t.encode("utf-8", "surrogatepass").translate(_LOWER))
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            out += _block_sets(block, size)
            block, held = [], 0
    return out + _block_sets(block, size)


def _block_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    if not texts:
        return []
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    # A word's hash: its polynomial over the bytes, from running sums, brought to power 0.
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    words = _mixed((run[ends] - run[starts]) * _powers(_BASE_INVERSE, len(data))[starts] ^ ((ends - starts).astype(np.uint64) * _M3))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    grams = sum((words[k:len(words) - size + 1 + k] * _TURN[k] for k in range(size)), np.zeros(max(len(words) - size + 1, 0), np.uint64)) if len(words) >= size else np.zeros(0, np.uint64)
    grams = _mixed(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif n:
            out.append(_mixed(np.array([sum(int(w) * int(_TURN[k]) for k, w in enumerate(words[a:b])) + int(n) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``HASHES`` multiplicative hashes, its upper 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 512):
        np.minimum(low, (hashes[a:a + 512, None] * _MULTIPLY).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _profiles(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``id, n_shingles, set_key, sig`` for each document; ``sig`` is null without shingles."""
    schema = StructType([StructField("id", LongType()), StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("sig", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = shingle_sets(b.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()),
                                              pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=schema.names)

    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)


def sketch(sig: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` bits of every value, two values to a byte, for signatures (rows, hashes)."""
    nibble = (sig & np.uint32(15)).astype(np.uint8)
    return nibble[:, 0::2] | (nibble[:, 1::2] << 4)


def least_agree(percent: int) -> float:
    """Sketch agreement of a pair at similarity s is s + (1 - s) / 16 on average; five standard deviations below at ``percent``."""
    mean = percent / 100 + (1 - percent / 100) / (1 << SKETCH_BITS)
    return mean - 5 * (mean * (1 - mean) / HASHES) ** 0.5


def _entries(classes: DataFrame, trees: range) -> DataFrame:
    """A row for each class and tree: the tree, its key (the values in the tree's order), the class, its group and sketch."""
    schema = StructType([StructField("tree", IntegerType()), StructField("place", BinaryType()), StructField("node", LongType()), StructField("root", LongType()), StructField("bits", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
                bits = pa.array([r.tobytes() for r in sketch(sig)], pa.binary())
                for t in trees:
                    place = np.ascontiguousarray((sig[:, _ORDERS[t]] >> np.uint32(16)).astype(">u2"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array([r.tobytes() for r in place], pa.binary()), b.column(0), b.column(1), bits], names=schema.names)

    return classes.select("node", "root", "sig").mapInArrow(run, schema)


def _neighbours(entries: DataFrame, best: int, percent: int) -> DataFrame:
    """Candidate pairs ``u < v`` from the sorted orders: of the ``WINDOW`` entries before each one that share at
    least four values, the ``best`` of other groups by sketch, where the sketch allows the similarity asked for."""
    schema = StructType([StructField("u", LongType()), StructField("v", LongType())])
    least = least_agree(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[np.ndarray, ...] | None = None
        for b in batches:
            own = np.frombuffer(b"".join(p[:8] for p in b.column("place").to_pylist()), ">u8").astype(np.uint64)
            now = (b.column("tree").to_numpy(), own, b.column("node").to_numpy(), b.column("root").to_numpy(), np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1))
            held = 0 if tail is None else len(tail[0])
            tree, key, node, root, bits = now if tail is None else tuple(np.concatenate([x, y]) for x, y in zip(tail, now))
            n = len(tree)
            score = np.zeros((best, n), np.float32)
            partner = np.full((best, n), -1, np.int64)
            for back in range(1, min(WINDOW, n - 1) + 1):
                rows = np.arange(max(back, held), n)
                rows = rows[(key[rows] == key[rows - back]) & (tree[rows] == tree[rows - back])]
                if not len(rows):
                    break
                rows = rows[root[rows] != root[rows - back]]
                if not len(rows):
                    continue
                x = bits[rows] ^ bits[rows - back]
                agree = (((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)) / HASHES
                agree = np.where(agree >= least, agree, 0).astype(np.float32)
                other = rows - back
                for k in range(best):
                    better = agree > score[k, rows]
                    old_s, old_p = score[k, rows].copy(), partner[k, rows].copy()
                    score[k, rows[better]], partner[k, rows[better]] = agree[better], other[better]
                    agree, other = np.where(better, old_s, agree), np.where(better, old_p, other)
            k, rows = np.nonzero(partner >= 0)
            u, v = node[rows], node[partner[k, rows]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=schema.names)
            tail = tuple(x[-WINDOW:] for x in (tree, key, node, root, bits))

    spread = entries.repartitionByRange("tree", "place", "node").sortWithinPartitions("tree", "place", "node")
    return spread.mapInArrow(run, schema).distinct()


def _regions(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every candidate pair ``u < v`` of the narrow regions, and the ``node, root`` of the others.

    A region is the classes that share a tree's first four values. In one of at most ``WINDOW`` + 1 entries each
    pair of different groups that the sketch allows is a candidate. Of wider regions, and of those that the
    border of a partition may cut, the members are given instead, if they are of more than one group.
    """
    schema = StructType([StructField("u", LongType()), StructField("v", LongType()), StructField("tree", IntegerType()), StructField("place", LongType()), StructField("root", LongType())])
    least, widest = least_agree(percent), WINDOW + 1

    def members(tree: np.ndarray, key: np.ndarray, node: np.ndarray, root: np.ndarray, *_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(tree), pa.array(key.view(np.int64)), pa.array(root)], names=schema.names)

    def pairs(key: np.ndarray, node: np.ndarray, root: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for back in range(1, min(widest, len(key))):
            rows = np.arange(back, len(key))
            rows = rows[key[rows] == key[rows - back]]
            if not len(rows):
                break
            rows = rows[root[rows] != root[rows - back]]
            x = bits[rows] ^ bits[rows - back]
            rows = rows[(((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)) / HASHES >= least]
            u.append(np.minimum(node[rows], node[rows - back]))
            v.append(np.maximum(node[rows], node[rows - back]))
        n = sum(map(len, u))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the last region, which may go on
        given = True  # its members are given, as the first one of a partition or a wide one
        for b in batches:
            own = np.frombuffer(b"".join(p[:8] for p in b.column("place").to_pylist()), ">u8").astype(np.uint64)
            now = (b.column("tree").to_numpy(), own, b.column("node").to_numpy(), b.column("root").to_numpy(), np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(-1, HASHES * SKETCH_BITS // 8))
            now = now if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, now))
            starts = np.concatenate([[0], np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1, [len(now[0])]])
            size = np.diff(starts)
            size[0] = widest + 1 if given else size[0]
            wide, over = np.repeat(size > widest, np.diff(starts)), np.arange(len(now[0])) < starts[-2]
            yield members(*(x[wide & over] for x in now))
            region = np.repeat(np.arange(len(size)), np.diff(starts))[~wide & over]
            yield pairs(region, *(x[~wide & over] for x in now[2:]))
            held, given = tuple(x[~over] for x in now), bool(size[-1] > widest)
            if given:  # all but one entry, which tells the region
                yield members(*(x[:-1] for x in held))
                held = tuple(x[-1:] for x in held)
        if held is not None:
            yield members(*held)

    spread = entries.repartitionByRange("tree", "place", "node").sortWithinPartitions("tree", "place", "node")
    found = stored(spread.mapInArrow(run, schema))
    wide = found.where("v is null")
    mixed = wide.groupBy("tree", "place").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("tree", "place")
    return found.where("v is not null").select("u", "v").distinct(), wide.join(mixed, ["tree", "place"]).select(F.col("u").alias("node"), "root").distinct()


def _counted(grams: DataFrame) -> DataFrame:
    """The rows of ``grams(node, n, h)`` whose ``h`` is not the only one, with ``many``, the number of rows that have it.

    The ``MOST_HEAVY`` most frequent values are looked up in every task, as a join would bring all rows of one to
    one place; any other one has fewer rows than each of these and is joined.
    """
    common = grams.groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    heavy = common.orderBy(F.desc("many"), "h").limit(MOST_HEAVY).collect()
    if not heavy:
        return grams.withColumn("many", F.lit(0).cast("long")).where(F.lit(False))
    known, many = np.array([[r.h, r.many] for r in sorted(heavy)], np.int64).T
    schema = StructType([*grams.schema.fields, StructField("many", LongType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(many[at], mask=known[at] != h)], names=schema.names)

    looked = grams.mapInArrow(look, schema)
    found = looked.where("many is not null")
    if len(heavy) < MOST_HEAVY:
        return found
    rest = common.where(f"many < {heavy[-1].many} or many = {heavy[-1].many} and h > {heavy[-1].h}")
    return found.unionByName(looked.where("many is null").drop("many").join(rest, "h"))


def _shared(members: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Links among ``members``, and the pairs ``u < v`` of groups these leave apart that can be as alike as ``percent``, by their rarest shingles.

    Links come first, in ``LEADER_ROUNDS`` rounds: of the members that share a rare shingle one of the largest group
    is the leader, and those of other groups are compared with their ``LEADERS`` nearest leaders alone. A large group of near copies so becomes one,
    and no two of its members need to meet any more. The rounds only save work.

    No pair between the groups that remain is missed: in any one order of all shingles, two sets that share the
    least they must have one in common before the longer one's last ``percent`` and the shorter one's last
    ``2 percent / (100 + percent)``, and the first such one leaves enough of both after it. The rarest come first,
    so few sets meet at one.
    """
    full = _full(members.select("node"), classes, docs, key, text, size)
    schema = StructType([StructField("node", LongType()), StructField("n", LongType()), StructField("h", LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            sets = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=schema.names)

    grams = stored(full.mapInArrow(each, schema))
    own = W.partitionBy("node")
    # Shingles that no other set has come first and join with none; the others' places are counted from the end.
    placed = _counted(grams).withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("many", "h")) - 1)
    rare = stored(placed.where(F.expr(f"at <= n - ({percent} * n + 99) div 100")).select("node", "n", "h", "at"))
    links = None
    now = members.join(members.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size")
    for _ in range(LEADER_ROUNDS):
        kept = rare.join(now, "node")
        first = F.max_by(F.struct("node", "root", "size", "n"), F.struct("size", "root", F.xxhash64("h", "node"))).alias("led")
        asked = kept.join(kept.groupBy("h").agg(first), "h").where(f"root <> led.root and 100 * least(n, led.n) >= {percent} * greatest(n, led.n)")
        # A long set meets many leaders; it is compared with those of which it shares most.
        met = asked.groupBy(F.col("node").alias("u"), F.col("led.node").alias("v")).agg(F.count("*").alias("many"), F.any_value("root").alias("root"), F.any_value(F.struct("led.size", "led.root")).alias("to"))
        best = met.withColumn("place", F.row_number().over(W.partitionBy("u").orderBy(F.desc("many"), "v"))).where(F.col("place") <= LEADERS)
        new = stored(_agree(best.select("u", "v", "root", "to"), full, percent))
        if new.isEmpty():
            break
        links = new.select("u", "v") if links is None else links.union(new.select("u", "v"))
        # A group goes to the largest one it is linked with; sizes are those at the start, so no two go to each other.
        now = stored(now.join(new.groupBy("root").agg(F.max("to").alias("to")), "root", "left")
                     .select("node", F.coalesce("to.root", "root").alias("root"), F.coalesce("to.size", "size").alias("size")))
    kept = rare.join(now, "node")
    short = kept.where(F.expr(f"at <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent}"))
    x, y = (d.select("h", *(F.col(c).alias(c + e) for c in ("node", "root", "n", "at"))) for d, e in ((kept, "1"), (short, "2")))
    met = x.join(y, "h").where(f"root1 <> root2 and (n2 < n1 or n2 = n1 and node2 < node1) and 100 * n2 >= {percent} * n1 and {100 + percent} * least(n1 - at1, n2 - at2) >= {percent} * (n1 + n2)")
    return links, met.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct()


def _at(key: str) -> Column:
    """The key as a number, null as the smallest one."""
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


def _bitmap(need: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash value of ``need.at``, at most ``MOST_BITS`` of them: 2 MB, whatever the input.

    It only saves work: rows it lets through wrongly are dropped by the join that follows.
    """
    width = 1 << min(MOST_BITS.bit_length() - 1, max(16, 5 + need.count().bit_length()))
    place = F.pmod(F.xxhash64("at"), F.lit(width))
    words = need.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(at), {width}L) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(width >> 6, np.uint64)
    got = words.collect()
    out[[r.w for r in got]] = np.array([r.b for r in got], np.int64).view(np.uint64)
    return out, width


def _marked(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _where_marked(docs: DataFrame, key: str, bits: np.ndarray, width: int, marked: bool) -> DataFrame:
    """The rows of ``docs`` whose key's bit is set, or those whose bit is not; no shuffle."""
    own = docs.columns
    place = F.pmod(F.xxhash64(_at(key)), F.lit(width)).alias(*free_names(own, "__place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            hit = _marked(bits, b.column(len(own)).to_numpy())
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=own).filter(pa.array(hit == marked))

    return docs.select(*own, place).mapInArrow(run, docs.schema)


def _full(nodes: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``node, hashes``: the full sets of the classes ``nodes``, made again from the texts."""
    need = nodes.distinct().join(classes.select("node", "id", "set_key"), "node")
    need = stored(need.withColumn("at", _at("id")))
    bits, width = _bitmap(need)
    schema = StructType([StructField("at", LongType()), StructField("set_key", BinaryType()), StructField("hashes", BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            b = b.filter(pa.array(_marked(bits, b.column(2).to_numpy())))
            made = shingle_sets(b.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], names=schema.names)

    texts = docs.select(_at(key).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.pmod(F.xxhash64(_at(key)), F.lit(width)).alias("place"))
    made = texts.mapInArrow(sets, schema)
    once = made.groupBy("at", "set_key").agg(F.any_value("hashes").alias("hashes"))
    return stored(once.join(need, ["at", "set_key"]).select("node", "hashes"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= percent * union``."""
    return _agree(pairs, _full(pairs.select(F.explode(F.array("u", "v")).alias("node")), classes, docs, key, text, size), percent)


def _agree(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs(u, v, ...)`` whose sets in ``full(node, hashes)`` have ``100 * intersection >= percent * union``."""
    both = pairs.join(full.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(full.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v").select(*pairs.columns, "a", "b")
    out, own = pairs.schema, len(pairs.columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            keep = []
            for x, y in zip(b.column(own).to_pylist(), b.column(own + 1).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:own], names=out.names).filter(mask)

    return both.mapInArrow(compare, out)


def groups(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``id, n_shingles, set_key, root, component_id`` for each document; ``root`` numbers the groups, null without shingles."""
    profiles = stored(_profiles(docs, key, text, size))
    classes = stored(profiles.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"))
                     .withColumn("node", F.monotonically_increasing_id()))
    alone = classes.withColumn("root", F.col("node"))
    links = stored(_confirmed(stored(_neighbours(_entries(alone, range(FIRST_TREES)), 1, percent)), classes, docs, key, text, size, percent))
    stars = stored(components(links))
    grouped = classes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    near, members = _regions(_entries(grouped, range(TREES)), percent)
    members = stored(members)
    if not members.isEmpty():
        joined, apart = _shared(members, classes, docs, key, text, size, percent)
        near = near.union(apart).distinct()
        stars = stars if joined is None else stars.union(joined.toDF("node", "root"))
    more = stored(_confirmed(stored(near), classes, docs, key, text, size, percent))
    member = classes.join(components(stars.toDF("u", "v").union(more)), "node", "left").select("set_key", "id", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("id").alias("component_id"))
    named = member.join(least, "root").select("set_key", "root", "component_id")
    linked = profiles.where("n_shingles > 0").join(named, "set_key").select("id", "n_shingles", "set_key", "root", "component_id")
    return linked.unionByName(profiles.where("n_shingles = 0").select("id", "n_shingles", "set_key", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every document.

    Documents are linked where ``100 * intersection >= percent * union`` of
    their shingle sets; ``component_id`` is the smallest key reachable, and a
    document is kept if that is its own. Null and empty texts and texts without
    words have an empty set and are linked with nothing: they are their own
    component. A null key is never the smallest; a component, or an unlinked
    document, without any other key has a null component and is kept. Repeated
    rows are copies of each other; rows of one key with different texts are
    documents of their own. An empty table gives no rows.

    The forest is meant for ``percent`` of 80 and more.
    """
    found = groups(docs, key, text, size, percent)
    return found.select(F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest key.

    Documents without words stay. Where a key is null or repeated, rows are told
    apart by their shingle set, and one row of the group stays.
    """
    found = stored(groups(docs, key, text, size, percent).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
    ids = stored(found.groupBy("id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    whole = F.col(key).cast("long")
    id_, key_, root_, set_ = free_names(docs.columns, "__id", "__key", "__root", "__set_key")
    kept = ids.where("n = 1 and kept and id is not null").select(F.col("id").alias(id_))
    # Most keys are simply kept: only rows that may be among the others are shuffled.
    others = ids.where("n > 1 or id is null or not kept").select(_at("id").alias("at"))
    bits = _bitmap(others)
    suspects = _where_marked(docs, key, *bits, True)
    plain = _where_marked(docs, key, *bits, False).unionByName(suspects.join(kept, whole == F.col(id_), "left_semi"))
    again = stored(ids.where("n > 1 or id is null").select(F.col("id").alias(id_)))
    at, own = docs.columns.index(text), docs.columns
    schema = StructType([*docs.schema.fields, StructField(set_, BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = shingle_sets([t or "" for t in b.column(at).to_pylist()], size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_key(s) for s in sets], pa.binary())], names=schema.names)

    odd = suspects.join(again, whole.eqNullSafe(F.col(id_)), "left_semi").mapInArrow(keyed, schema)
    facts = found.where("kept").select(F.col("id").alias(id_), F.col("set_key").alias(key_), F.col("root").alias(root_)).distinct()
    odd = odd.join(facts, whole.eqNullSafe(F.col(id_)) & (F.col(set_) == F.col(key_)))
    one = odd.where(F.col(root_).isNotNull()).dropDuplicates([root_]).unionByName(odd.where(F.col(root_).isNull()))
    return plain.unionByName(one.select(*own))
