"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Rows are numbered once and dealt to senders, stretches of at most
``SENDER_ROWS`` rows of one partition. A sender's distinct fingerprints, sorted,
go to the owners of their ranges as Golomb codes of the gaps. An owner answers
each sender with a bitmap: which of its fingerprints somebody else has too.
Rows whose bit is set, or whose fingerprint the sender has twice, are suspects:
only their texts are shuffled, and grouped by all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import stored

SENDER_BITS = 16
SENDER_ROWS = 1 << SENDER_BITS
# Owners hold about so many fingerprints; there are at least so many owners, so that small tables spread too.
OWNER_PRINTS = 1 << 20
LEAST_OWNER_BITS = 6
# A fingerprint has so many bits more than the number of rows: one text in 4,096 is suspected without need.
SPARE_BITS = 12
# Bits that say which texts the second reading passes on, 64 to a row of a broadcast table: 262,144 rows at most.
MOST_BITS = 24


def normalised(text: str) -> Column:
    """The text with each stretch of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb(values: np.ndarray, width: int) -> tuple[int, bytes, bytes]:
    """``(k, high, low)`` for sorted distinct ``values`` in ``[0, width)``.

    Gaps are coded with the Golomb parameter 2^k nearest below their mean times
    ln 2: quotients in unary in ``high``, remainders of k bits each in ``low``.
    """
    gaps = np.diff(values, prepend=-1) - 1
    k = max(0, int(width * 0.6931 / max(len(values), 1)).bit_length() - 1)
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(k)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def ungolomb(n: int, k: int, high: bytes, low: bytes) -> np.ndarray:
    """The ``n`` values that ``golomb`` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(low, np.uint8))[:n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum((quotient.astype(np.int64) << k) + rest + 1) - 1


def _prints(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _messages(rows: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """``owner, sender, n, k, high, low``: each sender's distinct fingerprints for each owner."""
    schema = StructType([StructField("owner", IntegerType()), StructField("sender", LongType()), StructField("n", IntegerType()), StructField("k", IntegerType()), StructField("high", BinaryType()), StructField("low", BinaryType())])
    shift = bits - owner_bits

    def message(sender: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        own = np.unique(_prints(np.concatenate(hashes), bits))
        owners, starts = np.unique(own >> shift, return_index=True)
        parts = [own[a:b] for a, b in zip(starts, [*starts[1:], len(own)])]
        codes = [golomb(p - (o << shift), 1 << shift) for o, p in zip(owners, parts)]
        columns = [owners, [sender] * len(parts), [len(p) for p in parts], *(list(c) for c in zip(*codes))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held = None, []
        for b in batches:
            who, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(who)) + 1
            for first, part in zip([0, *edges], np.split(hashes, edges)):
                if len(part):
                    if sender is not None and who[first] != sender:
                        yield message(sender, held)
                        held = []
                    sender = int(who[first])
                    held.append(part)
        if held:
            yield message(sender, held)

    return rows.select("sender", "hash").mapInArrow(run, schema)


def _replies(messages: DataFrame) -> DataFrame:
    """``sender, owner, twice``: for each message a bit for each of its fingerprints, set if another message has it too."""
    schema = StructType([StructField("sender", LongType()), StructField("owner", IntegerType()), StructField("twice", BinaryType())])

    def reply(got: pa.Table) -> pa.Table:
        sets = [ungolomb(*m) for m in zip(*(got.column(c).to_pylist() for c in ("n", "k", "high", "low")))]
        _, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        twice = np.split(many[place] > 1, np.cumsum([len(s) for s in sets])[:-1])
        return pa.table([got.column("sender"), got.column("owner"), pa.array([np.packbits(t).tobytes() for t in twice], pa.binary())], names=schema.names)

    return messages.groupBy("owner").applyInArrow(reply, schema)


def _judged(rows: DataFrame, replies: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """``suspect, hash, sha, row, ids`` for each distinct digest of a sender; ``ids`` are its rows' keys, smallest first
    and null last, ``row`` is the first one's number."""
    schema = StructType([StructField("suspect", BooleanType()), StructField("hash", LongType()), StructField("sha", BinaryType()), StructField("row", LongType()), StructField("ids", ArrayType(LongType()))])
    shift = bits - owner_bits

    def judge(own: pa.Table, got: pa.Table) -> pa.Table:
        hashes = own.column("hash").to_numpy()
        values, place, many = np.unique(_prints(hashes, bits), return_inverse=True, return_counts=True)
        twice = many > 1
        answers = dict(zip(got.column("owner").to_pylist(), got.column("twice").to_pylist()))
        owners, starts, sizes = np.unique(values >> shift, return_index=True, return_counts=True)
        for o, a, n in zip(owners.tolist(), starts, sizes):
            twice[a:a + n] |= np.unpackbits(np.frombuffer(answers[o], np.uint8))[:n].astype(bool)
        suspect = twice[place]
        groups: dict[bytes, list[int]] = {}
        for i, s in enumerate(own.column("sha").to_pylist()):
            groups.setdefault(s, []).append(i)
        ids, rows = own.column("id").to_pylist(), own.column("row").to_pylist()
        for members in groups.values():
            members.sort(key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
        firsts = [m[0] for m in groups.values()]
        return pa.table([pa.array(suspect[firsts]), pa.array(hashes[firsts]), pa.array(list(groups), pa.binary()), pa.array([rows[i] for i in firsts], pa.int64()),
                         pa.array([[ids[i] for i in m] for m in groups.values()], pa.list_(pa.int64()))], names=schema.names)

    return rows.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(judge, schema)


def _texts(docs: DataFrame, text: str, suspects: DataFrame) -> DataFrame:
    """``sha, n`` for each normalised text among the suspects' (others may be among them): texts are equal in all bytes.

    Which texts are passed on is said by bits of their hashes; beyond some millions of suspected texts the bits fill
    and more texts than needed are shuffled, which changes no result.
    """
    width = min(MOST_BITS, max(16, suspects.count().bit_length() + 5))

    def at(hash_: str) -> Column:
        return F.shiftrightunsigned(hash_, 64 - width)

    spots = suspects.select(at("hash").alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    read = docs.select(normalised(text).alias("t")).withColumn("at", F.shiftrightunsigned(F.xxhash64("t"), 64 - width)).withColumn("word", F.shiftright("at", 6))
    passed = read.join(F.broadcast(words), "word").where("shiftright(bits, cast(at & 63 as int)) & 1 = 1")
    return passed.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select(F.unhex(F.sha2("t", 256)).alias("sha"), "n")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal if they are identical after each stretch of ASCII white
    space is made one space; null counts as empty, so null and empty texts are
    one group (a text of blanks is a single space and another one). Of equal
    texts the row with the smallest key stays; a null key is larger than any
    other, and a group of null keys alone has a null ``keep_id``. Exactly one
    row of a group is ``kept``, also where rows repeat a key. Only ``key`` and
    ``text`` are read. An empty table gives no rows.

    ``docs`` is read twice and must give the same texts both times. Two texts
    of one SHA-256 would fail the query rather than be taken for equal.
    """
    read = docs.select(F.col(key).cast("long").alias("id"), normalised(text).alias("t"))
    rows = stored(read.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("t").alias("hash"), F.unhex(F.sha2("t", 256)).alias("sha"))
                  .withColumn("sender", F.shiftright("row", SENDER_BITS)))
    n = rows.count()
    owner_bits = max(LEAST_OWNER_BITS, (n // OWNER_PRINTS).bit_length())
    bits = min(62, max(owner_bits, n.bit_length()) + SPARE_BITS)
    found = stored(_judged(rows, _replies(_messages(rows, bits, owner_bits)), bits, owner_bits))

    suspects = found.where("suspect")
    first = F.min(F.struct(F.col("ids")[0].isNull().alias("none"), F.col("ids")[0].alias("id"), "row")).alias("first")
    facts = suspects.groupBy("sha").agg(first, F.sum(F.size("ids")).alias("size"))
    agreed = F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256, or the texts changed between readings")).cast("long"))
    groups = facts.join(_texts(docs, text, suspects), "sha", "left").select("sha", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), agreed.alias("group_size"))
    many = suspects.join(groups, "sha").select("sha", "row", "keep_id", "keep_row", "group_size", F.posexplode("ids").alias("at", "id"))
    alone = found.where("not suspect").select(F.col("ids")[0].alias("id"), F.col("ids")[0].alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    whole = many.select("id", "keep_id", "group_size", F.expr("at = 0 and row = keep_row").alias("kept"), "sha").unionByName(alone)
    return whole.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
