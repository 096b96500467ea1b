"""Byte-level BPE over overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own,
in parallel. A pre-token boundary depends only on the text after the boundary
before it, so two pre-tokenisations that share one boundary agree from there on.
Where the one that runs on from a chunk first meets the one that starts at the
next chunk, the two are stitched; the pieces between stitches are encoded, again
in parallel. A chunk that finds no such place in its overlap is joined to the
one before it. Texts of one chunk need no stitching and no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import per_text, small

CHUNK = 32_768
OVERLAP = 1_024
CACHED = 50_000
# Characters after a boundary that a pattern may look at, as the longest contraction does.
AHEAD = 8


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Pieces to ids by a rank file, and back; recent pieces are remembered."""

    def __init__(self, path: str, pattern: str):
        ranks = ranks_of(path)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._known: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, pieces: list[str]) -> list[int]:
        known, out = self._known, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = self._merge(p.encode("utf-8", "replace"))
                if len(p) <= 32:
                    if len(known) >= CACHED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec in each worker, whatever the number of its tasks."""
    return Codec(path, pattern)


def boundaries(pattern: regex.Pattern, text: str, start: int, upto: int) -> list[int]:
    """Pre-token boundaries of ``text`` from ``start``, itself one, that lie before ``upto``.

    Ends within ``AHEAD`` characters of the end of ``text`` are left out: with more text they could move.
    """
    out = [start]
    for m in pattern.finditer(text, start):
        if m.end() > len(text) - AHEAD or m.end() >= upto:
            break
        out.append(m.end())
    return out


def stitch(pattern: regex.Pattern, window: str, body: int, overlap: int, last: bool) -> int | None:
    """Where the chunk at the start of ``window`` meets the next one, which starts at ``body``; None if it does not within ``overlap``.

    ``window`` has ``body + overlap`` characters, fewer at the end of the text.
    """
    if last:
        return None
    fresh = set(boundaries(pattern, window, body, body + overlap))
    return next((b for b in boundaries(pattern, window, 0, body + overlap) if b >= body and b in fresh), None)


def _cut(docs: DataFrame, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks of long texts: a row number, the chunk's number, the text from it on, and where it is stitched to the next."""
    rows = (docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") > chunk)
            .withColumn("row", F.monotonically_increasing_id()))
    return rows.select("row", "k", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chunk).cast("int")),
        lambda i: F.struct(F.col("t").substr(i * chunk + 1, F.lit(chunk + overlap)).alias("w"), ((i + 1) * chunk >= F.length("t")).alias("last")))).alias("i", "c")
    ).select("row", "k", "i", "c.w", "c.last").repartition("row", "i")


def long_pieces(docs: DataFrame, path: str, pattern: str, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """``row, k, part, t``: long texts as stretches that can be encoded separately, in order of ``part``.

    Stitches count only while every chunk before them was stitched: after one
    that was not, the rest of that text is one stretch.
    """
    chunks = _cut(docs, key, text, chunk, overlap)
    schema = StructType([*chunks.schema.fields, StructField("q", LongType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for b in small(batches):
            q = [stitch(compiled, w, chunk, overlap, last) for w, last in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q, pa.int64())], names=schema.names)

    order = W.partitionBy("row").orderBy("i")
    met = chunks.mapInArrow(meet, schema)
    lost = F.sum(F.when(F.col("q").isNull() & ~F.col("last"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    lost = F.coalesce(lost, F.lit(0))
    start = F.when(lost > 0, F.lit(0)).otherwise(F.coalesce(F.lag("q").over(order) - chunk, F.lit(0)))
    parts = met.select("row", "k", "i", "w", "last", "q", lost.alias("lost"), start.alias("a"))
    end = F.when(F.col("lost") > 0, F.lit(chunk)).when(F.col("q").isNull(), F.lit(chunk)).otherwise(F.col("q"))
    end = F.when(F.col("last"), F.length("w")).otherwise(end)
    parts = parts.select("row", "k", "i", "lost", F.col("w").substr((F.col("a") + 1).cast("int"), F.greatest(end - F.col("a"), F.lit(0)).cast("int")).alias("t"))
    # After a lost stitch everything hangs together with the chunk that lost it.
    first = F.min(F.when(F.col("lost") > 0, F.col("i"))).over(W.partitionBy("row"))
    part = F.least(F.col("i"), F.coalesce(first - 1, F.col("i")))
    whole = parts.select("row", "k", "i", part.alias("part"), "t").groupBy("row", "part").agg(
        F.first("k").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), "").alias("t"))
    return whole.select("row", "k", "part", "t")


def encode_ids(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``part`` and ``ids``: the ids of every text, stretch by stretch; join them in order of ``part``."""
    def make():
        codec = codec_of(path, pattern)
        return lambda t: (codec.encode(codec.pieces(t)),)

    ids = [StructField("ids", ArrayType(IntegerType()))]
    short = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") <= chunk).select(F.lit(-1).cast("long").alias("row"), "k", F.lit(0).alias("part"), "t")
    long = long_pieces(docs, path, pattern, key, text, chunk, overlap).repartition("row", "part")
    both = per_text(short, ["row", "k", "part"], "t", make, ids).unionByName(per_text(long, ["row", "k", "part"], "t", make, ids))
    return both.select(F.col("k").alias(key), "row", "part", "ids")


def digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` (``key`` alone by default), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text, encoded and decoded again.

    A null or empty text has no tokens and the digests of the empty string.
    Repeated rows give repeated rows; an empty table gives none. Texts longer
    than ``chunk`` are cut, stitched and encoded in parallel, then read in order
    by a task that holds one stretch at a time.
    """
    keep = keep or [key]
    packed = docs.select(F.struct(*keep).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def one():
        codec = codec_of(path, pattern)

        def row(t: str) -> tuple:
            ids = codec.encode(codec.pieces(t))
            return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return row

    short = per_text(packed.where(F.length("t") <= chunk), ["k"], "t", one, fields)
    # Long texts: stretches encoded where they lie, then their ids and bytes digested in order.
    stretches = long_pieces(packed, path, pattern, "k", "t", chunk, overlap).repartition("row", "part")
    made = [StructField("n", LongType()), StructField("said", StringType()), StructField("plain", StringType())]

    def part():
        codec = codec_of(path, pattern)

        def row(t: str) -> tuple:
            ids = codec.encode(codec.pieces(t))
            return len(ids), " ".join(map(str, ids)), base64.b64encode(codec.decode(ids)).decode()

        return row

    encoded = per_text(stretches, ["row", "k", "part"], "t", part, made).repartition("row").sortWithinPartitions("row", "part")
    out = StructType([packed.schema["k"], *fields])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, k, n, ids, plain = None, None, 0, hashlib.sha256(), hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([k, pa.array([n], pa.int64()), pa.array([ids.hexdigest()]), pa.array([plain.hexdigest()])], names=out.names)

        for b in small(batches):
            for i, (r, count, said, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("row", "n", "said", "plain")))):
                if r != row:
                    if row is not None:
                        yield done()
                    row, k, n, ids, plain = r, b.column("k").slice(i, 1), 0, hashlib.sha256(), hashlib.sha256()
                ids.update((" " if n and count else "").encode() + said.encode())
                plain.update(base64.b64decode(raw))
                n += count
        if row is not None:
            yield done()

    return short.unionByName(encoded.mapInArrow(in_order, out)).select("k.*", "n_tokens", "ids_sha256", "decoded_sha256")
