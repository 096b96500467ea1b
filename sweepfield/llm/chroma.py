"""Audio fingerprints from pitch classes, and their alignment.

A recording is cut to frames; the spectrum of a frame is folded to twelve pitch
classes. Filters over the integral image of (frames, classes) compare two areas;
each gives two bits, and the bits of all filters at a frame are packed into one
integer. Two recordings are aligned by the share of differing bits at every offset,
found by a Fourier transform of the bits; an alignment counts if so few differ
that none is likely by chance among all that are compared.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import in_blocks, small, stored

RATE = 2_000
FRAME = 256
HOP = 128
LOWEST = 110.0
CLASSES = 12
SPAN = 12
# Filters (shape, first class, classes, frames) by a rule: four shapes on shifting stretches of classes.
FILTERS = tuple((i % 4, (5 * i) % 9, 3 + i % 2, 4 + 4 * (i % 3)) for i in range(16))
CUTS = (-0.5, 0.0, 0.5)
_GRAY = np.array([0, 1, 3, 2])
SHARD_ROWS = 4_096
BLOCK_ROWS = 1_024
# Measured on all pairs of 300 recordings, random notes and embeddings alike: bits of unrelated recordings differ this
# often, and vary as if this many of a frame's 32 bits were free.
CHANCE_ERROR = 0.45
FREE_BITS = 6.0
CHANCE = 0.01
PLANE_VALUES = 1 << 20
HELD_VALUES = 1 << 23


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A 16-bit mono WAV file."""
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def samples_of(file: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (channels averaged) and rate of a 16-bit PCM WAV file; no samples if it is none."""
    nothing = np.zeros(0), RATE
    if not file or len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return nothing
    at, rate, channels = 12, 0, 0
    while at + 8 <= len(file):
        tag, size = file[at:at + 4], struct.unpack("<I", file[at + 4:at + 8])[0]
        if tag == b"fmt " and at + 24 <= len(file):
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file[at + 8:at + 24])
            if code != 1 or bits != 16 or not channels or not rate:
                return nothing
        elif tag == b"data" and channels:
            body = file[at + 8:at + 8 + size]
            got = np.frombuffer(body[:len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
            return got.mean(axis=1), rate
        at += 8 + size + size % 2
    return nothing


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, classes): the share of each pitch class in each frame; a silent frame is even."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, CLASSES))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = hz >= LOWEST
    fold = np.zeros((len(hz), CLASSES))
    fold[np.flatnonzero(heard), np.round(CLASSES * np.log2(hz[heard] / LOWEST)).astype(int) % CLASSES] = 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ fold
    total = power.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, power / np.maximum(total, 1e-6), 1 / CLASSES)


def packed(image: np.ndarray) -> np.ndarray:
    """One integer of 32 bits for every frame that has ``SPAN`` frames from it on."""
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, CLASSES + 1))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(t: int, c: int, frames: int, classes: int) -> np.ndarray:
        at = np.arange(n) + t
        return integral[at + frames, c + classes] - integral[at, c + classes] - integral[at + frames, c] + integral[at, c]

    out = np.zeros(n, np.uint32)
    for shape, c, classes, frames in FILTERS:
        whole = area(0, c, frames, classes)
        if shape == 0:  # against what lies outside the stretch
            one, other = whole * CLASSES / classes, area(0, 0, frames, CLASSES)
        elif shape == 1:  # earlier against later
            one = area(0, c, frames // 2, classes)
            other = whole - one
        elif shape == 2:  # lower against higher classes
            one = area(0, c, frames, classes // 2) / (classes // 2)
            other = (whole - one * (classes // 2)) / (classes - classes // 2)
        else:  # the middle against both ends
            one = area(frames // 4, c, frames // 2, classes)
            other = whole - one
        ratio = np.log((one + 0.05) / (other + 0.05))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(CUTS, ratio)].astype(np.uint32)
    return out


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """``key`` and ``prints``, the packed integers (as signed 32 bits) of every whole recording; empty if it has none."""
    schema = StructType([media.schema[key], StructField("prints", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            prints = [packed(chroma(*samples_of(f))).view(np.int32) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.list_(pa.int32()))], names=schema.names)

    return media.select(key, audio).mapInArrow(run, schema)


def least_bits(overlap: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Minus the log of the chance that an alignment of unrelated recordings has so few differing bits (Chernoff); 0 where no fewer than usual."""
    e = np.minimum(differing / (32 * overlap), CHANCE_ERROR)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(e > 0, e * np.log(e / CHANCE_ERROR), 0) + (1 - e) * np.log((1 - e) / (1 - CHANCE_ERROR))
    return overlap * FREE_BITS * apart


def _spectrum(prints: list[np.ndarray], length: int, backwards: bool) -> np.ndarray:
    """(frequencies, recordings, bits): the transforms of the bits as +1 and -1, absent frames as 0."""
    planes = np.zeros((len(prints), 32, length), np.float32)
    for i, p in enumerate(prints):
        bits = ((p[None, :] >> np.arange(32, dtype=np.uint32)[:, None]) & np.uint32(1)).astype(np.float32)
        planes[i, :, :len(p)] = 2 * bits - 1
    out = np.fft.rfft(planes, axis=2)
    return np.ascontiguousarray((out.conj() if backwards else out).transpose(2, 0, 1))


def most_differing(longest: int, least: float) -> np.ndarray:
    """For each overlap from 0 to ``longest``: the most differing bits with which an alignment is as unlikely as ``least``; -1 where none is."""
    overlap = np.arange(1, longest + 1)
    low, high = np.full(longest, -1), 32 * overlap
    while (low + 1 < high).any():
        half = (low + high) // 2
        rare = least_bits(overlap, np.maximum(half, 0)) >= least
        low, high = np.where(rare, half, low), np.where(rare, high, half)
    return np.concatenate([[-1], low])


def alignments(queries: list[np.ndarray], records: list[np.ndarray], least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(query, recording, offset, equal integers, share of differing bits) of each pair whose best offset is as unlikely as ``least``.

    Every offset is looked at: whether an overlap differs in few enough bits is read from a table, and chances are
    only computed for the pairs that have such an offset. The best one is the least likely, then the smallest in size,
    then the smaller.
    """
    size = np.array([len(r) for r in records])
    by_size = np.argsort(size, kind="stable")
    longest = max(map(len, queries), default=0)
    most = most_differing(min(longest, int(size.max(initial=0))), least)
    at, left, of_length, of_query = 0, [], 0, -1
    while at < len(by_size):
        # Recordings of like size together, as many as keep a transform small.
        length = 1 << int(longest + min(2 * size[by_size[at]], size[by_size[-1]]) - 1).bit_length()
        some = by_size[at:at + max(1, PLANE_VALUES // (32 * length))]
        some = some[longest + size[some] <= length]
        at += len(some)
        right = _spectrum([records[r] for r in some], length, False)
        if length != of_length:
            step = max(1, PLANE_VALUES // (length * max(1, PLANE_VALUES // (32 * length))))
            parts = [queries[first:first + step] for first in range(0, len(queries), step)]
            # The transforms of queries serve all recordings of like size, if they are small enough to be held.
            left = [_spectrum(part, length, True) for part in parts] if 32 * length * len(queries) <= HELD_VALUES else []
            of_length = length
        of_query = -1
        for k, part in enumerate(parts):
            # (queries, recordings, offsets), offsets from 0 up and, at the end, from -1 down
            both = (left[k] if left else _spectrum(part, length, True)) @ right.transpose(0, 2, 1)
            same = np.fft.irfft(np.ascontiguousarray(both.transpose(1, 2, 0)), length, axis=2)
            for i, query in enumerate(part):
                if len(query) != of_query:
                    of_query, off = len(query), np.arange(length)
                    off = np.where(off < length - len(query) + 1, off, off - length)
                    overlap = np.maximum(np.minimum(len(query), size[some][:, None] - off) - np.maximum(0, -off), 0)
                    # Agreeing less differing bits; half a bit is left to rounding.
                    enough = np.where(most[overlap] < 0, np.inf, 32 * overlap - 2 * most[overlap] - 1).astype(np.float32)
                for r in np.flatnonzero((same[i] >= enough).any(axis=1)):
                    differing = 16 * overlap[r] - np.rint(same[i, r] / 2)
                    rare = np.where(overlap[r] > 0, least_bits(np.maximum(overlap[r], 1), np.maximum(differing, 0)), 0)
                    order = np.lexsort((off, np.abs(off)))
                    best = order[np.argmax(rare[order])]
                    if rare[best] >= least:
                        own, d = records[some[r]], int(off[best])
                        a, b = max(0, -d), min(len(query), len(own) - d)
                        x = query[a:b] ^ own[a + d:b + d]
                        yield k * step + i, int(some[r]), d, int((x == 0).sum()), float(np.bitwise_count(x).sum() / (32 * (b - a)))


def align(prints: DataFrame, is_query: Column, k: int | None = None, key: str = "id") -> DataFrame:
    """``query_id``, ``rank``, ``rec_id``, ``copies``, ``offset``, ``votes``, ``bit_error``: the recordings like each query, or the first ``k``.

    Recordings with equal fingerprints are one class, given by its smallest id
    and the number of its members; ``copies`` counts them, ``members`` lists
    them. A query's own class is among its results. ``offset`` is where the
    query starts in the other, in frames; ``votes`` counts the equal integers
    there. An alignment counts by the bits that differ over its whole overlap:
    among all offsets of all pairs, unrelated recordings give less than
    ``CHANCE`` such ones, so the bound tightens with their number. A class
    whose fingerprint equals the query's is always given. Recordings too short
    for a fingerprint and null ids take no part.
    """
    hits = _found(prints, is_query, key)
    w = W.partitionBy("query_id").orderBy("bit_error", "rec_id", "offset")
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k if k is not None else F.lit(True)).select("query_id", "rank", "rec_id", "copies", "offset", "votes", "bit_error")


def links(prints: DataFrame, is_query: Column, key: str = "id") -> DataFrame:
    """One row a query that ``align`` compares: its class, how many classes are like it, and the likest of these.

    ``class_id`` and ``copies`` are the query's own class; ``n_links`` and ``n_recordings`` count the other classes
    that ``align`` gives for it and their members, and ``links_hash`` is the exclusive or of the xxhash64 of their
    ``rec_id, offset, votes``, so that a lost or changed link shows. ``nearest``, ``offset``, ``votes`` and
    ``bit_error`` are those of the first of them by ``bit_error``, ``rec_id`` and ``offset``; null without any.
    Counts are combined before they are shuffled, so a query with very many links is no large group.
    """
    hits, own = _found(prints, is_query, key), F.col("own")
    best = F.min_by(F.struct("rec_id", "offset", "votes", "bit_error"), F.when(~own, F.struct("bit_error", "rec_id", "offset")))
    mark = F.bit_xor(F.when(~own, F.xxhash64("rec_id", "offset", "votes")))
    count = lambda c: F.coalesce(F.sum(F.when(~own, c)), F.lit(0))
    out = hits.groupBy("query_id").agg(F.min(F.when(own, F.col("rec_id"))).alias("class_id"), F.sum(F.when(own, F.col("copies"))).alias("copies"),
                                       count(F.lit(1)).cast("long").alias("n_links"), count(F.col("copies")).cast("long").alias("n_recordings"), best.alias("b"), mark.alias("links_hash"))
    return out.select("query_id", "class_id", "copies", "n_links", "n_recordings", F.col("b.rec_id").alias("nearest"), "b.offset", "b.votes", "b.bit_error", "links_hash")


def _found(prints: DataFrame, is_query: Column, key: str) -> DataFrame:
    """The rows of ``align`` without their ranks; ``own`` marks the class whose fingerprint equals the query's."""
    rows = prints.where(F.col(key).isNotNull() & (F.size("prints") > 0)).select(F.col(key).cast("long").alias("id"), "prints")
    digest = F.sha2(F.array_join("prints", " "), 256)
    classes = stored(rows.groupBy(digest.alias("d")).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("prints").alias("prints")))
    asked = stored(rows.where(is_query).distinct())
    frames = F.coalesce(F.sum(F.size("prints")), F.lit(0)).alias("f")
    (n, long), (q, wide) = (t.agg(F.count("*"), frames).first() for t in (classes, asked))
    least = math.log(max(long * q + wide * n, 1) / CHANCE)
    schema = StructType([StructField("query_id", LongType()), StructField("rec_id", LongType()), StructField("copies", LongType()), StructField("offset", IntegerType()), StructField("votes", IntegerType()), StructField("bit_error", DoubleType()), StructField("own", BooleanType())])

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if shard.num_rows and block.num_rows:
            ids, copies = shard.column("id").to_numpy(), shard.column("copies").to_numpy()
            lists = shard.column("prints").combine_chunks()
            flat = lists.flatten().to_numpy().view(np.uint32)
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            records = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
            queries = [np.array(p, np.int32).view(np.uint32) for p in block.column("prints").to_pylist()]
            asking = block.column("id").to_pylist()
            same = {r.tobytes(): i for i, r in enumerate(records)}
            hits = {(i, r): (d, v, e, False) for i, r, d, v, e in alignments(queries, records, least)}
            for i, p in enumerate(queries):
                if (r := same.get(p.tobytes())) is not None:
                    hits[i, r] = (0, len(p), 0.0, True)
            found = [(asking[i], int(ids[r]), int(copies[r]), *hit) for (i, r), hit in hits.items()]
        cols = list(zip(*found)) if found else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(schema.names, cols, kinds)})

    return in_blocks(classes.select("id", "copies", "prints"), asked, ["id"], n, q, SHARD_ROWS, BLOCK_ROWS, search, schema)


def members(prints: DataFrame, key: str = "id") -> DataFrame:
    """``id, rec_id``: the class of each recording that ``align`` compares, named as there."""
    rows = prints.where(F.col(key).isNotNull() & (F.size("prints") > 0)).select(F.col(key).cast("long").alias("id"), F.sha2(F.array_join("prints", " "), 256).alias("d"))
    return rows.join(rows.groupBy("d").agg(F.min("id").alias("rec_id")), "d").select("id", "rec_id").distinct()


def melodies(vectors: DataFrame, key: str, vector: str, note_samples: int = 256) -> DataFrame:
    """``key`` and ``audio``: a WAV file per vector, a note for each component, its pitch class from the component's size.

    Null vectors and components give silence. Stands for a media column where a table has none.
    """
    schema = StructType([vectors.schema[key], StructField("audio", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(note_samples) / RATE
        notes = np.stack([8000 * np.sin(2 * np.pi * 2 * LOWEST * 2 ** (c / CLASSES) * t) for c in range(CLASSES)] + [np.zeros(note_samples)])
        for b in small(batches):
            files = []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], float)
                heard = np.isfinite(x)
                pitch = np.where(heard, np.clip(np.floor(24 * np.where(heard, x, 0)) + 6, 0, CLASSES - 1), CLASSES).astype(int)
                files.append(wav(notes[pitch].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], names=schema.names)

    return vectors.select(key, vector).mapInArrow(run, schema)
