"""Binary sensor logs: packet streams and packed frame files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The packet magic (four times 44444), hit record, and scaling of coordinates.
MAGIC = np.full(4, 44444, "<u2").tobytes()
HIT = np.dtype([("x", "<u2"), ("y", "<u2"), ("z", "<u2"), ("intensity", "u1"), ("laser", "u1")])
SCALE, OFFSET = 0.005, -100.0
HEADER = 24
# Hits that are held decoded at once.
STEP = 1 << 16

SCHEMA = "path string, utime long, seq long, x double, y double, z double, intensity int, laser int"


def _hits(raw: bytes | memoryview, count: int, at: int) -> dict:
    rows = np.frombuffer(raw, HIT, count, at)
    out = {a: rows[a].astype(float) * SCALE + OFFSET for a in "xyz"}
    return out | {"intensity": rows["intensity"].astype("i4"), "laser": rows["laser"].astype("i4")}


def decode_packets(raw: bytes | memoryview) -> Iterator[tuple[int, dict]]:
    """(utime, hits) of each packet, of a long one in several steps; a wrong magic is an error, a cut last packet ends the log."""
    at = 0
    while at + HEADER <= len(raw):
        if raw[at:at + 8] != MAGIC:
            raise ValueError(f"bad packet magic at byte {at}")
        count = int.from_bytes(raw[at + 8:at + 12], "little")
        utime = int.from_bytes(raw[at + 12:at + 20], "little")
        at += HEADER
        if at + count * HIT.itemsize > len(raw):
            return
        for first in range(0, count, STEP):
            yield utime, _hits(raw, min(STEP, count - first), at + first * HIT.itemsize)
        at += count * HIT.itemsize


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview]]:
    """Path and content of each file; the content is not copied."""
    for b in batches:
        for name, raw in zip(b.column("path"), b.column("content")):
            yield name.as_py(), memoryview(raw.as_buffer()).cast("B")


def _batch(name: str, seq: int, hits: dict, utime: int | None = None) -> pa.RecordBatch:
    n = len(hits["x"])
    columns = {"path": pa.repeat(name, n)} | ({} if utime is None else {"utime": pa.repeat(pa.scalar(utime, pa.int64()), n)})
    columns |= {"seq": pa.array(np.arange(seq, seq + n))} | {c: pa.array(v) for c, v in hits.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_packets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Hits of all packet logs below ``path`` with their packet time and running number in the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, raw in _contents(batches):
            seq = 0
            for utime, hits in decode_packets(raw):
                yield _batch(name, seq, hits, utime)
                seq += len(hits["x"])

    return files.mapInArrow(rows, SCHEMA)


def read_packed_frames(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Hits of files that hold nothing but hit records, one frame per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, raw in _contents(batches):
            total = len(raw) // HIT.itemsize
            for first in range(0, total, STEP):
                yield _batch(name, first, _hits(raw, min(STEP, total - first), first * HIT.itemsize))

    return files.mapInArrow(rows, SCHEMA.replace("utime long, ", ""))
