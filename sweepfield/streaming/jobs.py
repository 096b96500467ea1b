"""Structured Streaming forms of the mergeable operators.

State is either Spark's own (windows, keyed state, timers) or a table that each
micro-batch is merged into. A restarted batch finds the table of the batch
before it under its own number, so a retry gives the same result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.evidence import ray_evidence
from ..operators.mapping import first_hit_state, merge_first_hit
from .tables import BucketedTable


class VersionedTable:
    """A Parquet table with one folder per batch number; readers take the newest complete one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch:012d}"

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("batch=")
                and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def before(self, batch: int) -> DataFrame | None:
        older = [v for v in self._versions() if v < batch]
        return self.spark.read.parquet(self._folder(older[-1])) if older else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(batch))

    def every(self) -> DataFrame | None:
        """All versions below one another: what a query in update mode has said so far."""
        have = self._versions()
        return self.spark.read.parquet(*(self._folder(v) for v in have)) if have else None

    def latest(self) -> DataFrame | None:
        have = self._versions()
        return self.spark.read.parquet(self._folder(have[-1])) if have else None


def stream_first_hit_map(points: DataFrame, dl: float, table: BucketedTable, checkpoint: str,
                         frame: str = "frame_idx", p_id: str = "id", **trigger):
    """Incremental first-hit map: each micro-batch is reduced, then merged into the buckets of the voxels it hits."""

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(first_hit_state(batch, dl, frame, p_id), number, merge_first_hit)

    return (points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def whole_frames(points: DataFrame, frame: list[str], ts: str, lateness: str) -> DataFrame:
    """The points of each frame together, once the watermark has passed the frame's time ``ts``.

    Spark's state holds the points that have come so far, a list for each frame; points that come later
    than ``lateness`` allows are dropped. ``ts`` is an event-time timestamp, one for all points of a frame.
    """
    rest = [c for c in points.columns if c not in (*frame, ts)]
    held = points.withWatermark(ts, lateness).groupBy(*frame, ts).agg(F.collect_list(F.struct(*rest)).alias("_points"))
    return held.select(*frame, ts, F.explode("_points").alias("_p")).select(*frame, ts, "_p.*")


def stream_ray_evidence(points: DataFrame, poses: DataFrame, map_points: DataFrame, frame: list[str],
                        theta_dl: float, phi_dl: float, dl: float, table: BucketedTable, checkpoint: str,
                        map_id: str = "map_id", ts: str | None = None, lateness: str = "10 seconds", **trigger):
    """Ray-evidence counters against a fixed map.

    With ``ts`` a frame may arrive in parts, in several micro-batches, and is
    judged once the watermark has passed it (see :func:`whole_frames`). Without,
    it must arrive whole within one micro-batch.
    """
    frames = points if ts is None else whole_frames(points, frame, ts, lateness).drop(ts)

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy(map_id).agg(F.sum("count").alias("count"), F.sum("prob").alias("prob"))

    def add(batch: DataFrame, number: int) -> None:
        # The evidence reads its points several times; the state behind them is read once.
        batch.persist()
        if not batch.isEmpty():
            table.merge(ray_evidence(batch, poses, map_points, frame, theta_dl, phi_dl, dl, map_id=map_id), number, total)
        batch.unpersist()

    return (frames.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


class HorizonWindows(StatefulProcessor):
    """Pending frames of one key; its one event-time timer is that of the frame that closes the oldest one's window."""

    def __init__(self, schema: StructType, start: float, future: float):
        self.schema, self.start, self.span = schema, start, future - start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", StructType([StructField("ts", DoubleType())]))

    def _times(self) -> list[float]:
        return [r[0] for r in self.pending.get()] if self.pending.exists() else []

    def _closing(self, times: list[float]) -> int | None:
        """When the watermark has passed the frame that closes the first window."""
        end = bisect_right(times, times[0] + self.span) if times else 0
        return math.ceil(times[end] * 1000) if end < len(times) else None

    def _keep(self, times: list[float], before: int | None) -> None:
        self.pending.put([(t,) for t in times])
        after = self._closing(times)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._times()
        new = set().union(*(set(r["ts"].tolist()) for r in rows)) - set(old)
        if new:
            self._keep(sorted(new.union(old)), self._closing(old))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Emit every window that a frame not later than the watermark closes, and forget its oldest frame."""
        times, upto = self._times(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known = bisect_right(times, upto, key=lambda t: math.ceil(t * 1000))
        rows, oldest = [], 0
        while oldest < known and (end := bisect_right(times, times[oldest] + self.span, 0, known)) < known:
            window = times[oldest:end + 1]
            aim = window[0] - self.start
            origin = min(window, key=lambda t: (abs(t - aim), t))
            rows += [(*key, window[0], origin, t, t - origin) for t in window]
            oldest += 1
        if oldest:
            # The timer that fired is gone by itself.
            self._keep(times[oldest:], None)
            yield pd.DataFrame(rows, columns=self.schema.names)

    def close(self) -> None:
        pass


def stream_horizon(frames: DataFrame, by: list[str], ts: str, start: float, future: float,
                   lateness: str = "10 seconds") -> DataFrame:
    """Frames of each future-horizon window, as ``temporal.horizon_windows`` gives them, once the watermark has passed its closing frame.

    ``ts`` is an event-time timestamp; ``start`` must not be positive, so that a
    window's origin lies in it. The state of a key is its frames of the last
    span and lateness. Frames that repeat count once; later ones than the
    watermark allows are dropped. Needs the RocksDB state store.
    """
    if start > 0 or future <= start:
        raise ValueError("start must not be positive, and less than future")
    schema = StructType([frames.schema[k] for k in by] + [StructField(c, DoubleType()) for c in ("oldest_ts", "origin_ts", "frame_ts", "t")])
    timed = frames.select(*by, F.col(ts).alias("_event"), F.col(ts).cast("double").alias("ts")).withWatermark("_event", lateness)
    return timed.groupBy(*by).transformWithStateInPandas(HorizonWindows(schema, start, future), schema, "append", "EventTime")


def stream_votes(votes: DataFrame, by: list[str], order: str, values: list[str], smooth: float = 0.95) -> DataFrame:
    """Vote smoothing with keyed state (update mode): p <- s p + (1 - s) new, starting at 0."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in votes.select(*by).schema)
    cells = ", ".join(f"{v} double" for v in values)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(state.get) if state.exists else [0.0] * len(values) + [0]
        new = pd.concat(list(batches)).sort_values(order)[list(values)].to_numpy(float)
        # The recursion over a micro-batch is one weighted sum.
        weight = (1 - smooth) * smooth ** np.arange(len(new) - 1, -1, -1.0)
        p, n = smooth ** len(new) * np.array(old[:-1]) + weight @ new, old[-1] + len(new)
        state.update((*map(float, p), int(n)))
        yield pd.DataFrame([(*key, *p, n)], columns=[*by, *values, "votes"])

    return votes.groupBy(*by).applyInPandasWithState(
        update, f"{keys}, {cells}, votes long", f"{cells}, votes long", "update", GroupStateTimeout.NoTimeout)


def stream_window_stats(events: DataFrame, by: list[str], ts: str, value: str, width: str,
                        slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Count, sum and rate per event-time window and key."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, lateness) if events.isStreaming else events
    stats = out.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    seconds = F.col("w.end").cast("double") - F.col("w.start").cast("double")
    return stats.select(F.col("w.start").alias("window_start"), *by, "n", "total", (F.col("n") / seconds).alias("rate"))


def stream_sessions(events: DataFrame, by: list[str], ts: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Runs of events without a gap of at least ``gap``."""
    out = events.withWatermark(ts, lateness) if events.isStreaming else events
    runs = out.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
