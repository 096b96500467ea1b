"""Operators that work in blocks or partitions of bounded size give what they give in one."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepfield import storage
from sweepfield.bindings import source_queries
from sweepfield.operators import neighbors, planes
from sweepfield.operators.sampling import pack_batches
from sweepfield.operators.scans import greedy_chain, numbered
from sweepfield.operators.temporal import merge_last_frames, scan_line_outliers
from test_rules import packed


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_chains_followed_in_blocks(spark, block):
    draw = random.Random(3)
    links = [(k, p, None if p + 1 >= n or draw.random() < 0.01 else p + draw.randint(1, 12)) for k, n in (("a", 200), ("b", 1), ("c", 60)) for p in range(n)]
    led = {(k, p): n for k, p, n in links}
    want = set()
    for k in "abc":
        p = 0
        while p is not None:
            want.add((k, p))
            p = led.get((k, p))
    got = greedy_chain(spark.createDataFrame(links, "k string, pos long, nxt long"), ["k"], block=block).collect()
    assert sorted((r.k, r.pos) for r in got) == sorted(want)


def test_batches_over_several_blocks(spark):
    sizes = [(i * 37) % 11 for i in range(150)]
    got = pack_batches(spark.createDataFrame([("a", i, s) for i, s in enumerate(sizes)], "shard string, k long, size long"), ["shard"], "k", "size", 20, chunk=50.0, rows=16)
    assert [r.batch for r in got.orderBy("k").collect()] == packed(sizes, 20)


def test_batches_of_rows_that_come_twice(spark):
    sizes = [(i // 2 * 37) % 11 for i in range(300)]
    items = spark.createDataFrame([("a", i // 2, s) for i, s in enumerate(sizes)], "shard string, k long, size long").repartition(5)
    got = pack_batches(items, ["shard"], "k", "size", 20, chunk=50.0).groupBy("batch").count().orderBy("batch").collect()
    want = packed(sizes, 20)
    assert [r["count"] for r in got] == [want.count(b) for b in range(max(want) + 1)]


@pytest.mark.parametrize("rows", [2, 4096])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_neighbours_ranked_where_they_are_found(spark, monkeypatch, rows, by):
    monkeypatch.setattr(neighbors, "QUERY_ROWS", rows)
    monkeypatch.setattr(neighbors, "PAIRS", 16)
    draw = random.Random(5)
    points = [(i, i % 2, *(round(draw.random() * 1.5, 1) for _ in "xyz")) for i in range(80)]
    points += [(80, 0, None, 0.0, 0.0), (81, 1, float("nan"), 0.0, 0.0), (None, 0, 0.5, 0.5, 0.5), (3, 1, 0.2, 0.2, 0.2), (3, 1, 0.2, 0.2, 0.2)]
    df = spark.createDataFrame(points, "id long, g long, x double, y double, z double").repartition(3)
    q, s = df.withColumnRenamed("id", "q_id"), df.withColumnRenamed("id", "s_id")
    lists = defaultdict(list)
    for a in points:
        for b in points:
            if None not in (*a[2:], *b[2:]) and (not by or a[1] == b[1]):
                d2 = sum((u - v) * (u - v) for u, v in zip(a[2:], b[2:]))
                if d2 < 0.3 * 0.3:
                    lists[(a[1] if by else None, a[0])].append((d2, -1 if b[0] is None else b[0]))

    def rows_of(out):
        assert set(out.columns) == {*by, "q_id", "s_id", "d2", "rank"}
        return sorted(((r.g if by else None, -1 if r.q_id is None else r.q_id, -1 if r.s_id is None else r.s_id, r.d2, r["rank"]) for r in out.collect()), key=str)

    def ranked(order, most):
        return sorted(((g, -1 if i is None else i, m, d, k + 1) for (g, i), found in lists.items() for k, (d, m) in enumerate(sorted(found, key=order)[:most])), key=str)

    assert [r[:3] + r[4:] for r in rows_of(neighbors.radius_neighbours(q, s, 0.3, by, limit=3))] == [r[:3] + r[4:] for r in ranked(None, 3)]
    assert sorted(r[:3] + r[4:] for r in rows_of(neighbors.index_ordered_neighbours(q, s, 0.3, by))) == sorted(r[:3] + r[4:] for r in ranked(lambda r: r[1], None)) if by == ["g"] else True
    alone = q.where("q_id between 10 and 79")
    for out in (neighbors.radius_neighbours(alone, s, 0.3, by, limit=3), neighbors.index_ordered_neighbours(alone, s, 0.3, by)):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scans_over_more_partitions(spark):
    rows = spark.range(600).select((F.col("id") % 3).alias("line"), "id", F.when(F.col("id") % 50 < 3, 9.0).otherwise(1.0).alias("r"))
    plain, dealt = (scan_line_outliers(numbered(rows, ["line"], ["id"], F.floor(F.col("id") / 64), "i", n), [], "line", "i", "r", 5.0, 2, block=16, partitions=n).collect() for n in (None, 13))
    assert sorted(plain) == sorted(dealt) and any(r.outlier for r in plain)


def test_facts_of_frames_come_with_their_points(spark):
    points = spark.createDataFrame([("s", t, i) for t in range(5) for i in range(2)], "session string, ts long, id long")
    facts = spark.createDataFrame([("s", t, 10 * t) for t in range(4)], "session string, newest_ts long, cx long")
    plain = merge_last_frames(points, ["session"], "ts", 3).join(facts, ["session", "newest_ts"])
    got = merge_last_frames(points, ["session"], "ts", 3, facts=facts)
    assert sorted(got.select(*plain.columns).collect()) == sorted(plain.collect()) and got.count() == 18


def _placed(spark, rows, id_type="long"):
    return spark.createDataFrame(rows, f"g long, id {id_type}, x double, y double, z double")


@pytest.mark.parametrize("few", [neighbors.FEW_CELLS, 0])
@pytest.mark.parametrize("keep", ["far", "near"])
def test_proximity_searches_only_where_both_sides_are(spark, monkeypatch, keep, few):
    monkeypatch.setattr(neighbors, "FEW_CELLS", few)
    asked = []
    nearest = neighbors.nearest_join
    monkeypatch.setattr(neighbors, "nearest_join", lambda q, s, *a, **k: asked.append((q.count(), s.count())) or nearest(q, s, *a, **k))
    draw = random.Random(5)
    spot = lambda lo, hi: tuple(draw.uniform(lo, hi) for _ in range(3))
    mine = [(i % 2, i, *spot(0, 30)) for i in range(400)] + [(0, 1000 + i, *spot(40, 41)) for i in range(60)]
    others = [(i % 2, i, *spot(40, 41)) for i in range(80)] + [(0, i, *spot(-200, -100)) for i in range(300)]
    odd = [(0, 7, *spot(40, 41)), (0, 8, None, 0.0, 0.0), (1, 9, float("nan"), 0.0, 0.0), (None, 2001, *spot(40, 41)), (0, None, 1.0, 1.0, 1.0)]
    got = neighbors.proximity(_placed(spark, mine + odd), _placed(spark, others + odd[1:3]), 0.15, keep, ["g"]).select("g", "id", "x").collect()

    def nearest_of(g, p):
        return None if None in p or p[0] != p[0] else min(sum((a - b) ** 2 for a, b in zip(p, o[2:])) for o in others if o[0] == g)

    at = defaultdict(list)
    for g, i, *p in mine + odd:
        if g is not None and i is not None:
            d = nearest_of(g, p)
            at[g, i].append((p[0], d is None or d > 0.15 ** 2, d is not None and d < 0.15 ** 2))
    want = [(g, i, str(x)) for (g, i), rows in at.items() for x, _, _ in rows for _, far, near in rows if (far if keep == "far" else near)]
    assert sorted((r.g, r.id, str(r.x)) for r in got) == sorted(want)
    assert asked[0][0] < 80 and asked[0][1] < 90


def test_planes_of_few_groups_are_sent_to_the_points(spark):
    points = _placed(spark, [(i % 3, i, float(i * 7 % 50), float(i * 11 % 50), 0.0) for i in range(900)])
    plan = planes.ransac_plane(points, ["g"], 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert sorted((r.g, r.votes) for r in planes.ransac_plane(points, ["g"], 0.1).collect()) == [(0, 300), (1, 300), (2, 300)]


def _events(spark, folder, users):
    rows = [(i, users[i * 7 % len(users)], "view" if i % 3 else "click", i * 37 % 500 / 10) for i in range(4 * len(users))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1700000000)).write.parquet(f"{folder}/events.parquet")
    return rows


@pytest.mark.parametrize("name", ["csv_calibration", "log_iou"])
def test_many_small_files_are_read_in_lots(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(storage, "FILES_AT_ONCE", 16)
    monkeypatch.setattr(source_queries, "FILES_A_FOLDER", 8)
    listed = []
    read = storage.Files.names
    monkeypatch.setattr(storage.Files, "names", lambda self, name="": listed.append(name) or read(self, name))
    users = [k * 1009 for k in range(60)]
    rows = _events(spark, tmp_path, users)
    out = source_queries.__dict__[name](spark, str(tmp_path))
    # No plan knows the files of all users, and the driver asked for no names.
    assert not [f for f in out.inputFiles() if "calib_" in f or re.search(r"/\d+$", f)] and listed == []
    want = set()
    for u in users:
        own = [v for _, who, _, v in sorted(rows) if who == u]
        if name == "log_iou":
            want |= {(u, k, o, c, round(v / 100 + o + c / 10, 4)) for k, v in enumerate(own) for o, c in ((0, 0), (0, 1), (1, 0))}
        else:
            want.add((u, 0.0, 1.0, -(len(own) + 2.0) + 7, round(max(own) + 9, 6), 9.0))
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_small_files_are_published_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "write_files", None)
    rows = spark.range(300).selectExpr("concat('a%b=', id % 7, '/n ', id, '.txt') AS name", "cast(cast(id AS string) AS binary) AS content").repartition(3)
    storage.write_many(rows, f"file://{tmp_path}/out")
    for i in (0, 8, 299):
        assert (tmp_path / f"out/a%b={i % 7}/n {i}.txt").read_text() == f"{i}\n"
    assert len(list((tmp_path / "out").glob("a*/n*"))) == 300 and os.listdir(tmp_path / "out/_staging") == []
    twice = spark.createDataFrame([("x", b"1"), ("x", b"2"), ("y", b"3")], "name string, content binary")
    new = spark.createDataFrame([("z", b"1"), ("a%b=1/n 8.txt", b"2")], "name string, content binary")
    for wrong, said in ((twice, "repeat"), (new, "n 8.txt")):
        with pytest.raises(FileExistsError, match=said):
            storage.write_many(wrong, f"{tmp_path}/out")
        assert sorted(os.listdir(tmp_path / "out"))[:1] == ["_staging"] and not (tmp_path / "out/x").exists() and not (tmp_path / "out/z").exists()
        assert os.listdir(tmp_path / "out/_staging") == []
    storage.write_many(spark.createDataFrame([(None, b"1"), ("w", None)], "name string, content binary"), f"{tmp_path}/odd")
    assert (tmp_path / "odd/__HIVE_DEFAULT_PARTITION__").read_text() == "1\n" and (tmp_path / "odd/w").read_text() == "\n"


@pytest.mark.parametrize("rows", [1 << 12, 8])
@pytest.mark.parametrize("limit", [None, 4])
def test_supports_are_copied_to_few_blocks(spark, monkeypatch, rows, limit):
    monkeypatch.setattr(neighbors, "QUERY_ROWS", rows)
    monkeypatch.setattr(neighbors, "MOST_ROWS", 40 if rows == 8 else 1 << 16)
    monkeypatch.setattr(neighbors, "_FEW_PAIRS", 100)
    draw = np.random.default_rng(2)
    # A crowd at one place, another in one cell, and points all over, also below zero.
    p = np.vstack([np.full((90, 3), 0.35), draw.uniform(0.5, 0.55, (200, 3)), draw.uniform(-1, 1, (700, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double").repartition(3)
    dealt, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: dealt.append(self) or mapped(self, *a, **k))
    q, s = df.withColumnRenamed("id", "q_id"), df.withColumnRenamed("id", "s_id")
    out = neighbors.index_ordered_neighbours(q, s, 0.1) if limit is None else neighbors.radius_neighbours(q, s, 0.1, limit=limit)
    d = p[:, None, :] - p[None, :, :]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    want = set()
    for i in range(len(p)):
        near = np.flatnonzero(d2[i] < 0.1 * 0.1)
        if limit is not None:
            near = near[np.lexsort((near, d2[i][near]))][:limit]
        want |= {(i, int(k), float(d2[i, k]), r + 1) for r, k in enumerate(near)}
    got = [(r.q_id, r.s_id, r.d2, r["rank"]) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    copies = dealt[0].where("NOT _first").count() / len(p)
    levels = dealt[0].select("_level", "_share").distinct().collect()
    if rows > 8:
        assert copies < 5 and {r._level for r in levels} == {2}
    else:
        assert {r._level for r in levels} == {0, 1, 2} and max(r._share for r in levels) > 0
