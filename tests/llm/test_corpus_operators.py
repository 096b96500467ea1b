import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_documents import TEXTS, edge_documents, no_documents
from llm_paths import SMALL
from sweepfield.llm import chroma, common, forest, mixing, near


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: (len(s), least[find(a)]) for a, (i, s) in enumerate(sets)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    base = max((t for _, t in docs if len(t.split()) < 600), key=lambda t: len(t.split()))
    for i in range(150):  # a chain and a cloud of near copies, some just over and some just under the bound
        words = base.split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5)}"
        docs.append((10_000 + i, " ".join(words)))
    docs += [(20_000, base.upper()), (20_001, base.replace(" ", "\n ")), (20_002, "a b c"), (20_003, "A  b C"), (20_004, "a b c d")]
    want = brute_components(docs)
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def template_texts(planted=30):
    """Different texts from one template, all just below 0.85 of each other, and ``planted`` near copies just above it."""
    rng = random.Random(11)
    base, docs = [f"t{j}" for j in range(430)], []
    for i in range(19 * 19):  # four words replaced, of which two texts share one place at most
        words = list(base)
        for k in range(4):
            words[5 * (19 * k + (i // 19 + i * k) % 19) + 5] = f"d{i}x{k}"
        docs.append(words)
    for i in range(planted):
        words = list(docs[i])
        for k, j in enumerate(rng.sample([j for j in range(5, 425, 5) if words[j][0] == "t"], 6)):
            words[j] = f"e{i}x{k}"
        docs.append(words)
    return [(i, " ".join(words)) for i, words in enumerate(docs)]


def test_near_duplicates_in_a_region_wider_than_the_window(spark):
    docs = template_texts()
    want = brute_components(docs)
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and sum(i != least for i, (_, least) in want.items()) == 30


def test_shingle_sets_have_the_right_sizes():
    texts = [t or "" for t in TEXTS] + ["a b c d e a b c d e a b c d e", "A b\x0bC\x0cd e", "x\x1cy z"]
    for t, s in zip(texts, near.shingle_sets(texts)):
        assert len(s) == len(shingles(t)), t[:40]
    assert (near.shingle_sets(["A b\tC d e f"])[0] == near.shingle_sets(["zzz", "a B c  D e f"])[1]).all()


def test_near_duplicates_edges(spark):
    rows = near.near_duplicates(edge_documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].component_id for i in (0, 1, 2)] == [0, 1, 2] and by[6][0].component_id == 5 and not by[6][0].kept
    assert len(by[4]) == 2 and all(r.kept and r.component_id == 4 for r in by[4]) and all(r.component_id is None and r.kept for r in by[None])
    assert near.near_duplicates(no_documents(spark)).count() == 0
    docs = edge_documents(spark)
    kept = near.keep_one(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(5) == 1 and ids.count(6) == 0 and ids.count(None) == 1 and {0, 1, 2} <= set(ids)
    assert near.keep_one(no_documents(spark)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and all(got[200 + i] == 200 for i in range(9))
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_nearest(ids, x, queries, k):
    out = {}
    for i in queries:
        s = (x * x[list(ids).index(i)]).sum(axis=1)
        out[i] = sorted((-v, j) for v, j in zip(s, ids) if j != i)[:k]
    return out


@pytest.mark.parametrize("shard,block,cover", [(forest.SHARD_ROWS, forest.BLOCK_ROWS, forest.COVER), (60, 7, forest.COVER)])
def test_nearest_recall(spark, shard, block, cover):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = forest.nearest(rows, F.col("id") % 20 == 0, shard_rows=shard, block_rows=block, cover=cover).collect()
    table = rows.toPandas().sort_values("vec_id")
    x = np.stack(table.embedding).astype(float)
    want = brute_nearest(table.vec_id.tolist(), x, [i for i in table.vec_id if i % 20 == 0], 20)
    hits = sum((r.vec_id in {j for _, j in want[r.query_id]}) for r in got)
    assert len(got) == 20 * len(want) and hits >= 0.9 * len(got)
    at = dict(zip(table.vec_id, x))
    assert all(abs(r.score - at[r.query_id] @ at[r.vec_id]) < 1e-12 for r in got)


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, []), (2, [1.0, 0.0]), (9, [-2.0, 0.5])]
    docs = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, v string")
    got = forest.nearest(docs, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 20, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0), (20, 3, 2, 3.0)]
    assert forest.nearest(docs.where("false"), F.col("id") % 20 == 0).count() == 0


def test_mixing_budgets_and_entropy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("big")).otherwise(F.col("source")))
    tokens = mixing.token_count("text")
    weights, x = mixing.source_weights(docs, "source", tokens, repeats=1.5)
    rows = weights.collect()
    assert abs(sum(r.weight for r in rows) - 1) < 1e-9 and 0 < x < 1
    reads = [r.weight / r.tokens for r in rows]
    assert max(reads) / min(reads) <= 1.5 + 1e-9 and max(reads) / min(reads) > 1.49
    total = sum(r.tokens for r in rows)
    goal = 0.5 * (math.log(len(rows)) - sum(r.tokens / total * math.log(r.tokens / total) for r in rows))
    weights, _ = mixing.source_weights(docs, "source", tokens, entropy=goal)
    assert abs(-sum(r.weight * math.log(r.weight) for r in weights.collect()) - goal) < 1e-4
    mixed = mixing.mix(docs, repeats=1.5)
    budget = {r.source: r.budget for r in mixing.source_weights(docs, "source", tokens, repeats=1.5)[0].collect()}
    largest = docs.agg(F.max(tokens)).first()[0]
    for r in mixed.groupBy("source").agg(F.sum(tokens).alias("t"), F.countDistinct("doc_id").alias("n")).collect():
        assert budget[r.source] <= r.t < budget[r.source] + 3 * largest
    assert mixed.where("mix_pass = 0").count() == docs.count() and mixed.select("doc_id", "mix_pass").distinct().count() == mixed.count() > docs.count()
    again = mixing.mix(docs.repartition(5), repeats=1.5).select("doc_id", "mix_pass", "mix_block", "mix_place")
    assert again.exceptAll(mixed.select(*again.columns)).count() == 0
    first, second = ([r.doc_id for r in mixing.mix(docs, repeats=3.0).where(f"source <> 'big' and mix_pass = {p}").orderBy("mix_block", "mix_place").collect()] for p in (0, 1))
    assert sorted(first)[:5] != first[:5] and [i for i in first if i in set(second)] != second


def test_mixing_edges(spark):
    docs = edge_documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.where("mix_pass = 0").count() == docs.count()
    assert mixed.columns[:-4] == [c for c in docs.columns if not c.startswith("mix_")]
    assert mixing.mix(no_documents(spark)).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).count() == 2


def tones(seed, n):
    rng = np.random.default_rng(seed)
    t = np.arange(256) / chroma.RATE
    return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 12) / 12) * t) for _ in range(n)])


def test_chroma_aligns_shifted_and_noisy_recordings(spark):
    whole = tones(1, 80)
    noisy = whole[128 * 20:] + np.random.default_rng(2).normal(0, 300, len(whole) - 128 * 20)
    files = [(0, chroma.wav(whole)), (1, chroma.wav(noisy)), (2, chroma.wav(tones(3, 80))), (3, chroma.wav(whole)), (4, None), (5, b"no audio"), (6, chroma.wav(np.zeros(100))), (None, chroma.wav(whole)), (7, chroma.wav(np.zeros(9000)))]
    media = spark.createDataFrame(files, "id long, audio binary")
    prints = chroma.fingerprints(media, "id", "audio")
    assert {r.id: len(r.prints) for r in prints.collect()}[4] == 0
    got = {(r.query_id, r.rec_id): r for r in chroma.align(prints, F.col("id") == 0).collect()}
    assert got[0, 0].bit_error == 0 and got[0, 0].offset == 0 and got[0, 0].copies == 2
    assert got[0, 1].offset == -20 and got[0, 1].bit_error < 0.2 and (0, 2) not in got
    assert chroma.align(prints.where("false"), F.col("id") == 0).count() == 0
    quiet = chroma.align(prints, F.col("id") == 7).collect()
    assert [(r.rec_id, r.bit_error) for r in quiet] == [(7, 0.0)]


@pytest.mark.parametrize("error", [0.0, 0.1, 0.2, 0.25])
def test_chroma_finds_noisy_bits_and_every_class(spark, error):
    rng = np.random.default_rng(17)
    whole = chroma.packed(chroma.chroma(tones(21, 120), chroma.RATE))
    rows = [(0, whole), (500, whole)] + [(i, chroma.packed(chroma.chroma(tones(100 + i, 90), chroma.RATE))) for i in range(1, 40)]
    for i in range(40, 70):  # thirty noisy cuts, each at its own offset
        cut = whole[i:i + 150].copy()
        flips = (rng.random((len(cut), 32)) < error) @ (1 << np.arange(32, dtype=np.uint64))
        rows.append((i, cut ^ flips.astype(np.uint32)))
    passage = chroma.packed(chroma.chroma(tones(200, 90), chroma.RATE)).copy()
    passage[100:130] = whole[60:90]  # shorter than 32 frames
    rows.append((80, passage))
    prints = spark.createDataFrame([(i, [int(x) for x in p.view(np.int32)]) for i, p in rows], "id long, prints array<int>")
    got = {r.rec_id: r for r in chroma.align(prints, F.col("id") == 0).collect()}
    assert set(range(40, 70)) <= set(got) and got[0].copies == 2 and not set(range(1, 40)) & set(got)
    assert all(got[i].offset == -i and abs(got[i].bit_error - error) < 0.03 for i in range(40, 70)) and got[80].offset == 40
    assert {r.id: r.rec_id for r in chroma.members(prints).collect()} == {i: 0 if i == 500 else i for i, _ in rows}


def test_chroma_gives_one_row_a_query(spark):
    rng = np.random.default_rng(23)
    tunes = [chroma.packed(chroma.chroma(tones(300 + i, 40), chroma.RATE)) for i in range(4)]
    flipped = lambda p: p ^ ((rng.random((len(p), 32)) < 0.1) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32)
    rows = [(i, tunes[0]) for i in (0, 1)] + [(i, flipped(tunes[0])) for i in range(2, 14)] + [(20, tunes[1]), (21, tunes[2][:30]), (22, tunes[2]), (23, tunes[2][5:]), (24, tunes[2]), (None, tunes[0]), (30, tunes[3][:0])]
    prints = spark.createDataFrame([(i, [int(x) for x in p.view(np.int32)]) for i, p in rows], "id long, prints array<int>")
    asks = F.col("id").isin(0, 1, 20, 21, 30)
    all_of = {}
    for r in chroma.align(prints, asks).withColumn("h", F.xxhash64("rec_id", "offset", "votes")).collect():
        all_of.setdefault(r.query_id, []).append(r)
    got = {r.query_id: r for r in chroma.links(prints, asks).collect()}
    assert set(got) == {0, 1, 20, 21} and got[0].n_links == got[1].n_links == 12 and got[21].n_links == 2 and got[21].n_recordings == 3
    for q, own in ((0, 0), (1, 0), (20, 20), (21, 21)):
        others = [r for r in all_of[q] if r.rec_id != own]
        mark = 0
        for r in others:
            mark ^= r.h
        assert (got[q].class_id, got[q].copies, got[q].n_links, got[q].n_recordings) == (own, 2 if own == 0 else 1, len(others), sum(r.copies for r in others))
        best = min(others, key=lambda r: (r.bit_error, r.rec_id, r.offset), default=None)
        assert (got[q].nearest, got[q].offset, got[q].votes, got[q].bit_error) == ((best.rec_id, best.offset, best.votes, best.bit_error) if best else (None,) * 4)
        assert got[q].links_hash == (mark if others else None)


def test_chroma_alignments_equal_a_loop_over_offsets(monkeypatch):
    asked = []
    chances = chroma.least_bits
    monkeypatch.setattr(chroma, "least_bits", lambda overlap, differing: asked.append(np.ndim(overlap)) or chances(overlap, differing))
    rng = np.random.default_rng(29)
    whole = chroma.packed(chroma.chroma(tones(400, 60), chroma.RATE))
    cut = lambda: whole[rng.integers(0, 60):][:rng.integers(1, 70)] ^ ((rng.random(32) < rng.choice([0, 0.2])) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32)
    queries, records = [cut() for _ in range(12)], [cut() for _ in range(30)] + [np.tile(whole[:9], 20)]
    strangers = [chroma.packed(chroma.chroma(tones(500 + i, 30), chroma.RATE)) for i in range(20)]
    for least in (6.0, 25.0):
        want = []
        for i, q in enumerate(queries):
            for j, r in enumerate(records):
                tried = []
                for d in sorted(range(1 - len(q), len(r)), key=lambda d: (abs(d), d)):
                    a, b = max(0, -d), min(len(q), len(r) - d)
                    x = q[a:b] ^ r[a + d:b + d]
                    bits = int(np.bitwise_count(x).sum())
                    tried.append((float(chances(np.array(b - a), np.array(bits))), d, int((x == 0).sum()), bits / (32 * (b - a))))
                best = max(tried, key=lambda t: t[0])
                if best[0] >= least:
                    want.append((i, j, *best[1:]))
        got = sorted(chroma.alignments(queries, records, least))
        assert [g[:4] for g in got] == [w[:4] for w in sorted(want)] and np.allclose([g[4] for g in got], [w[4] for w in sorted(want)])
    asked.clear()
    assert list(chroma.alignments(queries[:3], strangers, 40.0)) == [] and len(asked) < 16  # the table alone, not every pair


def test_chroma_filters_equal_direct_sums():
    image = np.random.default_rng(5).random((30, 12))
    got = chroma.packed(image)
    for at in (0, 7, len(got) - 1):
        value = 0
        for shape, c, classes, frames in chroma.FILTERS:
            part = lambda t, k, n, m: image[at + t:at + t + n, k:k + m].sum()
            whole = part(0, c, frames, classes)
            if shape == 0:
                one, other = whole * 12 / classes, part(0, 0, frames, 12)
            elif shape == 1:
                one = part(0, c, frames // 2, classes)
                other = whole - one
            elif shape == 2:
                one = part(0, c, frames, classes // 2) / (classes // 2)
                other = part(0, c + classes // 2, frames, classes - classes // 2) / (classes - classes // 2)
            else:
                one = part(frames // 4, c, frames // 2, classes)
                other = whole - one
            level = int(np.searchsorted(chroma.CUTS, np.log((one + 0.05) / (other + 0.05))))
            value = value << 2 | [0, 1, 3, 2][level]
        assert value == got[at]


def test_melodies_of_odd_vectors(spark):
    vectors = spark.createDataFrame([(1, [0.1, None, float("nan")]), (2, None), (3, [])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.audio for r in chroma.melodies(vectors, "vec_id", "embedding").collect()}
    assert len(chroma.samples_of(bytes(got[1]))[0]) == 768 and len(chroma.samples_of(bytes(got[2]))[0]) == 0
