import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_documents import edge_documents, no_documents
from llm_paths import SMALL
from sweepfield.llm import audit, prints, variants


def tables(spark):
    extra = [(100 + i, t) for i, t in enumerate(["one", " one", "one ", "one\t\ttwo", "one \n two", "", None] * 3)]
    many = spark.createDataFrame(extra, "doc_id long, text string").selectExpr("*", "cast(null as string) AS source", "'x' AS sha", "0 AS row", "'h' AS hash", "1 AS part", "2 AS w")
    return [spark.read.parquet(f"{SMALL}/documents.parquet"), edge_documents(spark), many.repartition(5)]


# --- exact duplicates ---


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 40) - 1)), st.integers(40, 44))
def test_golomb_round_trip(values, bits):
    values = np.array(sorted(values), np.int64)
    k, high, low = prints.golomb(values, 1 << bits)
    assert (prints.ungolomb(len(values), k, high, low) == values).all()


def test_golomb_is_short():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 20_000))
    _, high, low = prints.golomb(values, 1 << 40)
    # About log2(width / n) + 1.5 bits a value, against 64 for the plain hash.
    assert 8 * (len(high) + len(low)) / len(values) < np.log2((1 << 40) / len(values)) + 2.2


def brute_duplicates(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = (min(known) if known else None), hashlib.sha256(t.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            out[i, keep, len(ids), n == 0, sha] += 1
    return out


def test_exact_duplicates_equal_brute_force(spark):
    for docs in tables(spark):
        want = brute_duplicates([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert Counter(map(tuple, prints.exact_duplicates(docs).collect())) == want
    assert prints.exact_duplicates(no_documents(spark)).collect() == []


def test_many_senders_and_owners(spark, monkeypatch):
    monkeypatch.setattr(prints, "SENDER_BITS", 4)
    monkeypatch.setattr(prints, "OWNER_PRINTS", 8)
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' ELSE concat('text ', id % 1500) END AS text").repartition(7)
    want = brute_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, prints.exact_duplicates(docs).collect())) == want


def test_full_bits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prints, "MOST_BITS", 7)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id % 1200) AS text")
    assert Counter(map(tuple, prints.exact_duplicates(docs).collect())) == brute_duplicates([(r.doc_id, r.text) for r in docs.collect()])


# --- filter audit ---


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, p in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[p or ""].append(({f for f in "ABCDE" if fails[f]}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = share[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark):
    ids = [(i, i % 3 % 2, i % 5 % 2) for i in (*range(0, 130), 3)] + [(None, 1, 1)]
    for docs, labels in zip(tables(spark), [spark.read.parquet(f"{SMALL}/labels.parquet"), *[spark.createDataFrame(ids, "doc_id long, quality int, toxic int")] * 2]):
        want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
        rows = audit.filter_audit(docs, labels).collect()
        got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
        assert len(rows) == len(got) and got == want
    assert audit.filter_audit(no_documents(spark), labels).collect() == []


def test_a_part_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BITS", 4)
    docs = spark.range(700).selectExpr("id AS doc_id", "concat(repeat('Word ', cast(id % 60 as int)), CASE WHEN id % 7 = 0 THEN '#' ELSE '' END) AS text", "if(id % 3 = 0, 'hot', concat('p', id % 4)) AS source").repartition(3)
    labels = spark.range(0, 700, 3).selectExpr("id AS doc_id", "cast(id % 2 as int) AS quality", "cast(id % 4 = 1 as int) AS toxic")
    want = brute_audit([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in audit.filter_audit(docs, labels).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 300)), min_size=1, max_size=7))
def test_regions_equal_sets(sets):
    want = Counter(sum(1 << k for k, s in enumerate(sets) if i in s) for i in set().union(*sets))
    assert audit.regions([sorted(s) for s in sets]) == dict(want)


# --- spelling variants ---


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


words = st.lists(st.text("abcé", min_size=1, max_size=9), max_size=60, unique=True)


@settings(max_examples=60, deadline=None)
@given(words)
def test_near_pairs_equal_brute_force(vocabulary):
    a, b = variants.near_pairs(vocabulary)
    got = [(vocabulary[i], vocabulary[j]) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in vocabulary for y in vocabulary if one_edit(x, y)}


def test_index_in_several_pieces(monkeypatch):
    monkeypatch.setattr(variants, "INDEX_CELLS", 1)
    monkeypatch.setattr(variants, "CHUNK_WORDS", 40)
    rng = random.Random(1)
    vocabulary = list({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(600)})
    a, b = variants.near_pairs(vocabulary)
    assert {(vocabulary[i], vocabulary[j]) for i, j in zip(a, b)} == {(x, y) for x in vocabulary for y in vocabulary if one_edit(x, y)}


@pytest.mark.parametrize("key_words", (variants.KEY_WORDS, 8))
def test_near_words_meet_in_a_block(spark, monkeypatch, key_words):
    """Also where keys are split again and again, as with words that share most of their letters."""
    monkeypatch.setattr(variants, "KEY_WORDS", key_words)
    monkeypatch.setattr(variants, "BLOCK_WORDS", 64)
    rng = random.Random(2)
    vocabulary = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))).join(("prefix", rng.choice(("", "suffix")))) + rng.choice(("", "a", "bc")) for _ in range(400)} | {"z" * n for n in range(6, 40)})
    got = variants.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "word string, n long")).distinct().collect()
    place = {w: i for i, w in enumerate(vocabulary)}
    assert {(r.word, r.near) for r in got} == {(x, y) for x in vocabulary for y in vocabulary if one_edit(x, y)} and all(place[r.near] == r.near_n for r in got)


def brute_variants(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    meet = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            meet[w[:i] + "\0" + w[i + 1:]].add(w)
            meet[w[:i] + w[i + 1:]].add(w)
        meet[w].add(w)
        for i in range(len(w) + 1):
            meet[w[:i] + "\0" + w[i:]].add(w)
    near = {w: {v for m in ([w] + [w[:i] + w[i + 1:] for i in range(len(w))] + [w[:i] + "\0" + w[i + 1:] for i in range(len(w))]) for v in meet[m] if one_edit(w, v)} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(5)
    chain = ["abcdefg"] * 700 + ["abcdefh"] * 130 + ["abcdxfh"] * 25 + ["abcdxfhh"] * 5 + ["Straße", "STRAßE", "straßen"] * 20 + ["ünïcode"] * 5
    rng.shuffle(chain)
    made = spark.createDataFrame([(i, " ".join(chain[i::11])) for i in range(11)] + [(None, " ".join(chain)), (50, None), (51, "")], "doc_id long, text string")
    for docs in (*tables(spark)[:2], made):
        want = brute_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        rows = variants.spelling_variants(docs).collect()
        assert len(rows) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want
    assert any(root != form and form for form, root, *_ in want.values())
    assert variants.spelling_variants(no_documents(spark)).collect() == []
