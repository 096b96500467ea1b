import base64
import gzip
import hashlib
import random
import re
import urllib.parse

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_paths import SMALL
from edge_documents import LONG, TEXTS, edge_documents, no_documents
from sweepfield.llm import bpe, language, licenses, pii, quality, secrets

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (200, 60), (64, 24)])
def test_bpe_equals_the_library(spark, documents, encoding, chunk, overlap):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)] + [(-99, "a b" + " " * 150 + "c" * 190 + "  d")], "doc_id long, text string"))
    want = {r.doc_id: encoding.encode_ordinary(r.text or "") for r in docs.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.digest(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == sha(" ".join(map(str, want[r.doc_id])))
        assert r.decoded_sha256 == sha(texts[r.doc_id])


def test_bpe_ids_by_stretches(spark, encoding):
    docs = spark.createDataFrame([(1, LONG), (2, None)], "doc_id long, text string")
    rows = bpe.encode_ids(docs, RANKS, PATTERN, chunk=1000, overlap=100).orderBy("part").collect()
    assert sum((r.ids for r in rows if r.doc_id == 1), []) == encoding.encode_ordinary(LONG)
    assert sum(r.doc_id == 1 for r in rows) > 50 and [r.ids for r in rows if r.doc_id == 2] == [[]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\t'rsve.é!", max_size=120), st.integers(10, 40))
def test_stitches_are_true_boundaries(text, body):
    compiled = regex.compile(PATTERN)
    true = {m.end() for m in compiled.finditer(text)}
    cut = text[:body + 20]
    q = bpe.stitch(compiled, cut, body, 20, False)
    assert q is None or q in true


def brute_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_base_equals_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in secrets.scan_secrets(documents).collect():
        assert r.base_sha256 == sha(brute_secrets(texts[r.doc_id]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="tokens=:\"' AKIAKEY01af9/", max_size=90))
def test_secrets_base_on_random_texts(text):
    for t in (text, "x token = " + text, text.replace("s", "AKIA") + "ſecret: abcdefghij" + text):
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.base_spans(t)) == brute_secrets(t)


@pytest.mark.parametrize("wrap", ["url", "unicode", "base64", "gzip", "all"])
def test_secrets_in_layers(wrap):
    inner = "password=hunter2hunter2"
    coded = {"url": lambda s: "".join(f"%{b:02X}" for b in s.encode()), "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
             "base64": lambda s: base64.b64encode(s.encode()).decode(), "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode()}
    for name in (["url", "unicode", "base64", "gzip"] if wrap == "all" else [wrap]):
        inner = coded[name](inner)
    text = f"é see {inner} end"
    base, spans, layers = secrets.scan(text)
    assert base == [] and layers >= (4 if wrap == "all" else 1)
    if wrap == "all":
        assert all((a, b) == (6, 6 + len(inner)) or 6 <= a < b <= 6 + len(inner) for _, a, b in spans)
    assert ("assign", 6, 6 + len(inner)) in spans


def test_secrets_partly_escaped_and_cycles():
    text = "token%3Dabcdefgh1 and %2525252541"
    base, spans, _ = secrets.scan(text)
    assert base == [] and spans == [("assign", 0, 17)]
    assert secrets.scan("%" * 50 + "25" * 50)[2] < 200
    blob = base64.b64encode(b"A" * 30).decode()
    assert secrets.scan(blob + " " + blob)[0] == []


@pytest.mark.parametrize("width,end", [(76, "\n"), (64, "\r\n"), (60, "\n    ")])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda b: b"\x00\x01\xff" + b + b"\x00\xfe"])
def test_secrets_in_wrapped_and_binary_layers(width, end, pack):
    rng = random.Random(6)
    body = " ".join(f"é{rng.random()}" for _ in range(30)) + " password=hunter2hunter2 " + " ".join(str(rng.random()) for _ in range(9))
    for shift in range(0, 60, 7):  # the secret crosses a line somewhere
        blob = base64.b64encode(pack((" " * shift + body).encode())).decode()
        lines = end.join(blob[i:i + width] for i in range(0, len(blob), width))
        base, spans, _ = secrets.scan(f"see\n{lines}\nend")
        assert base == [] and ("assign", 4, 4 + len(lines)) in spans


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_base_equals_brute_force(spark, documents):
    more = spark.createDataFrame([(-1, "mit license mit license Gnu-General public_license"), (-2, "X cc-by cc by cc\nBY Apache LICENSE"), (-3, "éMIT License, mit  license"), (-4, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize("expression,ways", [("mit", [{"mit"}]), ("mit or apache-2.0 and bsd-3-clause", [{"mit"}, {"apache", "bsd"}]), ("(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0", [{"apache", "gpl"}, {"gpl", "mit"}]),
                                             ("mit or", None), ("( mit", None), ("mit mit", None), ("or mit", None)])
def test_license_expressions(expression, ways):
    got = licenses.choices(expression.replace("(", "( ").replace(")", " )").split())
    assert (None if got is None else sorted(map(sorted, got))) == (None if ways is None else sorted(map(sorted, ways)))


def test_license_tags(spark):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint x;"), (2, "spdx-license-identifier: OR"), (3, "SPDX-License-Identifier: MIT */ more words")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got[1] == ("apache,bsd,mit", 1.0) and got[2] == ("", 0.0) and got[3] == ("mit", 1.0)


def test_license_tags_of_any_length():
    scan = licenses._scanner()
    names = [f"l{i}" for i in range(300)]
    for line in (" and ".join(names), "(" + " and ".join(names) + ")", "(" * 80 + "mit" + ")" * 80 + " and l7"):
        *_, labels, score, ways = scan(f"# SPDX-License-Identifier: {line} */ more")
        assert score == 1.0 and ways == 1 and labels.split(",") == (sorted(names) if "l299" in line else ["l7", "mit"])


def test_license_ways_are_counted_and_not_listed():
    pairs = " and ".join(f"(l{2 * i} or l{2 * i + 1})" for i in range(40))
    *_, labels, score, ways = licenses._scanner()(f"SPDX-License-Identifier: {pairs}")
    assert score == 1.0 and ways == 2 ** 40 and len(labels.split(",")) == 80
    assert licenses._scanner()("SPDX-License-Identifier: " + pairs.replace("l", "a") + " and " + pairs.replace("l", "b"))[-1] == licenses.MOST_WAYS
    assert licenses._scanner()("SPDX-License-Identifier: " + " and ".join(f"l{i}" for i in range(4000)))[-1] == 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["(", ")", "and", "or", "with", "mit", "isc"]), max_size=12))
def test_license_tags_are_the_longest_wellformed_start(tokens):
    found = licenses.tagged(" ".join(tokens).encode())
    if found:
        ways = licenses.choices(found)
        assert licenses.labels_and_ways(found) == ({x for way in ways for x in way}, len(ways))
    want = next((tokens[:n] for n in range(len(tokens), 0, -1) if licenses.postfix(tokens[:n]) is not None), [])
    assert licenses.tagged(" ".join(tokens).encode()) == want


def brute_pii(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_pii_base_equals_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = pii.find_pii(documents, pii.train(documents)).collect()
    for r in rows:
        want = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == sha(want) and set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert len(rows) == len(texts)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+_ 0123456789()é%", max_size=80))
def test_pii_base_on_random_texts(text):
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)) == brute_pii(text)


def test_pii_trees_add_what_looks_alike_and_keep_the_rest():
    rng = random.Random(4)
    texts = []
    for i in range(600):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        texts.append(f"text {rng.randint(1, 10**9)} call {phone} or a{i}@b{i}.example.com and {rng.randint(10**8, 10**13)} from 10.{i % 256}.3.{rng.randint(0, 400)} ok")
    rows = np.array([r for t in texts for r in pii._taught(t)[0]])
    scorer = pii.fit(rows[:, :-1], rows[:, -1])
    held = rows[3::4]
    p = scorer.score(held[:, :-1])
    assert ((p >= 0.5) == held[:, -1]).mean() > 0.97
    assert pii.redacted("mail me: x.y@z.example.com, +1 (555) 555-0199!", scorer) == "mail me: <EMAIL>, <PHONE>!"
    assert pii.redacted("plain words only", scorer) == "plain words only"
    assert pii.fit(np.zeros((0, len(pii.FEATURES))), np.zeros(0)) is pii.NOTHING


def test_pii_trees_add_forms_that_the_base_rules_miss(spark):
    rng = random.Random(8)

    def digits(n):
        return "".join(str(rng.randint(0, 9)) for _ in range(n))

    def card():
        while True:
            if pii.luhn(d := digits(16)):
                return d

    docs = []
    for i in range(900):
        docs.append((i, f"some words {digits(rng.randint(6, 18))} then +1 ({rng.randint(200, 999)}) 555-{digits(4)} or a{i}@b{i}.example.com, paid {card()} from 10.{i % 256}.3.{rng.randint(0, 255)} in {rng.randint(1900, 2030)} ok"))
    scorer = pii.train(spark.createDataFrame(docs, "doc_id long, text string"))
    finds = {"email": "jo.hill (at) example (dot) com", "phone": "(555) 123-4567", "card": ".".join([(c := card())[:4], c[4:8], c[8:12], c[12:]]), "ip": "10[.]77[.]3[.]12"}
    for kind, s in finds.items():
        text = f"some words then {s} or more words ok"
        base, spans, _ = pii.all_spans(text, scorer)
        assert base == [] and (kind, 16, 16 + len(s)) in spans, kind
        assert s not in pii.redacted(text, scorer)
    assert pii.all_spans("some words in 1999 and 12345678 or 2024 ok", scorer)[1] == []


def test_quality_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ensemble = quality.train(docs, labels)
    got = quality.score_quality(docs, ensemble).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    stats = quality.document_statistics(docs.limit(50), ["doc_id"])
    rows = stats.withColumn("score", ensemble.column()).collect()
    assert np.allclose([r.score for r in rows], ensemble.score(np.array([[r[f"s_{s}"] for s in quality.STATS] for r in rows])))


def test_language_gradients_are_right():
    rng = np.random.default_rng(1)
    size, c, n, lanes = 2, 3, 5, 4
    w = {k: rng.normal(0, 0.5, s) for k, s in (("t0", (3 * size, 256)), ("t1", (3 * size, 256)), ("u0", (3 * size, size)), ("u1", (3 * size, size)), ("o", (c, 2 * size)), ("b", (c,)))}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    x = rng.integers(97, 103, (n, lanes))
    truth = rng.integers(0, c, lanes)

    def loss():
        p = language.position_probabilities(language.Model(["a", "b", "c"], [w["t0"], w["t1"]], [w["u0"], w["u1"]], w["o"], w["b"]), x)
        return -np.log(p[:, truth, np.arange(lanes)]).mean()

    grads = language._gradients(w, x, truth)
    for k, at in (("t0", (1, 98)), ("t1", (5, 99)), ("t0", (4, 100)), ("u0", (0, 1)), ("u1", (3, 0)), ("u0", (5, 1)), ("o", (1, 2)), ("b", (0,))):
        held, step = w[k][at], 1e-2
        w[k][at] = held + step
        up = loss()
        w[k][at] = held - step
        down = loss()
        w[k][at] = held
        assert abs((up - down) / (2 * step) - grads[k][at]) < 2e-3, (k, at)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.train(docs), ["doc_id", "lang"]).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_edges_of_text_operators(spark):
    model = language.Model(["de", "en"], *(lambda r: ([r.normal(size=(12, 256)).astype("f4")] * 2, [r.normal(size=(12, 4)).astype("f4")] * 2, r.normal(size=(2, 8)).astype("f4"), np.zeros(2, "f4")))(np.random.default_rng(0)))
    ensemble = quality.Ensemble([quality.Rule([(0, True, 5.0)], -1.0)], 0.5)
    for docs, n in ((edge_documents(spark), len(TEXTS) + 3), (no_documents(spark), 0)):
        scorer = pii.train(docs)
        for made in (bpe.digest(docs, RANKS, PATTERN, chunk=1000, overlap=100), secrets.scan_secrets(docs), licenses.scan_licenses(docs), pii.find_pii(docs, scorer),
                     quality.score_quality(docs, ensemble), language.predict(docs, model, ["doc_id"])):
            rows = made.collect()
            assert len(rows) == n and sum(r.doc_id is None for r in rows) == (2 if n else 0)
            assert all(r.score is not None and 0 <= r.score <= 1 for r in rows if "score" in made.columns)
        red = pii.redact(docs, scorer)
        assert red.schema == docs.schema and red.count() == n
        assert language.train(no_documents(spark)) is None
    said = {r.doc_id: r for r in language.predict(edge_documents(spark), None, ["doc_id"]).collect()}
    assert said[0].lang_pred == "und" and said[10].score == 0.0
    letters = {r.doc_id: r.lang_pred for r in language.predict(edge_documents(spark), model, ["doc_id"]).collect()}
    assert letters[0] == letters[1] == letters[2] == letters[11] == "und" and letters[9] != "und"


def test_quality_without_labels(spark):
    docs = edge_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none).rules == []
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert 0 <= quality.score_quality(docs, quality.train(docs, odd)).first().score <= 1


def test_url_layer_keeps_places():
    text = "x " + urllib.parse.quote("secret = 'abcdefgh12'", safe="") + " y"
    _, spans, _ = secrets.scan(text)
    assert [text[a:b] for _, a, b in spans] == [text[2:text.index("%27 y")]]


@pytest.mark.parametrize("line,labels", [("MIT, or see LICENSE file", "mit"), ("Apache-2.0 and other text continues here", "apache"), ("MIT OR Apache-2.0) and more", "apache,mit"),
                                         ("GPL-2.0-only WITH Classpath-exception-2.0 // see", "gpl"), ("LicenseRef-Own AND zlib", "licenseref-own,zlib"), ("see the file", ""), ("(MIT or the file", "")])
def test_prose_after_a_tag_is_not_read(line, labels):
    row = licenses._scanner()(f"x SPDX-License-Identifier: {line}\n")
    assert row[5] == labels and row[6] == (1.0 if labels else 0.0)


@pytest.mark.parametrize("form", ["right", "left", "pairs"])
def test_a_hundred_thousand_nested_licences(form):
    n = 100_000
    if form == "right":
        text = "".join(f"(l{i} or " for i in range(n)) + "z1" + ")" * n
    elif form == "left":
        text = "(" * n + "z1" + "".join(f" or l{i})" for i in range(n))
    else:
        text = " and ".join(f"(a{i} or b{i})" for i in range(n // 50))
    row = licenses._scanner()(f"SPDX-License-Identifier: {text}")
    assert row[6] == 1.0 and len(row[5].split(",")) == (n + 1 if form != "pairs" else n // 25)
    assert row[7] == (n + 1 if form != "pairs" else licenses.MOST_WAYS)


def test_long_lines_take_linear_time():
    """Twenty megabytes in one line: notices, tags and numbers."""
    import time

    text = "Apache License x SPDX-License-Identifier: MIT ; 555-123-4567 1.2.3.4 a@b.cd " * 270_000
    start = time.time()
    row = licenses._scanner()(text)
    assert row[1] == 270_000 and row[2:4] == (0, row[0] - 17)
    text = text[:2_000_000]
    base = pii.base_spans(text)
    inside = pii.Overlaps(base)
    breaks = pii.line_breaks(text)
    for s in pii.candidates(text):
        inside(s), pii.features(text, s, pii.line_width(breaks, len(text), s[1], s[2]))
    assert time.time() - start < 60


def test_overlaps_and_line_widths_equal_plain_loops():
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("ab1.\n"), 3000))
    spans = [("ip", a, a + int(rng.integers(1, 9))) for a in map(int, rng.integers(0, 2990, 80))]
    taken, breaks = pii.Overlaps(spans), pii.line_breaks(text)
    for a in range(0, 2980, 7):
        s = ("ip", a, a + 5)
        assert taken(s) == any(x < s[2] and s[1] < y for _, x, y in spans)
        end = text.find("\n", s[2])
        assert pii.line_width(breaks, len(text), s[1], s[2]) == (end if end >= 0 else len(text)) - text.rfind("\n", 0, s[1])


def hidden_in(text):
    return [k for k, *_ in secrets.scan(text)[1]]


def test_all_members_of_a_stream_and_long_layers_are_read(monkeypatch):
    secret = b"x = 1\npassword = 'abcdefgh1234'\n"
    two = gzip.compress(b"nothing here " * 50) + gzip.compress(secret)
    assert hidden_in(base64.b64encode(two).decode()) == ["assign"]
    late = gzip.compress(bytes(range(32, 127)) * 300_000 + "é".encode() * 10 + secret)
    assert hidden_in("see " + base64.b64encode(late).decode()) == ["assign"]
    monkeypatch.setattr(secrets, "LAYER_BYTES", 64)
    monkeypatch.setattr(secrets, "OVERLAP", 48)
    for shift in range(0, 130, 7):  # wherever the windows part it
        assert hidden_in(base64.b64encode(gzip.compress(("é" * 5 + "z" * shift).encode() + secret + b"tail " * 40)).decode()) == ["assign"]


def test_streams_in_streams_of_any_depth():
    data = b"token: abcdefgh12345678"
    for _ in range(200):
        data = gzip.compress(data, mtime=0)
    assert hidden_in(base64.b64encode(data).decode()) == ["assign"]


def test_compressed_bytes_under_escapes():
    import zlib

    secret = b"api_key = 'abcdefgh1234' " * 4
    for data in (gzip.compress(secret), zlib.compress(secret), zlib.compress(secret, 1)):
        for text in ("q=" + urllib.parse.quote(data), "q=" + "".join(f"%{b:02X}" for b in data), repr(data), "".join(f"\\x{b:02x}" for b in data)):
            assert "assign" in hidden_in(text), text[:60]
