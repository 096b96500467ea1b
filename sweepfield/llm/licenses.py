"""License scan: Aho-Corasick for tags and notice phrases, shunting-yard for expressions."""

from __future__ import annotations

import re
from collections.abc import Generator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from .common import per_text

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases.
NOTICES = {"gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
           "bsd license": "bsd", "eclipse public license": "epl", "creative commons attribution": "cc-by",
           "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
           "all rights reserved": "proprietary"}
# Families of SPDX identifiers by the start of their lower-case form.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("mit", "mit"),
            ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("isc", "isc"), ("unlicense", "unlicense"))
# SPDX identifiers without a digit that no family starts.
PLAIN = frozenset("artistic-dist beerware blessing bsl curl fair fsfap fsful glide imagemagick info-zip intel libpng libtiff ms-pl ms-rl naumen ncsa noassertion none nlpl "
                  "openssl php plexus postgresql psutils python ruby sendmail sleepycat tcl vim w3c wtfpl xerox xinetd xnet zed zend zlib".split())
REFERENCES = ("licenseref-", "documentref-")
TAG = "spdx-license-identifier:"
EXCEPTION = "exception"
# ``n_ways`` is a 64-bit number: more ways than that are given as the largest one.
MOST_WAYS = (1 << 63) - 1

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(rb"\(|\)|[a-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def is_identifier(token: str) -> bool:
    """Whether a word after a tag names a license (or exception) rather than going on in prose: a known name, or a form with a version or a reference."""
    return token.startswith(REFERENCES) or any(token.startswith(s) for s, _ in FAMILIES) or token.rstrip("+.") in PLAIN or any(c.isdigit() for c in token) or EXCEPTION in token


def family(identifier: str) -> str:
    """The label of an SPDX identifier; unknown ones stand for themselves."""
    return next((label for start, label in FAMILIES if identifier.startswith(start)), identifier.rstrip("+"))


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: ``with`` binds closer than ``and``, ``and`` closer than ``or``; None if malformed."""
    out, stack, want = [], [], True
    for t in tokens:
        if t == "(":
            if not want:
                return None
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if want or not stack:
                return None
            stack.pop()
        elif t in _RANK:
            if want:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            want = True
        else:
            if not want:
                return None
            out.append(t)
            want = False
    if want:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def choices(expression: list[str]) -> list[frozenset[str]] | None:
    """The ways to satisfy an expression, each the set of labels that then hold together; None if malformed.

    ``or`` joins the ways, ``and`` combines each with each, ``with`` keeps the
    license and drops the exception. Equal ways are merged, which bounds them
    by the sets of labels.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[set[frozenset[str]]] = []
    for t in order:
        if t not in _RANK:
            stack.append({frozenset([family(t)])})
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(a | b if t == "or" else {x | y for x in a for y in b} if t == "and" else a)
    return sorted(stack[0], key=sorted)


def labels_and_ways(expression: list[str]) -> tuple[set[str], int]:
    """The labels of a well-formed expression, and how many ``choices`` it has, without listing them.

    The ways are held as a zero-suppressed decision diagram, so ``(a or b) and (c or d) and ...`` takes
    space in proportion to its length though its ways double with each pair.
    """
    order = postfix(expression)
    names = [family(t) for t in order if t not in _RANK]
    # Labels that are joined later lie on top, so a chain is extended in one step however it is nested.
    rank, pending = {}, []
    for at, t in enumerate(order):
        if t not in _RANK:
            pending.append([family(t)])
        else:
            b, a = pending.pop(), pending.pop()
            for name in (*a, *b):
                rank.setdefault(name, -at)
            pending.append([])
    for name in names:
        rank.setdefault(name, 0)
    rank = {name: i for i, name in enumerate(sorted(rank, key=lambda n: (rank[n], n)))}
    table: dict[tuple[int, int, int], int] = {}
    nodes: list[tuple[int, int, int]] = [(1, 0, 0), (1, 0, 0)]  # no way at all, and the one of no labels

    def node(var: int, low: int, high: int) -> int:
        if not high:
            return low
        if (var, low, high) not in table:
            table[var, low, high] = len(nodes)
            nodes.append((var, low, high))
        return table[var, low, high]

    def split(a: int, var: int) -> tuple[int, int]:
        return nodes[a][1:] if a > 1 and nodes[a][0] == var else (a, 0)

    def top(a: int, b: int) -> int:
        return min(nodes[x][0] for x in (a, b) if x > 1)

    known: dict[tuple[str, int, int], int] = {}

    # Both are generators that ``_run`` drives with a stack of its own, so no nesting is too deep.
    def union(a: int, b: int) -> Generator:
        if a == b or not b:
            return a
        if not a:
            return b
        if ("or", a, b) not in known:
            var = top(a, b)
            (a0, a1), (b0, b1) = split(a, var), split(b, var)
            low = yield union(a0, b0)
            high = yield union(a1, b1)
            known["or", a, b] = node(var, low, high)
        return known["or", a, b]

    def join(a: int, b: int) -> Generator:
        if not a or not b:
            return 0
        if a == 1 or b == 1:
            return max(a, b)
        if ("and", a, b) not in known:
            var = top(a, b)
            (a0, a1), (b0, b1) = split(a, var), split(b, var)
            low = yield join(a0, b0)
            any_b = yield union(b0, b1)
            both = yield join(a1, any_b)
            rest = yield join(a0, b1)
            high = yield union(both, rest)
            known["and", a, b] = node(var, low, high)
        return known["and", a, b]

    stack: list[tuple[int, set[str]]] = []
    for t in order:
        if t not in _RANK:
            stack.append((node(rank[family(t)], 0, 1), {family(t)}))
            continue
        (b, more), (a, labels) = stack.pop(), stack.pop()
        if t != "with":
            a = _run(union(a, b) if t == "or" else join(a, b))
            # The smaller set goes into the larger one.
            labels, more = (labels, more) if len(labels) >= len(more) else (more, labels)
            labels |= more
        stack.append((a, labels))
    count = [0, 1]
    for _, low, high in nodes[2:]:  # a node comes after those below it
        count.append(count[low] + count[high])
    return stack[0][1], count[stack[0][0]]


def _run(work: Generator) -> int:
    """The result of a generator that yields the generators whose results it needs."""
    stack, value = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def tagged(line: bytes, start: int = 0, stop: int | None = None) -> list[str]:
    """The longest well-formed expression at the start of what follows a tag.

    It ends before the first byte that is neither blank nor part of a token, and before a word that is no identifier.
    """
    tokens, last, depth, want, at = [], 0, 0, True, start
    for m in _TOKEN.finditer(line, start, len(line) if stop is None else stop):
        t = m.group().decode()
        if line[at:m.start()].strip(b" \t\r") or t not in _RANK and t not in "()" and not is_identifier(t):
            break
        at = m.end()
        if t == ")" and (want or not depth) or t in _RANK and want or t != ")" and t not in _RANK and not want:
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        want = t == "(" or t in _RANK
        if not want and not depth:
            last = len(tokens)
    return tokens[:last]


def _automata():
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (PHRASES | NOTICES).items():
        words.add_word(f" {phrase} ", (phrase, label))
    tags.add_word(TAG, len(TAG))
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def _scanner():
    words, tags = _automata()
    hint = [p.split()[-1].encode() for p in PHRASES | NOTICES]

    def scan(text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        tokens = raw.translate(_LETTERS).split()
        line = b" ".join(tokens)
        places, base, more = [], set(), set()
        if any(h in line for h in hint):
            flat = " " + line.decode("latin-1") + " "
            blanks = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
            for end, (phrase, label) in words.iter(flat):
                if phrase in PHRASES:
                    start = end - len(phrase) - 1
                    places.append(int(np.searchsorted(blanks, start)))
                    base.add(label)
                else:
                    more.add(label)
        ways = 0
        low = raw.translate(_LOWER)
        if TAG.encode() in low:
            stop = -1
            for end, _ in tags.iter(low.decode("latin-1")):
                if stop <= end:
                    stop = low.find(b"\n", end)
                    stop = len(low) if stop < 0 else stop
                if found := tagged(low, end + 1, stop):
                    names, n = labels_and_ways(found)
                    ways = min(ways + n, MOST_WAYS)
                    more |= names
        labels = sorted(base | more)
        score = 1.0 if ways else 0.9 if base else 0.6 if more else 0.0
        return len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, ways

    return scan


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels, and a score from 0 to 1.

    ``score``: 1.0 with a well-formed tag expression, 0.9 with a base phrase,
    0.6 with another notice only, else 0. Null and empty texts have no words
    and no labels; a malformed expression, or one that
    prose goes on from, is cut to its longest well-formed start; repeated rows give repeated rows; an empty table gives none.
    """
    fields = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
              StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("n_ways", LongType())]
    return per_text(docs, [key], text, _scanner, fields)
