"""Personal data: wide candidate generators, boosted trees over format and context, calibrated thresholds.

The base kinds are exact rules and always stay. Generators propose many more,
overlapping spans. Boosted trees score those that overlap no base span by their
form and surroundings. They are trained on a bounded sample of the corpus: its
base spans rewritten into forms that the base rules miss, each in its own
context, against the sample's own candidates outside base spans. A threshold
calibrated on other documents of the sample selects what is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField

from .boost import Tree, grow, leaves, sigmoid
from .common import hash_share, per_text, with_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = bytes(120 if 48 <= b <= 57 else 32 for b in range(256))
_NOT_DIGIT = re.compile(r"[^0-9]")
_BREAK = re.compile("\n")

# High recall: anything that looks a little like one of the kinds.
_WIDE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,5}")),
    ("ip", re.compile(r"[0-9]{1,4}(?:(?:\.|\x20?[(\[]\x20?(?:\.|dot|DOT)\x20?[)\]]\x20?)[0-9]{1,4}){2,5}")),
    ("card", re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9]){9,24}")),
    ("phone", re.compile(r"(?:\+|\(|00)?[0-9](?:[\x20().0-9/-]{5,24})[0-9]")),
)
FEATURES = ("kind", "length", "digits", "digit_share", "separators", "letters", "upper", "at_sign", "plus", "luhn", "dots", "groups", "longest_group",
            "largest_part", "left_space", "right_space", "left_alnum", "right_alnum", "cue", "line_share")
_CUES = ("mail", "phone", "tel", "call", "card", "visa", "ip", "addr", "contact", "fax")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base kinds, by start, then kind as listed."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if b"x" in text.encode("latin-1", "replace").translate(_DIGITS):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def candidates(text: str) -> list[Span]:
    """Wide spans of every kind; they may overlap."""
    digits = b"x" in text.encode("latin-1", "replace").translate(_DIGITS)
    low = text.lower()
    mail = any(cue in low for cue in ("@", " dot ", "at)", "at]", "at )", "at ]", "dot)", "dot]", "dot )", "dot ]"))
    return sorted({(kind, m.start(), m.end()) for kind, pattern in _WIDE if (mail if kind == "email" else digits) for m in pattern.finditer(text)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def line_breaks(text: str) -> list[int]:
    return [m.start() for m in _BREAK.finditer(text)]


def line_width(breaks: list[int], length: int, a: int, b: int) -> int:
    """Length of the line (or lines) of a span, from the sorted places of all line breaks."""
    i, j = bisect_left(breaks, a), bisect_left(breaks, b)
    return (breaks[j] if j < len(breaks) else length) - (breaks[i - 1] if i else -1)


class Overlaps:
    """Whether a span overlaps any of those given, in one lookup."""

    def __init__(self, spans: list[Span]):
        order = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends = [a for a, _ in order], list(accumulate((b for _, b in order), max))

    def __call__(self, span: Span) -> bool:
        i = bisect_left(self.starts, span[2])
        return i > 0 and self.ends[i - 1] > span[1]


def features(text: str, span: Span, width: int | None = None) -> tuple[float, ...]:
    """The numbers in ``FEATURES`` for one span: its form, and what stands around it; ``width`` is that of its line."""
    kind, a, b = span
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    groups = [g for g in _NOT_DIGIT.split(s) if g]
    left, right = text[a - 1:a], text[b:b + 1]
    before = text[max(0, a - 24):a].lower()
    width = line_width(line_breaks(text), len(text), a, b) if width is None else width
    return (float(KINDS.index(kind)), float(b - a), float(len(digits)), len(digits) / (b - a), float(sum(not c.isalnum() for c in s)), float(sum(c.isalpha() for c in s)),
            float(sum(c.isupper() for c in s)), float("@" in s), float(s[:1] == "+"), float(len(digits) > 1 and luhn(digits)), float(s.count(".")), float(len(groups)),
            float(max(map(len, groups), default=0)), float(min(max((int(g[-6:]) if len(g) <= 6 else 999_999 for g in groups), default=0), 999_999)), float(left.isspace() or not left),
            float(right.isspace() or not right or right in ".,;:"), float(left.isalnum()), float(right.isalnum()), float(any(c in before for c in _CUES)), (b - a) / max(width, 1))


@dataclass
class Scorer:
    """Boosted trees, Platt scaling and one threshold per kind; without trees nothing is added."""

    trees: list[Tree]
    bias: float
    slope: float
    offset: float
    least: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for tree in self.trees:
            margin += 0.2 * leaves(tree, x)
        return sigmoid(self.slope * margin + self.offset)

    def added(self, text: str) -> list[tuple[Span, float]]:
        spans = candidates(text) if self.trees else []
        if not spans:
            return []
        breaks = line_breaks(text)
        p = self.score(np.array([features(text, s, line_width(breaks, len(text), s[1], s[2])) for s in spans]))
        return [(s, float(v)) for s, v in zip(spans, p) if v >= self.least[KINDS.index(s[0])]]


NOTHING = Scorer([], 0.0, 1.0, 0.0, (2.0,) * len(KINDS))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, precision: float = 0.99, hold: np.ndarray | None = None) -> Scorer:
    """Trees on the rows that are not held out; scale and thresholds on the others, by default every fourth.

    For the precision, a kind's positives weigh at most as much as its negatives together.
    """
    if len(y) < 40 or y.min() == y.max():
        return NOTHING
    hold = np.arange(len(y)) % 4 == 3 if hold is None else hold
    if hold.all() or not hold.any() or y[~hold].min() == y[~hold].max():
        return NOTHING
    tx, ty, hx, hy = x[~hold], y[~hold], x[hold], y[hold]
    rate = min(max(ty.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    margin, grown = np.full(len(ty), bias), []
    for _ in range(trees):
        p = sigmoid(margin)
        grown.append(grow(tx, ty - p, p * (1 - p), depth))
        margin += 0.2 * leaves(grown[-1], tx)
    raw = np.full(len(hy), bias)
    for tree in grown:
        raw += 0.2 * leaves(tree, hx)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps for Platt scaling, with a little ridge
        p = sigmoid(slope * raw + offset)
        g = np.array([((p - hy) * raw).sum() + 0.1 * (slope - 1), (p - hy).sum() + 0.1 * offset])
        h = np.array([[(p * (1 - p) * raw * raw).sum() + 0.1, (p * (1 - p) * raw).sum()], [(p * (1 - p) * raw).sum(), (p * (1 - p)).sum() + 0.1]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - float(step[0]), offset - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    p = sigmoid(slope * raw + offset)
    least = []
    for k in range(len(KINDS)):
        own = hx[:, 0] == k
        q, t = p[own], hy[own]
        order = np.argsort(-q, kind="stable")
        weight = min(1.0, max((t == 0).sum(), 1) / max(t.sum(), 1))
        true, false = np.cumsum(weight * t[order]), np.cumsum(1 - t[order])
        right = true / np.maximum(true + false, 1e-9)
        below = np.append(q[order][1:], 0.0)
        ok = np.flatnonzero((right >= precision) & (below < q[order]))
        # Halfway to the next score below, so that the least of the held-out positives is not the bound itself.
        least.append(max(0.5, float(q[order][ok[-1]] + below[ok[-1]]) / 2) if len(ok) and t.sum() >= 5 else 2.0)
    return Scorer(grown, bias, slope, offset, tuple(least))


def _taught(text: str) -> tuple[list[list[float]]]:
    """Each candidate's features and whether a base span of its kind covers most of it."""
    base, spans = base_spans(text), candidates(text)
    rows = []
    for s in spans:
        hit = any(k == s[0] and min(b, s[2]) - max(a, s[1]) >= 0.8 * max(b - a, s[2] - s[1]) for k, a, b in base)
        rows.append([*features(text, s), float(hit)])
    return (rows,)


def rewritten(kind: str, span: str) -> list[str]:
    """Forms of a base span that the base rules miss: obfuscated, local, with other separators."""
    if kind == "email":
        local, _, domain = span.partition("@")
        return [local + at + domain.replace(".", dot) for at, dot in ((" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), ("[AT]", "[DOT]"))]
    if kind == "ip":
        return [span.replace(".", dot) for dot in ("[.]", " (dot) ", "[dot]", "(.)")]
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [c.join(fours) for c in (".", "/", "_", " - ")]
    first, *rest = [g for g in _NOT_DIGIT.split(span) if g]
    if len(rest) < 2:  # no country prefix set apart: the last ten digits, as groups
        rest = [digits[-10:-7], digits[-7:-4], digits[-4:]]
        first = digits[:-10] or "1"
    return [f"({rest[0]}) " + "-".join(rest[1:]), "-".join(rest), ".".join(rest), " ".join(rest), f"00{first} " + " ".join(rest), "/".join([rest[0], "".join(rest[1:])])]


def _outside(text: str) -> tuple[list[list[float]]]:
    """Features and labels of candidates that overlap no base span: 1 for those that cover a rewritten base span of
    their kind, 0 for others at a rewritten one and for the text's own."""
    base, rows, breaks = base_spans(text), [], line_breaks(text)
    taken = Overlaps(base)
    for s in candidates(text):
        if not taken(s):
            rows.append([*features(text, s, line_width(breaks, len(text), s[1], s[2])), 0.0])
    for kind, a, b in base:
        low, high = max(0, a - 400), min(len(text), b + 400)  # candidates are shorter than that
        # Where the line goes on beyond this stretch.
        i, j = bisect_left(breaks, low), bisect_left(breaks, high)
        before, after = low - (breaks[i - 1] if i else -1) - 1, (breaks[j] if j < len(breaks) else len(text)) - high
        for form in rewritten(kind, text[a:b]):
            near, start = text[low:a] + form + text[b:high], a - low
            end, own, there = start + len(form), Overlaps(base_spans(near)), line_breaks(near)
            for s in candidates(near):
                _, p, q = s
                if p < end and start < q and not own(s):
                    hit = s[0] == kind and min(q, end) - max(p, start) >= 0.8 * max(q - p, end - start)
                    width = line_width(there, len(near), p, q) + (before if bisect_left(there, p) == 0 else 0) + (after if bisect_left(there, q) == len(there) else 0)
                    rows.append([*features(near, s, width), float(hit)])
    return (rows,)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 20_000, documents: int = 8_000) -> Scorer:
    """A scorer from candidates of about ``documents`` documents (by a hash of the key), at most ``rows`` candidates; a quarter of the documents is held out."""
    n = docs.count()
    drawn = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(hash_share("k", seed=31) < float(documents) / max(n, 1))
    made = per_text(drawn, ["k"], "t", lambda: _outside, [StructField("rows", ArrayType(ArrayType(DoubleType())))])
    held = (hash_share("k", seed=37) < 0.25).alias("held")
    got = made.select("k", held, F.posexplode("rows").alias("i", "row")).orderBy(F.xxhash64("k", "i"), "row").limit(rows).collect()
    table = np.array([r.row for r in got], float).reshape(len(got), len(FEATURES) + 1)
    return fit(table[:, :-1], table[:, -1], hold=np.array([r.held for r in got], bool))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str, scorer: Scorer) -> tuple[list[Span], list[Span], float]:
    """Base spans, base and added spans, and the highest score of an added span."""
    base = base_spans(text)
    taken = Overlaps(base)
    more = [(s, v) for s, v in scorer.added(text) if not taken(s)]
    if not more:
        return base, base, 0.0
    return base, sorted({*base, *(s for s, _ in more)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])), max(v for _, v in more)


def find_pii(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, the best added score.

    Null and empty texts have no spans; repeated rows give repeated rows; an
    empty table gives none; a null key is kept; other columns are not read.
    """
    def make():
        def row(t: str) -> tuple:
            base, spans, best = all_spans(t, scorer)
            said = _joined(base)
            return (*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(said.encode()).hexdigest(), said if spans is base else _joined(spans), best)

        return row

    fields = [StructField(f"n_{k}", LongType()) for k in KINDS] + [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("best_added", DoubleType())]
    return per_text(docs, [key], text, make, fields)


def redacted(text: str, scorer: Scorer) -> str:
    """``text`` with every span replaced by its kind; overlapping spans are replaced together, by the first one's kind."""
    _, spans, _ = all_spans(text, scorer)
    parts, done, kind = [], 0, None
    start = end = 0
    for k, a, b in [*spans, ("", len(text) + 1, len(text) + 1)]:
        if kind is not None and a >= end:
            parts += [text[done:start], f"<{kind.upper()}>"]
            done, kind = end, None
        if kind is None:
            kind, start, end = k, a, b
        else:
            end = max(end, b)
    parts.append(text[done:])
    return "".join(parts)


def redact(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced by its kind; a null text stays null."""
    return with_text(docs, text, lambda: lambda t: redacted(t, scorer))
