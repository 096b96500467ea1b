"""Secret scan with a worklist over nested encodings.

Base kinds are found in the text as it is. Then every layer that hides behind
URL escapes, Unicode escapes, base64 or a compressed stream is unwrapped and
scanned again, until no layer is left; a layer already seen at the same place is
not unwrapped twice, which ends cycles. A match in a layer is reported at the
place in the original text that it was decoded from.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .common import per_text

KINDS = ("assign", "access", "hex")
# A decompressed layer is scanned in windows of about so many bytes; the next one repeats the end of the one before, so
# that of any match a piece longer than the least of its kind lies in one of them.
LAYER_BYTES, OVERLAP = 1 << 22, 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_LEAST_BASE64 = 16
# Compressed bytes under escapes: the first bytes of gzip or zlib, then escapes and what needs none.
_URL_STREAM = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~!*'()+-])*")
_BACKSLASH_STREAM = re.compile(r"""(?:\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\\x(?:01|9[cC]|[dD][aA]|5[eE])|\^))(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[\x20-\x5b\x5d-\x7e])*""")
_BACKSLASH = re.compile(r"""\\(?:x([0-9A-Fa-f]{2})|([abfnrtv0\\'"]))""")
_CONTROLS = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
_BREAK = re.compile(r"\r?\n[\x20\t]*")
# No secret and no base64 layer is shorter.
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")


def _mask(members: bytes) -> bytes:
    return bytes(120 if i in members else 32 for i in range(256))


_HEX_MASK = _mask(b"0123456789abcdef")
_BASE64_MASK = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _runs(one_byte: bytes, mask: bytes, least: int):
    """Start and end of the runs of at least ``least`` members."""
    marked, need, at = one_byte.translate(mask), b"x" * least, 0
    while (start := marked.find(need, at)) >= 0:
        end = marked.find(b" ", start)
        at = len(marked) if end < 0 else end
        yield start, at


def base_spans(text: str, one_byte: bytes | None = None) -> list[tuple[str, int, int]]:
    """The base kinds in ``text``, by start, then kind as listed."""
    one_byte = text.encode("latin-1", "replace") if one_byte is None else one_byte
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(a, 2, b) for a, b in _runs(one_byte, _HEX_MASK, 32)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


class _Places:
    """Where each character of a layer comes from, as pieces of equal step."""

    def __init__(self, pieces: list[tuple[int, int, int, bool]], length: int):
        # (start in layer, start in the original, end in the original, one to one)
        self.pieces, self.length = pieces, length
        self.starts = [p[0] for p in pieces]

    def span(self, a: int, b: int) -> tuple[int, int]:
        at, start, end, even = self.pieces[bisect_right(self.starts, a) - 1]
        left = start + (a - at) if even else start
        at, start, end, even = self.pieces[bisect_right(self.starts, b - 1) - 1]
        return left, (start + (b - at) if even else end)


def _rewritten(text: str, places: _Places, pattern: re.Pattern, decode) -> tuple[str, _Places] | None:
    """``text`` with the matches of ``pattern`` decoded; the rest keeps its place."""
    parts, pieces, done, size = [], [], 0, 0

    def literal(upto: int) -> None:
        nonlocal size
        i = done
        while i < upto:  # one piece for each even stretch of the layer below
            k = bisect_right(places.starts, i) - 1
            end = min(upto, places.starts[k + 1] if k + 1 < len(places.starts) else places.length)
            left, right = places.span(i, end)
            pieces.append((size, left, right, places.pieces[k][3]))
            size += end - i
            i = end
        parts.append(text[done:upto])

    for m in pattern.finditer(text):
        plain = decode(m.group())
        if plain is None:
            continue
        literal(m.start())
        left, right = places.span(m.start(), m.end())
        pieces.append((size, left, right, False))
        parts.append(plain)
        size += len(plain)
        done = m.end()
    if not done:
        return None
    literal(len(text))
    return "".join(parts), _Places(pieces, size)


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _unescape(run: str) -> str | None:
    units = b"".join(chr(int(next(filter(None, m.groups())), 16)).encode("utf-16-le", "surrogatepass")
                     if int(next(filter(None, m.groups())), 16) < 0x110000 else b"\xfd\xff" for m in _ESCAPED.finditer(run))
    return units.decode("utf-16-le", "replace")


def _readable(data: bytes) -> str | None:
    """The text in ``data``; of bytes that are no clean text, the printable stretches, a line each."""
    try:
        plain = data.decode("utf-8")
        if not any(c < " " and c not in "\t\n\r" or c == "\x7f" for c in plain):
            return plain or None
    except UnicodeDecodeError:
        pass
    return "\n".join(m.group().decode("ascii") for m in _PRINTABLE.finditer(data)) or None


def _wrapped(layer: str, runs: list[tuple[int, int]]):
    """The base64 blocks over several lines, as (start, end, characters): lines of one length, a last one no longer,
    and also with the line before them, which may begin after something else."""
    i = 0
    while i < len(runs):
        j, wide = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][1] - runs[j + 1][0] == wide and (m := _BREAK.match(layer, runs[j][1])) and m.end() == runs[j + 1][0]:
            j += 1
        lines, end = [layer[a:b] for a, b in runs[i:j + 1]], runs[j][1]
        if layer[end:end + 1] == "=":
            last = _BASE64.match(layer, runs[j][0])
            lines[-1], end = last.group(), last.end()
        elif (m := _BREAK.match(layer, end)) and (last := _BASE64.match(layer, m.end())) and len(last.group()) <= wide:
            lines.append(last.group())
            end = last.end()
        if len(lines) > 1:
            yield runs[i][0], end, "".join(lines)
        if i and (m := _BREAK.match(layer, runs[i - 1][1])) and m.end() == runs[i][0] and runs[i - 1][1] - runs[i - 1][0] < wide:
            yield runs[i - 1][0], end, layer[slice(*runs[i - 1])] + "".join(lines)
        i = j + 1


def _is_stream(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip or zlib streams hold, member after member, a bounded piece at a time; up to the first byte that is wrong."""
    opened, rest = zlib.decompressobj(47), b""
    for chunk in chunks:
        chunk, rest = rest + chunk, b""
        while True:
            if opened.eof:
                if len(chunk) < 3:
                    rest = chunk
                    break
                if not _is_stream(chunk):
                    return
                opened = zlib.decompressobj(47)
            try:
                plain = opened.decompress(chunk, LAYER_BYTES)
            except zlib.error:
                return
            if plain:
                yield plain
            chunk = opened.unused_data if opened.eof else opened.unconsumed_tail
            if not chunk and len(plain) < LAYER_BYTES:
                break


def _windows(data: bytes) -> Iterator[bytes]:
    """``data``, or what is in the streams in it, however deep, in windows that overlap. A stream that holds itself ends the descent."""
    first, rest, seen = data, iter(()), set()
    while _is_stream(first) and (mark := hashlib.sha256(first).digest()) not in seen:
        seen.add(mark)
        inner = _inflated(chain((first,), rest))
        got = next(inner, None)
        if got is None:
            break
        first, rest = got, inner
    tail = b""
    for chunk in chain((first,), rest):
        # A character cut by the window's edge is whole in the other window.
        window = tail + chunk
        start = next((i for i in range(min(4, len(window))) if window[i] & 0xC0 != 0x80), 0) if tail else 0
        lead = next((i for i in range(1, min(4, len(window)) + 1) if window[-i] & 0xC0 != 0x80), 0)
        cut = lead if len(chunk) >= LAYER_BYTES and lead and window[-lead] >= 0xC0 and lead < 2 + (window[-lead] >= 0xE0) + (window[-lead] >= 0xF0) else 0
        yield window[start:len(window) - cut]
        tail = window[-OVERLAP:]


def _layers(data: bytes) -> Iterator[str]:
    for window in _windows(data):
        if plain := _readable(window):
            yield plain


def _unwrapped(blob: str) -> Iterator[str]:
    body = blob.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    yield from _layers(data)


def _backslashed(run: str) -> bytes:
    return _BACKSLASH.sub(lambda m: chr(int(m.group(1), 16)) if m.group(1) else _CONTROLS.get(m.group(2), m.group(2)), run).encode("latin-1", "replace")


def _streams(layer: str) -> Iterator[tuple[int, int, str]]:
    """Layers of compressed bytes that stand under URL or backslash escapes, and where they stand."""
    for mark, pattern, read in (("%", _URL_STREAM, unquote_to_bytes), ("\\x", _BACKSLASH_STREAM, _backslashed)):
        if mark in layer:
            for m in pattern.finditer(layer):
                data = read(m.group())
                if _is_stream(data):
                    for plain in _layers(data):
                        yield m.start(), m.end(), plain


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, all spans, and the number of layers (windows of long ones).

    Spans are (kind, start, end) in code points of ``text``, end exclusive.
    """
    one_byte = text.encode("latin-1", "replace")
    base = base_spans(text, one_byte)
    if not ("%" in text or "\\" in text or next(_runs(one_byte, _BASE64_MASK, _LEAST_BASE64), None)):
        return base, base, 0
    spans, seen, layers = set(base), set(), 0
    work = deque([(text, one_byte, _Places([(0, 0, len(text), True)], len(text)))])
    while work:
        layer, raw, places = work.popleft()
        under = []
        if "%" in layer and (made := _rewritten(layer, places, _PERCENT, _percent)):
            under.append(made)
        if "\\" in layer and (made := _rewritten(layer, places, _ESCAPE, _unescape)):
            under.append(made)
        runs = list(_runs(raw, _BASE64_MASK, _LEAST_BASE64))
        blobs = [(a, (blob := _BASE64.match(layer, a)).end(), blob.group()) for a, _ in runs]
        for a, b, blob in [*blobs, *_wrapped(layer, runs)]:
            under.extend(_from(places, a, b, _unwrapped(blob)))
        for a, b, plain in _streams(layer):
            under.extend(_from(places, a, b, (plain,)))
        for plain, where in under:
            key = (where.span(0, len(plain)) if plain else (0, 0), hashlib.sha256(plain.encode("utf-8", "surrogatepass")).digest())
            if not plain or key in seen:
                continue
            seen.add(key)
            layers += 1
            bytes_of = plain.encode("latin-1", "replace")
            spans.update((k, *where.span(a, b)) for k, a, b in base_spans(plain, bytes_of))
            work.append((plain, bytes_of, where))
    return base, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])), layers


def _from(places: _Places, a: int, b: int, plains: Iterable[str]) -> Iterator[tuple[str, _Places]]:
    """Layers all of whose characters come from the stretch [a, b) of the layer above."""
    left, right = places.span(a, b)
    return ((plain, _Places([(0, left, right, False)], len(plain))) for plain in plains)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _row(text: str) -> tuple:
    base, spans, layers = scan(text)
    said = joined(base)
    n = [sum(s[0] == k for s in base) for k in KINDS]
    return (*n, hashlib.sha256(said.encode()).hexdigest(), said if spans is base else joined(spans), layers)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, layers unwrapped.

    Null and empty texts have no spans; repeated rows give repeated rows; an
    empty table gives none; a null key is kept. Texts and layers
    are read whole, long layers in windows, all members of a gzip stream.
    """
    long = [StructField(f"n_{k}", LongType()) for k in KINDS]
    rest = [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_layers", LongType())]
    return per_text(docs, [key], text, lambda: _row, long + rest)
