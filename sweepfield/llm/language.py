"""Language of a text from a bidirectional gated recurrent network over its bytes.

The network is trained with numpy by backpropagation through time on segments of
a bounded sample of labelled texts. Applied, it reads every byte of every text
in segments, from both ends of each segment, labels every position, and pools
the letters' probabilities for the document. Gates use the softsign
x / (1 + |x|), which needs no exponentials.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free_name, hash_share, held_out, small

SEGMENT = 64
HIDDEN = 4
LANES = 4096
BLOCK_BYTES = 1 << 19
UND = "und"

_LETTER = re.compile(r"[^\W\d_]")
# Positions that vote: ASCII letters and the bytes of longer characters.
_VOTES = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], dtype=np.float32)


@dataclass
class Model:
    """``table`` holds the input weights and biases by byte, one row per gate unit, for each direction."""

    langs: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _softsign(x: np.ndarray) -> np.ndarray:
    x /= np.abs(x) + np.float32(1)
    return x


def _hidden(table: np.ndarray, inner: np.ndarray, steps: np.ndarray, backward: bool) -> np.ndarray:
    """Hidden states, (positions, units, lanes), of one direction."""
    n, lanes = steps.shape
    size = inner.shape[1]
    states = np.empty((n, size, lanes), np.float32)
    h = np.zeros((size, lanes), np.float32)
    half = np.float32(0.5)
    g, u = np.empty((3 * size, lanes), np.float32), np.empty((3 * size, lanes), np.float32)
    for t in range(n - 1, -1, -1) if backward else range(n):
        np.take(table, steps[t], axis=1, out=g, mode="clip")
        np.matmul(inner, h, out=u)
        gates, fresh = g[:2 * size], u[2 * size:]
        gates += u[:2 * size]
        _softsign(gates)
        gates *= half
        gates += half
        fresh *= gates[size:]
        fresh += g[2 * size:]
        _softsign(fresh)
        now = states[t]
        np.subtract(h, fresh, out=now)
        now *= gates[:size]
        now += fresh
        h = now
    return states


def position_probabilities(model: Model, steps: np.ndarray) -> np.ndarray:
    """(positions, languages, lanes) from bytes given as (positions, lanes)."""
    both = np.concatenate([_hidden(model.table[d], model.inner[d], steps, d == 1) for d in (0, 1)], axis=1)
    p = np.matmul(model.out, both)
    p += model.bias[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def _segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut to segments, (positions, lanes), padded with zero bytes; and each text's number of segments."""
    counts = np.array([-(-len(t) // SEGMENT) for t in texts])
    padded = b"".join(t + b"\0" * (-len(t) % SEGMENT) for t in texts)
    return np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT).T.astype(np.int64), counts


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean probability over the voting positions; zeros where there are none."""
    steps, counts = _segments(texts)
    votes = np.zeros((steps.shape[1], len(model.langs) + 1))
    for a in range(0, steps.shape[1], LANES):
        part = np.ascontiguousarray(steps[:, a:a + LANES])
        weight = _VOTES[part]
        p = position_probabilities(model, part)
        p *= weight[:, None, :]
        votes[a:a + LANES, :-1] = p.sum(axis=0).T
        votes[a:a + LANES, -1] = weight.sum(axis=0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([np.zeros((1, votes.shape[1])), np.cumsum(votes, axis=0)])
    sums = total[ends[1:]] - total[ends[:-1]]
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def fit(texts: list[bytes], labels: list[str], steps: int = 350, lanes: int = 256, rate: float = 0.02, seed: int = 7) -> Model:
    """Train on segments of ``texts`` with Adam, each language drawn equally often."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    size, c = HIDDEN, len(langs)
    pools = []
    for lang in langs:
        cut, _ = _segments([t for t, x in zip(texts, labels) if x == lang and t])
        pools.append(cut[:, _VOTES[cut].sum(axis=0) > 0])
    pools = [p if p.shape[1] else np.zeros((SEGMENT, 1), np.int64) for p in pools]
    draw = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    w = {"t0": draw(3 * size, 256), "t1": draw(3 * size, 256), "u0": draw(3 * size, size), "u1": draw(3 * size, size), "o": draw(c, 2 * size), "b": np.zeros(c, np.float32)}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        truth = rng.integers(0, c, lanes)
        x = np.stack([pools[k][:, rng.integers(0, pools[k].shape[1])] for k in truth], axis=1)
        grads = _gradients(w, x, truth)
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            w[k] -= (pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(langs, [w["t0"], w["t1"]], [w["u0"], w["u1"]], w["o"], w["b"])


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over voting positions, by backpropagation through time."""
    n, lanes = x.shape
    size = w["u0"].shape[1]
    states = [_hidden(w[f"t{d}"], w[f"u{d}"], x, d == 1) for d in (0, 1)]
    both = np.concatenate(states, axis=1)
    p = np.matmul(w["o"], both) + w["b"][:, None]
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    weight = _VOTES[x]
    p[:, truth, np.arange(lanes)] -= 1
    p *= (weight / max(weight.sum(), 1))[:, None, :]
    grads = {"o": np.einsum("tcl,thl->ch", p, both), "b": p.sum(axis=(0, 2))}
    back = np.matmul(w["o"].T, p)
    for d in (0, 1):
        table, inner, h_all = w[f"t{d}"], w[f"u{d}"], states[d]
        dt, du = np.zeros_like(table), np.zeros_like(inner)
        dh = np.zeros((size, lanes), np.float32)
        order = range(n - 1, -1, -1) if d == 0 else range(n)
        for t in order:
            before = t - 1 if d == 0 else t + 1
            h = h_all[before] if 0 <= before < n else np.zeros((size, lanes), np.float32)
            g, u = table[:, x[t]], inner @ h
            gates = _softsign(g[:2 * size] + u[:2 * size])
            z, r = 0.5 + 0.5 * gates[:size], 0.5 + 0.5 * gates[size:]
            held = u[2 * size:]
            fresh = _softsign(g[2 * size:] + r * held)
            dh = dh + back[t, d * size:(d + 1) * size]
            d_fresh = dh * (1 - z) * (1 - np.abs(fresh)) ** 2
            d_gates = np.concatenate([dh * (h - fresh), d_fresh * held]) * 0.5 * (1 - np.abs(gates)) ** 2
            d_inner = np.concatenate([d_gates, d_fresh * r])
            one_hot = np.zeros((lanes, 256), np.float32)
            one_hot[np.arange(lanes), x[t]] = 1
            dt += np.concatenate([d_gates, d_fresh]) @ one_hot
            du += d_inner @ h.T
            dh = dh * z + inner.T @ d_inner
        grads[f"t{d}"], grads[f"u{d}"] = dt, du
    return grads


def training_sample(docs: DataFrame, key: str, text: str, lang: str, per_lang: int, sample_bytes: int) -> list:
    """About ``per_lang`` and never over twice as many rows of each language, chosen by a hash of the key.

    Of each, at most ``sample_bytes`` bytes around a hashed place. Only
    documents that are not held out, with a text and a language, take part.
    """
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("y")).where(~held_out("k") & F.col("y").isNotNull() & F.col("t").isNotNull())
    counts = known.groupBy("y").agg(F.count("*").alias("n"))
    size = F.greatest(F.length("t") - sample_bytes // 2, F.lit(1))
    drawn = (known.join(F.broadcast(counts), "y").where(hash_share("k", seed=11) < F.lit(float(per_lang)) / F.col("n"))
             .select("y", F.col("t").substr((hash_share("k", seed=12) * size).cast("int") + 1, F.lit(sample_bytes // 2)).alias("t"), F.xxhash64("k").alias("h")))
    n_langs = counts.count()
    return drawn.orderBy("h", "t").limit(2 * per_lang * max(n_langs, 1)).collect()


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 250, sample_bytes: int = 4096) -> Model | None:
    """A model from at most ``2 * per_lang`` texts a language; None if no text has a language."""
    rows = training_sample(docs, key, text, lang, per_lang, sample_bytes)
    rows = [r for r in rows if _LETTER.search(r.t)]
    return fit([r.t.encode("utf-8", "surrogatepass") for r in rows], [r.y for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` (or other ``names``), the pooled probability of that language.

    ``und`` with score 0 for null texts, texts without a letter, and if there is
    no model. Every byte of every text is read; repeated rows give repeated
    rows; an empty table gives none; extra columns are not read.
    """
    schema = StructType([docs.schema[k] for k in keep] + [StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    n = len(keep)

    def labelled(texts: list[str]) -> tuple[list[str], list[float]]:
        said, scores = [UND] * len(texts), [0.0] * len(texts)
        block, at, size = [], [], 0

        def flush() -> None:
            p = pooled(model, block)
            for i, k, s in zip(at, p.argmax(axis=1), p.max(axis=1)):
                said[i], scores[i] = model.langs[k], float(min(max(s, 0.0), 1.0))

        for i, t in enumerate(texts):
            if model is None or not _LETTER.search(t):
                continue
            block.append(t.encode("utf-8", "surrogatepass"))
            at.append(i)
            size += len(block[-1])
            if size >= BLOCK_BYTES:
                flush()
                block, at, size = [], [], 0
        if block:
            flush()
        return said, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            said, scores = labelled(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + [pa.array(said, to_arrow_type(StringType())), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free_name(keep))).mapInArrow(run, schema)
