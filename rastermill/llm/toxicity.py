"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), over the distinct hashed terms of a whole text. The pairs'
sum lets an insult together with a mention of a group weigh more than the two alone. Terms are words, lower-cased, and
their first five letters. Buckets whose association with the label is within noise take no part, which keeps
long texts from gathering weight by length alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches

BITS = 18
FACTORS = 8
#: About so many labelled rows are fitted at most: those of the smallest hashes of their ids.
FIT_ROWS = 16_000
#: A bucket takes part if at least so many fitted texts hold it and its z-score for the label is at least so large.
MIN_COUNT, MIN_Z, MAX_TERMS = 4, 4.0, 16_384
_WORD = re.compile(r"[^\W_]+")


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct hashed terms of a text, ascending."""
    words = set(_WORD.findall((text or "").lower()))
    words |= {"^" + w[:5] for w in words if len(w) > 5}
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in words), np.int32, len(words)))


class FactorizationMachine:
    """Compact parameters: active maps a bucket to a row of w and v, or to -1."""

    def __init__(self, active: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.active, self.w0, self.w, self.v = active, w0, w, v

    def score(self, terms: np.ndarray) -> float:
        ids = self.active[terms]
        ids = ids[ids >= 0]
        v = self.v[ids]
        s = v.sum(0)
        z = self.w0 + self.w[ids].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> FactorizationMachine:
    """Fit by Adam on the logistic loss; deterministic for given rows."""
    labels = np.asarray(labels, np.float64)
    n, n1 = len(rows), labels.sum()
    flat = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    count = np.bincount(flat, minlength=1 << bits)
    hits = np.bincount(flat, weights=labels[row] if n else None, minlength=1 << bits)
    active = np.full(1 << bits, -1, np.int32)
    if n and 0 < n1 < n:
        expected = count * n1 / n
        z = (hits - expected) / np.sqrt(expected * (1 - n1 / n) * np.maximum(1 - count / n, 1e-9) + 1e-9)
        chosen = np.flatnonzero((count >= MIN_COUNT) & (np.abs(z) >= MIN_Z))
        chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:MAX_TERMS]])
        active[chosen] = np.arange(len(chosen), dtype=np.int32)
    m = int(active.max()) + 1
    prior = np.clip((n1 + 0.5) / (n + 1), 1e-4, 1 - 1e-4)
    rng = np.random.default_rng(seed)
    p = {"w0": np.array([np.log(prior / (1 - prior))]), "w": np.zeros(m), "v": rng.normal(0, 0.05, (m, factors))}
    if not m:
        return FactorizationMachine(active, float(p["w0"][0]), p["w"], p["v"])
    terms = [x[x >= 0] for x in (active[r] for r in rows)]
    m1, m2, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 512):
            some = order[a : a + 512]
            sizes = np.array([len(terms[i]) for i in some])
            ids, at = np.concatenate([terms[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            v = p["v"][ids]
            s, q = np.zeros((len(some), factors)), np.zeros(len(some))
            np.add.at(s, at, v)
            np.add.at(q, at, (v * v).sum(1))
            z = p["w0"][0] + np.bincount(at, weights=p["w"][ids], minlength=len(some)) + 0.5 * ((s * s).sum(1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            grads = {"w0": np.array([g.sum()]), "w": np.bincount(ids, weights=g[at], minlength=m) + decay * p["w"] * 0.1, "v": decay * p["v"]}
            np.add.at(grads["v"], ids, g[at, None] * (s[at] - v))
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.99 * m2[k] + 0.01 * grads[k] ** 2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return FactorizationMachine(active, float(p["w0"][0]), p["w"], p["v"].astype(np.float32))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        ids, texts, labels = columns(batch, "doc_id", "text", "label")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array([buckets(t).tobytes() for t in texts], pa.binary())], names=["doc_id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorizationMachine:
    """(doc_id, text), (doc_id, label 0 or 1) -> a model. Terms are hashed on executors; the driver fits the bounded sample."""
    labels = labels.where("label is not null")
    total = max(labels.count(), 1)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = labels.where(u < F.lit((1 << 30) * min(total, fit_rows) // total)).select("doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(_terms, "doc_id long, label int, terms binary").toArrow().to_pydict()
    order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i], rows["terms"][i], rows["label"][i]))
    return train([np.frombuffer(rows["terms"][i], np.int32) for i in order], np.array([rows["label"][i] for i in order], np.float64))


def scored(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1). Null and empty texts get the score of no terms. No shuffle."""
    kept = [c for c in docs.columns if c not in (text, "score")]
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__scored"):
            new = pa.array([model.score(buckets(t)) for t in columns(batch, "__scored")[0]], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), new], names=[*kept, "score"])

    return frame.mapInArrow(run, frame.select(*(F.col(f"`{c}`") for c in kept)).schema.add("score", "double"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10: learnt from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = fit(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")))
    return scored(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
