"""Quality scores: random-indexing word vectors, pooled per document, into a small calibrated network.

Word vectors are sums of fixed sparse random vectors of neighbouring tokens over the whole corpus. Tokens
share a fixed number of hash buckets, so the model has the same size for any corpus, and its sums are of
integers, so they don't depend on how the corpus is split.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.labelled import fold, training_rows
from dialoglens.llm.textops import Memo, parts

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


@dataclass(frozen=True)
class Settings:
    """``max_labelled`` bounds the rows the network learns from; all else covers the whole corpus."""

    buckets: int = 8192
    dim: int = 32
    nonzeros: int = 4
    reach: int = 2
    hidden: int = 32
    epochs: int = 40
    rate: float = 3e-3
    decay: float = 1e-4
    max_labelled: int = 16384
    seed: int = 11


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and the signs of its random vector's nonzeros."""
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, s.dim, (s.buckets, s.nonzeros)), rng.choice([-1.0, 1.0], (s.buckets, s.nonzeros))


def bucket_memo(s: Settings) -> Memo:
    return Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % s.buckets)


def buckets_of(text: str | None, memo: Memo) -> np.ndarray:
    words = TOKEN.findall(text) if text else []
    return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))


def context_sums(docs: DataFrame, s: Settings) -> np.ndarray:
    """``buckets`` x (``dim`` + 1): summed neighbour vectors and the number of neighbours, over all documents.

    Each task sends one row for each bucket at most; sums meet in Spark's partial aggregation, and what
    reaches the driver has the model's fixed size.
    """
    names = [f"d{i}" for i in range(s.dim + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (place, sign) = bucket_memo(s), index_vectors(s)
        total = np.zeros((s.buckets, s.dim + 1))
        for part in parts(batches):
            ids = [buckets_of(t, memo) for t in part.column("text").to_pylist()]
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
            for step in range(1, s.reach + 1):
                near = doc[step:] == doc[:-step]
                a, b = ids[:-step][near], ids[step:][near]
                for x, y in ((a, b), (b, a)):
                    total[:, s.dim] += np.bincount(x, minlength=s.buckets)
                    for j in range(s.nonzeros):
                        total[:, : s.dim] += np.bincount(x * s.dim + place[y, j], weights=sign[y, j], minlength=s.buckets * s.dim).reshape(s.buckets, s.dim)
        met = np.flatnonzero(total[:, s.dim])
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(np.rint(c).astype(np.int64)) for c in total[met].T)], ["bucket", *names])

    sums = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    table = sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((s.buckets, s.dim + 1))
    for i, n in enumerate(names):
        out[table.column("bucket").to_numpy(), i] = table.column(n).to_numpy()
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Mean contexts less the corpus's mean context, at unit length; zero for buckets never met."""
    n = sums[:, -1:]
    mean = sums[:, :-1] / np.maximum(n, 1) - sums[:, :-1].sum(0) / max(n.sum(), 1)
    return np.where(n > 0, mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9), 0).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, memo: Memo) -> np.ndarray:
    """Mean and deviation of the text's word vectors and the logarithm of its length; zeros without tokens."""
    v = vectors[buckets_of(text, memo)]
    if not len(v):
        return np.zeros(2 * vectors.shape[1] + 1, dtype=np.float32)
    return np.concatenate([v.mean(0), v.std(0), [np.log1p(len(v)) / 8]]).astype(np.float32)


@dataclass
class Network:
    """One hidden layer; ``prior`` alone is the score where there was nothing to learn."""

    prior: float
    weights: tuple[np.ndarray, ...] | None = None
    mean: np.ndarray | float = 0.0
    scale: np.ndarray | float = 1.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fitted(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, s: Settings) -> Network:
    """Adam on the cross-entropy of the rows outside ``calibrate``; the temperature that suits those inside best."""
    net = Network((y.sum() + 1) / (len(y) + 2))
    fit, held = ~calibrate, calibrate
    if len(y) == 0 or len(set(y[fit])) < 2:
        return net
    rng = np.random.default_rng(s.seed)
    net.mean, net.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z, t = ((x - net.mean) / net.scale)[fit], y[fit]
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(s.epochs):
        order, rate = rng.permutation(len(t)), s.rate * (1 - epoch / s.epochs)
        for at in range(0, len(t), 256):
            rows = order[at : at + 256]
            a, step = z[rows], step + 1
            h = np.tanh(a @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - t[rows]) / len(rows)
            back = np.outer(d, w[2]) * (1 - h * h)
            grads = [a.T @ back + s.decay * w[0], back.sum(0), h.T @ d + s.decay * w[2], d.sum()]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.weights = tuple(w)
    if held.any():
        logits, tests = net.logits(x[held]), np.geomspace(0.25, 8, 120)
        loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / q).mean() for q in tests]
        net.temperature = float(tests[int(np.argmin(loss))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, from the whole text alone.

    Word vectors cover all documents. The network learns from labelled rows outside fold 0, at most
    ``max_labelled``; a fifth of those only set the temperature. Null, empty and blank texts are scored as a
    text without tokens. Repeated rows get equal scores; other columns are not read. Without labels of both
    kinds every score is the smoothed share of positives; an empty table gives no rows.
    """
    s, sc = settings, docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(context_sums(docs, s)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = bucket_memo(s)
        for part in parts(batches):
            x = [pooled(t, vectors.value, memo).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    sample = training_rows(docs, labels, label, s.max_labelled).select("doc_id", "label", "text")
    known = sample.mapInArrow(features, "doc_id long, label int, x binary").toArrow().to_pylist()
    known.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in known], dtype=np.float64).reshape(len(known), 2 * s.dim + 1)
    y = np.array([float(r["label"] > 0) for r in known])
    calibrate = np.array([zlib.crc32(f"calibrate {r['doc_id']}".encode()) % 5 == 0 for r in known], dtype=bool)
    net = sc.broadcast(fitted(x, y, calibrate, s))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = bucket_memo(s)
        for part in parts(batches):
            x = np.array([pooled(t, vectors.value, memo) for t in part.column("text").to_pylist()], dtype=np.float64)
            p = net.value.score(x)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return narrow.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
