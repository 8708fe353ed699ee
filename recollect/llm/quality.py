"""Operator 2: quality classifier, a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes slide over overlapping chunks that cover the whole document; each filter is
max-pooled in every chunk, the chunks' maxima are combined by maximum and mean, and a logistic unit makes one probability.
In scoring, a filter's bytes are summed from tables over byte pairs, so that a position costs WIDTH / 2 lookups.

Bounds of learning, documented parameters: SAMPLE labelled rows, texts of at most SAMPLE_BYTES. Scoring reads every text
whole. Defined results: null counts as empty, and an empty text gets the bias's probability; texts shorter than a filter
are padded with zero bytes; repeated rows repeat results; without labels of both kinds every score is the labels' mean
(1/2 without labels); an empty table gives no rows; a null doc_id learns nothing and is scored; extra columns pass through
``score``, but for one named quality_score, which it replaces. A text over SCORING_BYTES is read window by window, with
the same chunks, so its memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table, text_bytes, without
from .labelled import fitted, fold, sample

FILTERS, WIDTH = 12, 6
CHUNK, STEP = 512, 480
SAMPLE, SAMPLE_BYTES = 2400, 8_000
EPOCHS, BATCH, RATE = 14, 64, 0.02
THRESHOLD = 0.3
SCORING_BYTES = 500_000


def chunks(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of overlapping chunks of filter positions that cover each document; off: offsets of padded documents."""
    sizes = np.maximum(np.diff(off) - WIDTH + 1, 0)
    n = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    n[sizes == 0] = 0
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = off[:-1][doc] + k * STEP
    return start, np.minimum(start + CHUNK, off[:-1][doc] + sizes[doc]), doc


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each non-empty document with zero bytes up to a filter's width."""
    sizes = np.diff(off)
    short = np.flatnonzero((sizes > 0) & (sizes < WIDTH))
    if not len(short):
        return data, off
    parts = [data[off[i] : off[i + 1]] for i in range(len(sizes))]
    for i in short:
        parts[i] = np.pad(parts[i], (0, WIDTH - sizes[i]))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.t = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.c = np.zeros(FILTERS, np.float32)
        self.w = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.b = np.float32(0)

    def pairs(self) -> list[np.ndarray]:
        return [np.ascontiguousarray((self.t[j][:, None, :] + self.t[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, WIDTH, 2)]

    def respond(self, data: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Response of each filter at each position, [position, filter], before the rectifier."""
        two = data[:-1].astype(np.int32) * 256 + data[1:]
        n = len(data) - WIDTH + 1
        out = pairs[0].take(two[:n], axis=0)
        for j in range(1, WIDTH // 2):
            out += pairs[j].take(two[2 * j : 2 * j + n], axis=0)
        return out

    def pooled(self, data: np.ndarray, off: np.ndarray, pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rectified maxima of chunks, the chunks' documents, their starts and ends."""
        start, end, doc = chunks(off)
        if not len(start):
            return np.zeros((0, FILTERS), np.float32), doc, start, end
        out = self.respond(data, pairs)
        edges = np.stack((start, end), 1).ravel()
        if edges[-1] >= len(out):
            edges = edges[:-1]
        top = np.maximum.reduceat(out, edges, axis=0)[::2]
        return np.tanh(np.maximum(top + self.c, 0)), doc, start, end

    @staticmethod
    def combined(top: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and mean of each document's chunks; number of its chunks."""
        count = np.bincount(doc, minlength=n)
        out = np.zeros((n, 2 * FILTERS), np.float32)
        has = np.flatnonzero(count)
        if len(has):
            first = np.searchsorted(doc, has)
            out[has, :FILTERS] = np.maximum.reduceat(top, first, axis=0)
            out[has, FILTERS:] = np.add.reduceat(top, first, axis=0) / count[has][:, None]
        return out, count

    def probabilities(self, data: np.ndarray, off: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        if len(off) == 2 and len(data) > 2 * SCORING_BYTES:
            x = self.long(data, pairs)
        else:
            data, off = padded(data, off)
            top, doc, _, _ = self.pooled(data, off, pairs)
            x, _ = self.combined(top, doc, len(off) - 1)
        return 1 / (1 + np.exp(-np.clip((x * self.w).sum(1) + self.b, -60, 60).astype(float)))

    def long(self, data: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """What combined gives for one long document, its chunks taken a window at a time."""
        start, end, _ = chunks(np.array([0, len(data)]))
        each = max(1, SCORING_BYTES // STEP)
        best, total = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS)
        for k in range(0, len(start), each):
            s, e = start[k : k + each], end[k : k + each]
            out = self.respond(data[s[0] : e[-1] + WIDTH - 1], pairs)
            edges = np.stack((s, e), 1).ravel() - s[0]
            edges = edges[:-1] if edges[-1] >= len(out) else edges
            top = np.tanh(np.maximum(np.maximum.reduceat(out, edges, axis=0)[::2] + self.c, 0))
            best, total = np.maximum(best, top.max(0)), total + top.sum(0, dtype=float)
        return np.concatenate((best, total / len(start))).astype(np.float32)[None, :]

    def fit(self, texts: list[bytes], y: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("t", "c", "w", "b")}
        weight = np.where(y == 0, min(4.0, max(1.0, y.mean() / max(1e-3, 1 - y.mean()))), 1.0)
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                ids = order[a : a + BATCH]
                raw = [texts[i] for i in ids]
                data = np.frombuffer(b"".join(raw), np.uint8)
                off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
                data, off = padded(data, off)
                start, end, doc = chunks(off)
                if not len(start):
                    continue
                # filters act through single-byte tables here; pair tables would cost more than they save
                n = len(data) - WIDTH + 1
                out = self.t[0].take(data[:n], axis=0)
                for j in range(1, WIDTH):
                    out += self.t[j].take(data[j : j + n], axis=0)
                where = np.stack([s + out[s:e].argmax(0) for s, e in zip(start, end, strict=True)])  # [chunk, filter]
                top = np.tanh(np.maximum(out[where, np.arange(FILTERS)] + self.c, 0))
                x, count = self.combined(top, doc, len(ids))
                p = 1 / (1 + np.exp(-np.clip((x * self.w).sum(1) + self.b, -60, 60)))
                d = ((p - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
                grad = {"w": x.T @ d + 1e-4 * self.w, "b": d.sum()}
                back = d[doc][:, None] * self.w[FILTERS:] / count[doc][:, None]
                best = x[:, :FILTERS][doc] == top
                back += best * (d[doc][:, None] * self.w[:FILTERS]) / np.maximum(1, np.add.reduceat(best, np.searchsorted(doc, np.arange(len(ids)))[np.unique(doc)], axis=0)[np.unique(doc, return_inverse=True)[1]])
                back *= (1 - top * top) * (top > 0)
                grad["c"] = back.sum(0)
                gt = np.zeros_like(self.t)
                columns = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    gt[j] = np.bincount((data[where + j].astype(np.int64) * FILTERS + columns).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grad["t"] = gt + 1e-5 * self.t
                step += 1
                rate = RATE * (1 - 0.9 * epoch / EPOCHS)
                for k, g in grad.items():
                    m, v = state[k]
                    m[...] = 0.9 * m + 0.1 * g
                    v[...] = 0.99 * v + 0.01 * g * g
                    setattr(self, k, (getattr(self, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        return self


def fit(texts: list[str], y: np.ndarray) -> Network:
    net = Network()
    if not len(y) or y.min() == y.max():
        net.w[:] = 0
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        net.b = np.float32(np.log(mean / (1 - mean)))
        return net
    return net.fit([t.encode() for t in texts], y)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Network:
    return fitted(sample(docs, labels, "quality", 5, 0, limit, SAMPLE_BYTES), fit)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with quality_score."""
    docs = without(docs, "quality_score")
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        pairs = net.pairs()
        for batch in pieces(batches, "text", SCORING_BYTES):
            values = net.probabilities(*text_bytes(batch.column("text")), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    got = score(docs, net)
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
