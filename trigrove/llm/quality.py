"""Quality by nearest-neighbour voting over latent-semantic vectors of labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import LOWER, map_arrow, mix, prefix_hash, range_hash, read, text_bytes, words
from trigrove.llm.toxicity import held_out, training_rows

#: Labelled documents whose vectors are broadcast and voted by, at most (a documented bound).
FIT_ROWS = 4096
#: Hashed terms (pairs of neighbouring bytes, and words), latent dimensions and neighbours.
TERMS, RANK, NEIGHBOURS = 1024, 40, 24
#: Weight of the shape measures against the terms before the decomposition.
SHAPE = 0.35


def shape_of(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Measures of each text's form: lengths, kinds of characters, repetition of words and lines, word endings."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    size = np.maximum(hist.sum(1), 1)
    code = np.arange(256)
    upper, lower, digit = (code >= 65) & (code < 91), (code >= 97) & (code < 123), (code >= 48) & (code < 58)
    blank, wide = np.isin(code, [9, 10, 11, 12, 13, 32]), code >= 128
    signs = ~(upper | lower | digit | blank | wide)
    plain = np.isin(code, [ord(c) for c in ".,;:!?'\"-()"])
    n_words = np.maximum(np.diff(counts), 1)
    length = (ends - starts).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(counts))
    per = lambda v: np.bincount(of, v, n) / n_words
    mean = per(length)
    same = np.zeros(len(hashed))
    same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd_end = (signs & ~plain)[last].astype(float) if len(last) else np.zeros(0)
    cuts = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts[cuts < len(data) - 1] + 1])) if len(data) else np.zeros(0, np.int64)
    line_hash = range_hash(prefix_hash(data), line_starts, np.append(line_starts[1:], len(data))) if len(data) else np.zeros(0, np.uint64)
    lines = np.searchsorted(line_starts, offsets)
    distinct, top, line_distinct = np.ones(n), np.zeros(n), np.ones(n)
    for k in range(n):
        own = hashed[counts[k] : counts[k + 1]]
        if len(own):
            freq = np.unique(own, return_counts=True)[1]
            distinct[k], top[k] = len(freq) / len(own), freq.max() / len(own)
        own = line_hash[lines[k] : lines[k + 1]]
        if len(own):
            line_distinct[k] = len(np.unique(own)) / len(own)
    n_lines = np.maximum(np.diff(lines), 1)
    p = hist / size[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    share = lambda mask: hist[:, mask].sum(1) / size
    return np.stack(
        [
            np.log1p(size), np.log1p(np.diff(counts)), mean, np.sqrt(np.maximum(per(length**2) - mean**2, 0)), share(upper), share(digit), share(blank), share(wide),
            share(signs & plain), np.sqrt(share(signs & ~plain)), np.sqrt(per(odd_end)), distinct, distinct * np.log1p(n_words), np.sqrt(top), np.sqrt(per(same)),
            line_distinct, np.log1p(n_lines), np.log1p(size / n_lines), entropy, np.sqrt(share(code == ord("|"))), np.sqrt(share(code == ord("."))),
        ], 1,
    )


def measured(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed term counts, shape measures) of each text; null counts as empty."""
    data, offsets = text_bytes(column)
    starts, ends, counts = words(data, offsets)
    low = LOWER[data]
    hashed = range_hash(prefix_hash(low), starts, ends)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    half = TERMS // 2
    pair = (low[:-1].astype(np.uint64) << np.uint64(8)) | low[1:] if len(low) > 1 else np.zeros(0, np.uint64)
    inside = doc[:-1] == doc[1:]
    terms = np.bincount((doc[:-1] * TERMS + (mix(pair) % np.uint64(half)).astype(np.int64))[inside], minlength=n * TERMS)
    of = np.repeat(np.arange(n), np.diff(counts))
    terms += np.bincount(of * TERMS + half + (hashed % np.uint64(half)).astype(np.int64), minlength=n * TERMS)
    return terms.reshape(n, TERMS).astype(np.float32), shape_of(data, offsets, starts, ends, counts, hashed)


@dataclass
class Model:
    """The latent space and the labelled vectors that vote."""

    idf: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def raw(self, terms: np.ndarray, shape: np.ndarray) -> np.ndarray:
        t = np.log1p(terms) * self.idf
        t /= np.maximum(np.sqrt((t * t).sum(1, keepdims=True)), 1e-9)
        s = np.clip((shape - self.center) / self.scale, -4, 4) * SHAPE
        return np.concatenate([t, s], 1).astype(np.float32)

    def latent(self, terms: np.ndarray, shape: np.ndarray) -> np.ndarray:
        x = self.raw(terms, shape) @ self.axes
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Blocked cosines with every labelled vector; of the nearest each votes with the weight exp(8 (cosine - the best))."""
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        k = min(self.neighbours, len(self.vectors))
        out = np.zeros(len(x))
        for a in range(0, len(x), 512):
            cosine = x[a : a + 512] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, 1)[:, :k]
            c = np.take_along_axis(cosine, near, 1).astype(np.float64)
            weight = np.exp(8 * (c - c.max(1, keepdims=True)))
            out[a : a + 512] = ((weight * self.labels[near]).sum(1) + 0.5 * self.prior) / (weight.sum(1) + 0.5)
        return out


def learn(texts: list[str], labels: list[int], rank: int = RANK) -> Model:
    """Truncated singular value decomposition of the labelled texts' weighted terms and shapes."""
    y = np.array(labels, float)
    parts = [measured(pa.array(texts[a : a + 256], pa.string())) for a in range(0, len(texts), 256)]
    prior = float(y.mean()) if len(y) else 0.5
    if not parts:
        width = 21
        return Model(np.ones(TERMS), np.zeros(width), np.ones(width), np.zeros((TERMS + width, 1), np.float32), np.zeros((0, 1), np.float32), y, prior)
    terms, shape = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    idf = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 0.2
    model = Model(idf, shape.mean(0), np.maximum(shape.std(0), 1e-6), np.zeros(0), np.zeros(0), y, prior)
    raw = model.raw(terms, shape).astype(np.float64)
    values, axes = np.linalg.eigh(raw.T @ raw)
    model.axes = axes[:, ::-1][:, : min(rank, len(values))].astype(np.float32)
    model.vectors = model.latent(terms, shape)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """The model of the documents' labels (column ``quality``), from at most ``most`` rows that aren't held out."""
    rows = training_rows(docs, labels, "quality", most)
    return learn([r["text"] for r in rows], [r["y"] for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, of each whole text. Null and empty texts are scored as empty ones; rows may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS vectors of RANK numbers

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        return {"doc_id": batch.column("doc_id"), "score": m.vote(m.latent(*measured(batch.column("text"))))}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
