"""Quality scores from supervised subword embeddings.

A document is the mean of learned vectors of its words, of its pairs of
neighbouring words and of its character n-grams, each hashed to a bucket; a
softmax layer turns the mean into class probabilities.  Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample.

Scoring needs no vectors: as the layer is linear, each bucket's vector reduces
to one number, and a document's logit is a mean of table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, mix64, pieces
from .samples import held_out, labelled_sample

BUCKET_BITS = 16
FAMILIES = 3  # words, pairs of words, character n-grams: each has its own buckets
SIZES = (3, 4)
_U = np.uint64


def features(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family (bucket of each occurrence, offsets by document)."""
    w = Words(data, offs)
    mask = _U((1 << BUCKET_BITS) - 1)
    words = (w.hash & mask).astype(np.int32)
    at = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w.doc) else np.zeros(0, np.int64)
    first, second = w.hash[at], w.hash[at + 1]
    # A word that follows itself is one feature, whichever word it is.
    pairs = np.where(first == second, _U(0), mix64(first * _U(3) + second) & mask).astype(np.int32)
    pair_offs = np.searchsorted(at, w.of)
    grams, gram_offs = [], np.zeros(len(offs), np.int64)
    plain = data.astype(np.uint32)
    parts = []
    for n in SIZES:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + plain[k : len(data) - n + 1 + k]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        parts.append((n, code.astype(np.int32)))
    # Grams of a document: those that begin and end in it.
    lists, counts = [], np.zeros(len(offs) - 1, np.int64)
    for n, code in parts:
        begin, end = np.minimum(offs[:-1], len(code)), np.clip(offs[1:] - n + 1, offs[:-1], None)
        end = np.minimum(end, len(code))
        counts += end - begin
        inside = np.zeros(len(code) + 1, np.int32)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        keep = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        lists.append((np.searchsorted(offs, keep, "right") - 1, code[keep]))
    if lists:
        doc = np.concatenate([d for d, _ in lists])
        order = np.argsort(doc, kind="stable")
        grams = np.concatenate([c for _, c in lists])[order]
        gram_offs = np.concatenate([[0], np.cumsum(counts)])
    return [(words, w.of.astype(np.int64)), (pairs, pair_offs.astype(np.int64)), (np.asarray(grams, np.int32), gram_offs)]


def mean_by_document(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    n = np.maximum(np.diff(offs), 1).reshape(-1, *[1] * (values.ndim - 1))
    return (sums[offs[1:]] - sums[offs[:-1]]) / n


@dataclass(frozen=True)
class QualityModel:
    """weights: a number by family and bucket; bias: the logit of an empty text."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        logit = np.full(len(offs) - 1, self.bias)
        for table, (bucket, by) in zip(self.weights, features(data, offs), strict=True):
            logit += mean_by_document(table[bucket], by)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(sample: list[tuple[str, object]], dim: int = 8, epochs: int = 4, rate: float = 0.5, batch: int = 32, seed: int = 7) -> QualityModel:
    """Train on (text, 0 or 1) pairs.  Classes weigh alike, whatever their share."""
    buckets = 1 << BUCKET_BITS
    if not sample:
        return QualityModel(np.zeros((FAMILIES, buckets), np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((FAMILIES, buckets, dim)) - 0.5) / dim
    layer = rng.normal(0, 1, (dim, 2))
    bias = np.zeros(2)
    grown = np.full((FAMILIES, buckets), 1e-6)
    docs = []
    for text, label in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        own = []
        for bucket, _ in features(raw, np.array([0, len(raw)])):
            ids, count = np.unique(bucket, return_counts=True)
            own.append((ids, count / max(1, len(bucket))))
        docs.append((own, int(label)))
    share = np.bincount([y for _, y in docs], minlength=2).astype(float)
    weight = share.sum() / (2 * np.maximum(share, 1))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            own = [docs[i] for i in order[lo : lo + batch]]
            y = np.array([d[1] for d in own])
            hidden, parts = np.zeros((len(own), dim)), []
            for f in range(FAMILIES):
                ids = np.concatenate([d[0][f][0] for d in own])
                share_of = np.concatenate([d[0][f][1] for d in own])
                row = np.repeat(np.arange(len(own)), [len(d[0][f][0]) for d in own])
                parts.append((ids, share_of, row))
                np.add.at(hidden, row, vectors[f][ids] * share_of[:, None])
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(own)
            back = p @ layer.T
            step = rate * (1 - epoch / epochs)
            layer -= step * hidden.T @ p
            bias -= step * p.sum(axis=0)
            for f, (ids, share_of, row) in enumerate(parts):
                g = back[row] * share_of[:, None]
                total = np.zeros(buckets)
                np.add.at(total, ids, (g * g).mean(axis=1))
                seen = np.flatnonzero(total)
                grown[f][seen] += total[seen]
                np.subtract.at(vectors[f], ids, step * 0.1 * g / np.sqrt(grown[f][ids])[:, None])
    direction = layer[:, 1] - layer[:, 0]
    return QualityModel((vectors @ direction).astype(np.float32), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1000, max_chars: int = 1 << 16, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted
    (1 from ``threshold`` on) of each row of ``docs``.

    ``labels`` has the id and a column ``quality`` of 0 and 1 (other values and
    nulls teach nothing).  The model is fitted on at most ``per_label`` texts of
    each label, of texts of more than ``max_chars`` characters on so many of them;
    every whole text is scored.  A null text counts as empty; an empty one gets the
    bias alone.  Without labelled rows all scores are 0.5.  Repeated rows and null
    ids give a row each, an empty table none; other columns aren't read, whatever
    their names.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(id_col, "quality")
    model = fit(labelled_sample(docs, known, "quality", per_label, max_chars, id_col, text_col))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch, data, offs in pieces(batches, "__text"):
            score = own.scores(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("__held"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
