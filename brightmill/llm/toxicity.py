"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (lower-cased words): every word, every pair of neighbours and every pair with one
word between, each hashed into ``2**BITS`` buckets and counted once per text. FTRL-proximal keeps a
rate per coordinate and an L1 bound, so most weights stay exactly zero; what remains is a small sorted
(bucket, weight) table that goes to every task.

Training uses at most about ``max_rows`` different labelled rows (chosen by a hash of doc_id, whole texts), and of these,
in the order of a hash, as many as have ``MAX_BYTES`` of features; all documents are then scored over their whole texts in
one pass without a shuffle.

Defined results: NULL and empty texts score the bias alone; NULL labels and NULL texts do not train;
NULL ``doc_id`` rows are scored; repeated rows train once and are scored alike; an id with both labels trains with both; without a labelled row every score is
0 and nothing is toxic; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small
from ._text import NON_WORD, Tokens, mix, rebatch

BITS = 22
#: Most labelled rows (about) that train the model.
MAX_ROWS = 24_000
#: Most bytes of features that are learned from (4 a feature and text).
MAX_BYTES = 512 << 20
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 0.0, 3
#: Chosen on held-out rows: about one in nine documents is toxic, and recall counts.
THRESHOLD = 0.2
_MASK = np.uint64((1 << BITS) - 1)


def features(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram and skip-gram, with repeats."""
    h, doc = tokens.hash, tokens.doc()
    docs, buckets = [doc], [h & _MASK]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) <= gap:
            continue
        inside = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][inside])
        buckets.append((mix(h[:-gap] * np.uint64(salt) + h[gap:]) & _MASK)[inside])
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


class Ftrl:
    """Logistic regression with FTRL-proximal updates."""

    def __init__(self, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i):
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        x = float(np.clip(w.sum() + self.bias, -35, 35))
        g = 1 / (1 + math.exp(-x)) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g
        b, bn = self.bias, self.bias_n
        self.bias_n = bn + g * g
        self.bias_z += g - (math.sqrt(self.bias_n) - math.sqrt(bn)) / self.alpha * b

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        i = np.flatnonzero(np.abs(self.z) > self.l1)
        w = self.weights(i)
        return i[w != 0].astype(np.int32), w[w != 0], self.bias


class Model:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def scorer(self):
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.buckets] = 1
        full = np.zeros(1 << BITS)
        full[self.buckets] = self.weights

        def score(column) -> np.ndarray:
            tokens = Tokens(column, NON_WORD, lower=True)
            doc, bucket = features(tokens)
            hit = dense[bucket] != 0
            pairs = np.unique((doc[hit].astype(np.int64) << BITS) | bucket[hit])
            total = np.bincount(pairs >> BITS, full[pairs & ((1 << BITS) - 1)], len(column)) + self.bias
            return np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -35, 35))))

        return score


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_ROWS, l1: float = L1) -> Model:
    """Train on a bounded sample of the labelled rows, in one task fed by a parallel feature pass."""
    marked = labels.select(F.col("doc_id").alias("k"), F.col(target).cast("int").alias("y")).filter("k is not null and y in (0, 1)").distinct()
    n = marked.count()
    share = min(1.0, max_rows / max(n, 1))
    marked = marked.filter(F.abs(F.xxhash64("k") % F.lit(1_000_000_007)) < F.lit(share * 1_000_000_007.0))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("text"))
    joined = texts.join(small(marked, marked.count(), 24), F.col("k") == F.col("d")).filter("text is not null").select(F.xxhash64("k", "text").alias("o"), "y", "text")

    def extract(batches):
        seen = set()
        for batch in rebatch(batches, 512, 4 << 20):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            batch = batch.filter(pa.array([not (x in seen or seen.add(x)) for x in keys], pa.bool_()))  # a task sends each row once
            tokens = Tokens(batch.column(2), NON_WORD, lower=True)
            doc, bucket = features(tokens)
            pairs = np.unique((doc.astype(np.int64) << BITS) | bucket)
            at = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
            index = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([index[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["o", "y", "x"])

    most = MAX_BYTES

    def learn(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for o, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (o, y) != last and size < most:
                    rows.append((y, np.frombuffer(x, np.int32)))
                    size, last = size + len(x), (o, y)
        if rows:
            model = Ftrl(l1=l1)
            for _ in range(EPOCHS):
                for y, x in rows:
                    model.learn(x, y)
            i, w, bias = model.compact()
            yield pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["i", "w", "bias"])

    got = joined.mapInArrow(extract, "o bigint, y int, x binary").repartition(1).sortWithinPartitions("o", "y").mapInArrow(learn, "i binary, w binary, bias double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0), -math.inf)
    return Model(np.frombuffer(got[0].i, np.int32), np.frombuffer(got[0].w), got[0].bias)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, is_toxic) of every row."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxicity double, is_toxic boolean"

    def run(batches):
        score = given.value.scorer()
        for batch in rebatch(batches, 2048, 4 << 20):
            p = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p > threshold)], names=["doc_id", "toxicity", "is_toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
