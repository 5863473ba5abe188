import math
import random
import re

import numpy as np

from brightmill.llm import toxicity
from cases import awkward

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark, data):
    data = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.scored(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r.is_toxic for r in rows if r.toxic == 1]
    clean = [r.is_toxic for r in rows if r.toxic == 0]
    assert len(toxic) > 5 and np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.02


def test_weights_are_sparse_and_learning_is_repeatable(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(3), labels.repartition(2))
    assert 0 < len(a.buckets) < 5000 and np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights)


def test_one_update_by_hand():
    f = toxicity.Ftrl(bits=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.0)
    f.learn(np.array([3]), 1)
    assert np.isclose(f.z[3], -0.5) and np.isclose(f.n[3], 0.25)
    assert np.isclose(f.weights(np.array([3]))[0], 0.4 / (1.5 / 0.5))


def naive(rows, epochs, alpha, beta, l1, l2):
    """FTRL-proximal with dictionaries over the feature texts themselves."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def features(text):
        w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())
        return {*w, *((1, *p) for p in zip(w, w[1:])), *((2, *p) for p in zip(w, w[2:]))}

    def weight(f):
        if abs(z.get(f, 0)) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    score = lambda fs: sum(map(weight, fs)) - bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
    for _ in range(epochs):
        for y, text in rows:
            fs = features(text)
            g = 1 / (1 + math.exp(-score(fs))) - y
            old = {f: weight(f) for f in fs}
            b = -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
            for f in fs:
                before = n.get(f, 0)
                n[f] = before + g * g
                z[f] = z.get(f, 0) + g - (math.sqrt(n[f]) - math.sqrt(before)) / alpha * old[f]
            before, bias[1] = bias[1], bias[1] + g * g
            bias[0] += g - (math.sqrt(bias[1]) - math.sqrt(before)) / alpha * b
    return lambda text: 1 / (1 + math.exp(-score(features(text)))), sorted(w for f in z if (w := weight(f)))


def test_like_a_naive_version(spark, monkeypatch):
    """Words, pairs and skip-pairs, the order of the rows, repeated rows, and the bound of the sample."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("good", "fine", "day", "tree", "bad", "Awful", "été")) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id bigint, text string")
    marks = [(i, 1, int("bad" in t or "Awful good" in t)) for i, t in rows if i % 4]
    labels = spark.createDataFrame(marks + marks[:9], LABELS)
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS o").collect()}
    train = [(y, texts[i]) for i, _, y in sorted(marks, key=lambda m: (order[m[0]], m[2]))]
    score, weights = naive(train, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, 0.5, toxicity.L2)
    model = toxicity.fit(docs, labels, l1=0.5)
    assert np.allclose(sorted(model.weights), weights) and len(weights) > 5
    assert all(math.isclose(r.toxicity, score(texts[r.doc_id]), rel_tol=1e-9) for r in toxicity.scored(docs, model).collect())
    monkeypatch.setattr(toxicity, "MAX_BYTES", 1)
    assert len(toxicity.fit(docs, labels, l1=0.5).weights) <= len(naive(train[:1], toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, 0.5, toxicity.L2)[1])


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (6, 0, 0)], LABELS)
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    nothing = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {(r.toxicity, r.is_toxic) for r in nothing} == {(0.0, False)}
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
