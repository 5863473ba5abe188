import numpy as np
import pytest
from pyspark.sql import functions as F

from brightmill.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, n string"


def brute(rows, k, asked=lambda i: True):
    """Every pair of vectors of one size."""
    vec = [np.array(r[1], np.float32).astype(float) for r in rows]
    out = []
    for i, r in enumerate(rows):
        if asked(r[0]):
            best = sorted((-int(np.rint(vec[i] @ vec[j] * 1e9)), rows[j][0]) for j in range(len(rows)) if j != i and len(vec[i]) == len(vec[j]))[:k]
            out += [(r[0], b, n + 1, -a / 1e9) for n, (a, b) in enumerate(best)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("query_id", "neighbor_id", "rank", "score").collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-8)


@pytest.mark.parametrize("slab_bytes", [512, topk.SLAB_BYTES])
def test_like_brute_force_with_ties_and_copies(spark, monkeypatch, slab_bytes):
    for name, value in {"BLOCK": 16, "QUERIES": 5, "STEP": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[40:70] = v[3]
    rows = [(i, (x[:5] if i % 9 == 4 else x).tolist(), 1, None, None) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(result(topk.top_k(df, k=7, slab_bytes=slab_bytes)), brute(rows, 7))
    same(result(topk.top_k(df, k=7, slab_bytes=slab_bytes, queries=F.col("vec_id") % 20 == 0)), brute(rows, 7, lambda i: i % 20 == 0))


def test_copies_with_rounding_noise_lose_no_neighbours(spark):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(2, 8)), 70, axis=0)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True) + rng.normal(size=v.shape) * 1e-7).astype(np.float32)
    rows = [(i, x.tolist(), 1, None, None) for i, x in enumerate(v)]
    same(result(topk.top_k(spark.createDataFrame(rows, SCHEMA))), brute(rows, 10))


def test_awkward_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1, 1, "a"), (2, [0.5, 0.5], None, 1, "a"), (2, [0.5, 0.5], None, 1, "a"), (3, None, 1, 1, "a"), (None, [1.0, 1.0], 1, 1, "a"), (4, [1.0, None], 1, 1, "a"), (5, [1.0], 1, 1, "a"), (6, [], 1, 1, "a"),
        (7, [float("nan"), 1.0], 1, 1, "a"), (8, [2.0], 1, 1, "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.neighbor_id) for r in topk.top_k(df, k=5).collect())
    # equal scores go by id, so a repeated id comes after the smaller one
    assert got == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 1, 1), (2, 2, 2), (2, 2, 2), (5, 1, 8), (8, 1, 5)]
    named = df.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert sorted((r.query_id, r.rank, r.neighbor_id) for r in topk.top_k(named, k=1).collect()) == [("v1", 1, "v2"), ("v2", 1, "v1"), ("v2", 1, "v1"), ("v5", 1, "v8"), ("v8", 1, "v5")]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df, queries=F.lit(False)).count() == 0
    long = spark.createDataFrame([(i, [float(i + 1)] * 30_000, 1, 1, "a") for i in range(4)], SCHEMA)
    assert sorted((r.query_id, r.neighbor_id) for r in topk.top_k(long, k=1, slab_bytes=1 << 16).collect()) == [(0, 3), (1, 3), (2, 3), (3, 2)]
