import random
from collections import Counter

from brightmill.llm import packing
from cases import DOCS, awkward


def brute(sizes, capacity):
    """Try every placement and add up all squares."""
    bins, out = [], []

    def squares(gaps):
        c = Counter(g for g in gaps if 0 < g < capacity)
        return sum(v * v for v in c.values())

    for s in sizes:
        while s >= capacity:
            bins.append(capacity)
            out.append(len(bins) - 1)
            s -= capacity
        if not s:
            continue
        best = None
        for b, used in enumerate([*bins, 0]):
            gap = capacity - used
            if gap < s or (b < len(bins) and gap == 0):
                continue
            gaps = [capacity - u for u in bins] + [capacity] * (b == len(bins))
            gaps[b] -= s
            key = (squares(gaps), gap - s, b == len(bins))
            if best is None or key < best[0]:
                best = (key, b)
        b = best[1]
        if b == len(bins):
            bins.append(0)
        bins[b] += s
        out.append(b)
    return bins, out


def test_same_bins_as_trying_everything():
    rng = random.Random(5)
    for capacity in (7, 20, 64):
        for _ in range(20):
            sizes = [rng.randint(0, capacity + capacity // 2) for _ in range(60)]
            index, piece, where, offset, n = packing.pack(sizes, capacity)
            bins, _ = brute(sizes, capacity)
            used = Counter()
            for i, k, b in zip(index, piece, where):
                used[b] += min(capacity, sizes[i] - k * capacity)
            assert sorted(used[b] for b in range(n)) == sorted(bins)


def test_pieces_lie_in_bins_without_overlap(spark):
    rows = packing.packed(awkward(spark), capacity=64, per_shard=4).collect()
    by = {}
    for r in rows:
        if r.bin_id is None:
            assert (r.n_tokens, r.piece) == (0, 0)
        else:
            by.setdefault(r.bin_id, []).append((r.offset, r.n_tokens))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= 64
    words = Counter()
    for r in awkward(spark).collect():
        words[r.doc_id] += len((r.text or "").split())
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == words and len([r for r in rows if r.doc_id == 1 and r.piece == 0]) == 3


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], DOCS)).collect() == []


def test_whole_table_is_packed(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.packed(docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    bins = {r.bin_id for r in rows if r.bin_id is not None}
    assert sum(r.n_tokens for r in rows) > 0.8 * 2048 * len(bins)


def test_shards_cost_few_bins(spark, data):
    """Every piece is placed once whatever the shards, and their loss is bounded."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet")
    one, many = (packing.packed(docs, per_shard=n).select("doc_id", "piece", "n_tokens", "bin_id").collect() for n in (1 << 20, 2000))
    assert sorted(r[:3] for r in one) == sorted(r[:3] for r in many)
    bins = [len({r.bin_id for r in rows} - {None}) for rows in (one, many)]
    assert bins[0] <= bins[1] <= 1.02 * bins[0]
