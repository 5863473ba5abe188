import random
import re
import tracemalloc

import numpy as np
import pytest

from brightmill.llm import decontam
from cases import DOCS, awkward


def words(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())


def brute(item, text, least):
    """Greedy tiling by comparing every pair of positions: the longest free run, first in item, then text."""
    used_i, used_t, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not used_i[p + n] and not used_t[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, t)
        if best is None:
            return tiles
        n, p, t = best
        used_i[p : p + n] = used_t[t : t + n] = [True] * n
        tiles.append(best)


def test_tiles_like_brute_force():
    rng = random.Random(3)
    for least in (1, 2, 3, 4):
        for _ in range(40):
            item, text = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))], [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
            got = decontam.tile(np.array(item, np.uint64), np.array(text, np.uint64), least, start=rng.choice([1, 4, 32]))
            want = brute(item, text, least)
            assert sum(x[0] for x in got) == sum(x[0] for x in want)
            assert sorted(x[0] for x in got) == sorted(x[0] for x in want)


def fast_brute(item, text, least):
    """The same by a table of common run lengths, for longer texts: total of all tiles."""
    names = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([names[w] for w in item]), np.array([names.get(w, -1) for w in text])
    used_a, used_b, total = np.zeros(len(a), bool), np.zeros(len(b), bool), 0
    while True:
        run, best = np.zeros(len(b) + 1, int), (0, 0, 0)
        for p in range(len(a) - 1, -1, -1):
            run = np.append(np.where((b == a[p]) & ~used_b & (not used_a[p]), run[1:] + 1, 0), 0)
            t = int(run.argmax())
            if run[t] >= max(least, best[0]):
                best = (int(run[t]), p, t)
        n, p, t = best
        if not n:
            return total
        used_a[p : p + n] = used_b[t : t + n] = True
        total += n


def test_memory_of_repetitive_texts_is_bounded(monkeypatch):
    """Pieces of any size give the same tiles, and equal tokens do not fill the memory."""
    rng = random.Random(9)
    for pairs in (1, 7, 100):
        for _ in range(15):
            item, text = (np.array([rng.randint(1, 2) for _ in range(n)], np.uint64) for n in (rng.randint(4, 25), rng.randint(4, 60)))
            monkeypatch.setattr(decontam, "PAIRS", 1 << 21)
            want = decontam.tile(item, text, 3, start=4)
            monkeypatch.setattr(decontam, "PAIRS", pairs)
            assert decontam.tile(item, text, 3, start=4) == want
    monkeypatch.setattr(decontam, "PAIRS", 1 << 18)
    tracemalloc.start()
    tiles = decontam.tile(np.full(1500, 7, np.uint64), np.full(6000, 7, np.uint64), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(1500, 0, 0)] and peak < 100 << 20


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, "only three words"), (None, "one two three four five six seven eight"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_reordered_passages_and_awkward_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    more = spark.createDataFrame(
        [
            (20, "so Theta, iota kappa lambda mu then alpha beta gamma delta epsilon!", "en", "a", 1, None, None, None), (21, "alpha beta gamma nothing delta epsilon zeta nothing", "en", "a", 1, None, None, None),
            (None, "x one two three four x five six seven eight", "en", "a", 1, None, None, None), (20, "so Theta, iota kappa lambda mu then alpha beta gamma delta epsilon!", "en", "a", 1, None, None, None),
        ],
        DOCS,
    )
    docs, bench = awkward(spark).unionByName(more, allowMissingColumns=True), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontam.leaks(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == {(20, 1), (20, 5), (None, None)}
    assert len(got) == 5
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_items_that_repeat_a_phrase(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    chorus = " ".join(["la la la we sing the old song again"] * 20)
    items = [(1, chorus), (2, "na " * 200), (3, "one two three four five six seven eight")]
    docs = [(10, f"before {chorus} after"), (11, "na " * 150), (12, "la la la we sing the old song again"), (13, "one two three four x")]
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched_tokens) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(10, 1, 180), (11, 2, 150), (13, 3, 4)}
    assert [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()] == [12]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_table_like_brute_force(spark, data, monkeypatch, limit):
    """All documents, whole, with the benchmark broadcast and shuffled."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    data = data.replace("sf0.001", "sf0.01")
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = sorted([(r.doc_id, r.item_id, r.matched_tokens) for r in decontam.leaks(docs, bench).collect()], key=str)
    items = [(b.item_id, words(b.text)) for b in bench.collect()]
    want = []
    for d in docs.collect():
        w = words(d.text)
        own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        for i, item in items:
            # tiles of four tokens or more lie on shared seeds, so fewer cannot cover half of the item
            if 4 * sum(tuple(item[k : k + 4]) in own for k in range(len(item) - 3)) >= 0.5 * len(item) and item:
                total = fast_brute(item, w, 4)
                if total >= 0.5 * len(item):
                    want.append((d.doc_id, i, total))
    assert got == sorted(want, key=str) and want
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _, _ in want}


def test_both_ways_on_repeated_tokens(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("aabbbcdefghij") for _ in range(n))
    items = [(i, text(rng.randint(4, 40))) for i in range(12)]
    rows = [(i, f"{text(rng.randint(0, 30))} {' '.join(rng.sample([x for _, x in items], 2))[: rng.randint(10, 120)]} {text(500 * (i % 5 == 0))}") for i in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((d, i, n) for d, t in rows for i, x in items if (n := fast_brute(words(x), words(t), 4)) >= 0.5 * len(words(x)))
    for limit in (decontam.BROADCAST_BYTES, -1):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        assert sorted((r.doc_id, r.item_id, r.matched_tokens) for r in decontam.leaks(docs, bench).collect()) == want and want
