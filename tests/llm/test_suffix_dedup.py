import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightmill.llm import suffix_dedup as sd
from cases import awkward


@pytest.mark.parametrize("block", [1, 3, 17, sd.BLOCK])
def test_suffix_order_like_sorting(tmp_path, block):
    """Also where the files are many times the block that is held in memory."""
    rng = random.Random(7)
    for _ in range(8 if block < 9 else 25):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 9))]
        files = sd.Files(f"file://{tmp_path}")
        width = max(map(len, seqs))
        for part in (seqs[:2], seqs[2:]):
            sd.put_columns(files, np.array([x for s in part for x in s], np.uint8), np.array([len(s) for s in part], np.int64), width)
        files.turn(*(f"column{j}" for j in range(width)))
        who, count = sd.suffix_order(files, len(seqs), width, 3, block)
        own, size, lcp = files.read("own", who), files.read("size", count), files.read("lcp", count)
        files.close()
        want = sorted([(s[i:] + [k - len(seqs)], k, len(s) - i) for k, s in enumerate(seqs) for i in range(len(s) + 1)], key=lambda x: x[0])
        assert [(k, n) for _, k, n in want] == list(zip(own.tolist(), size.tolist()))
        for a, b, n in zip(want, want[1:], lcp[1:].tolist()):
            common = next(i for i in range(99) if i >= min(len(a[0]), len(b[0])) or a[0][i] != b[0][i])
            assert n == common
    assert not list(tmp_path.iterdir())


def test_range_minima():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, 1000).astype(np.int16)
    lo = rng.integers(0, 1000, 500)
    hi = np.minimum(lo + rng.integers(0, 900, 500), 999)
    assert sd.range_min(x, lo, hi).tolist() == [x[a : b + 1].min() for a, b in zip(lo, hi)]


def brute(rows, m):
    """Tokens of later copies, and of first copies, by document."""
    docs = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in rows if r.text is not None})
    place = {}
    for d in docs:
        w = d[2].split()
        for i in range(len(w) - m + 1):
            place.setdefault(tuple(w[i : i + m]), []).append((d[:2], d[2], i))
    later, first = {}, {}
    for at in place.values():
        if len(at) > 1:
            for mark, hits in ((first, at[:1]), (later, at[1:])):
                for d, text, i in hits:
                    mark.setdefault((d, text), set()).update(range(i, i + m))
    return later, first


def tokens(rows):
    out = {True: {}, False: {}}
    for r in rows:
        out[r.is_first].setdefault((r.doc_id is None, r.doc_id or 0), set()).update(range(r.start_token, r.start_token + r.n_tokens))
    return out


@pytest.mark.parametrize("m, block, collection", [(3, 50, 10), (5, sd.BLOCK, sd.COLLECTION), (12, 50, 1), (5, sd.BLOCK, 1)])
def test_like_brute_force(spark, m, block, collection, monkeypatch):
    for name, value in {"PIECE": 7, "BLOCK": block, "COLLECTION": collection}.items():
        monkeypatch.setattr(sd, name, value)
    rng = random.Random(m)
    pool = [[rng.choice("abcdef") for _ in range(rng.randint(m, 3 * m))] for _ in range(6)]
    texts = [" ".join(x for _ in range(4) for x in (rng.choice(pool) if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(5)])) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], "a a a a a a a a a a a a a a a a a a a a a a a a a", ""])] + [(None, None)], "doc_id bigint, text string")
    later, first = brute(docs.collect(), m)
    got = tokens(sd.repeats(docs, m).collect())
    assert got[False] == {k[0]: v for k, v in later.items()} and got[True] == {k[0]: v for k, v in first.items()}
    kept = {r.doc_id: r.text for r in sd.without_repeats(docs, m).collect()}
    for r in docs.collect():
        if r.text is None:
            continue
        key = ((False, r.doc_id), r.text)
        w = r.text.split()
        stay = [x for i, x in enumerate(w) if i not in later.get(key, ()) or i in first.get(key, ())]
        assert kept.get(r.doc_id, "").split() == stay


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert [r.text for r in rows if r.doc_id == 3] == [None] and [r.text for r in rows if r.doc_id == 4] == [""]
    assert not [r for r in rows if r.doc_id == 2]  # a copy of document 1
    assert len([r for r in rows if r.doc_id == 1]) == 3
    assert [r.text for r in rows if r.doc_id is None and r.text] == ["end"]  # NULL ids come last, so theirs is the later copy
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id in (6, 8))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    key = lambda r: (str(r.doc_id)[-1], r.start_token, r.n_tokens, r.is_first)
    assert sorted(map(key, sd.repeats(named).collect())) == sorted(map(key, sd.repeats(docs).collect()))
    assert sorted(str(r.text) for r in sd.without_repeats(named).collect()) == sorted(str(r.text) for r in rows)
    assert sd.repeats(docs.limit(0)).count() == 0 and sd.without_repeats(docs.limit(0)).count() == 0


def test_large_lists_are_joined_by_a_shuffle(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(map(tuple, sd.repeats(docs).collect()))
    from brightmill.llm import _shared

    monkeypatch.setattr(_shared, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, sd.repeats(docs.withColumn("th", F.lit(1))).collect())) == want and want
