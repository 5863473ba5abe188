import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from brightmill.llm import ngram_join as nj
from cases import DOCS, awkward


def grams(text, n=3):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold=0.5):
    sets = [(r.doc_id, grams(r.text)) for r in rows]
    out = {}
    for (a, x), (b, y) in combinations([s for s in sets if s[1]], 2):
        if len(x & y) >= threshold * len(x | y):
            out.setdefault((a, b), 0)
            out[(a, b)] = max(out[(a, b)], len(x & y) / len(x | y))
    return out


def classes(docs, pairs):
    """doc_id: (class, links) by union of linked and of equal sets; links are counted between different sets."""
    sets = {r.doc_id: frozenset(grams(r.text)) for r in docs}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = {}
    for x, y in pairs:
        links.setdefault(sets[x], set()).add(sets[y]), links.setdefault(sets[y], set()).add(sets[x])
        x, y = sorted((find(x), find(y)))
        top[y] = x
    return {d: (find(d), len(links.get(s, set()) - {s})) for d, s in sets.items()}


def test_recall_and_exact_similarities(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.collect()
    sets = {r.doc_id: frozenset(grams(r.text)) for r in rows}
    every = {(min(k), max(k)): v for k, v in brute(rows).items()}
    name = {}
    for d in sorted(sets):
        name.setdefault(sets[d], d)
    want = {k: v for k, v in every.items() if sets[k[0]] != sets[k[1]] and name[sets[k[0]]] == k[0] and name[sets[k[1]]] == k[1]}
    got = {(r.id_a, r.id_b): r.jaccard for r in nj.similar_pairs(docs).collect()}
    assert set(got) <= set(want) and len(got) >= nj.RECALL * len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    found = {r.doc_id: (r.class_id, r.links) for r in nj.linked(docs).collect()}
    same = [k for k in every if sets[k[0]] == sets[k[1]]]
    copies = {(a, b) for a, b in every if (name[sets[a]], name[sets[b]]) in got or (name[sets[b]], name[sets[a]]) in got}
    assert found == classes(rows, [*same, *copies])


def test_large_groups_are_cut_into_tiles(spark, monkeypatch):
    """Groups that no split takes apart are still compared in full, each pair once."""
    monkeypatch.setattr(nj, "LIMIT", 4)
    monkeypatch.setattr(nj, "BLOCK", 3)
    base = [f"token{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"own{i}"]), "en", "a", 1, None, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    assert nj.similar_pairs(docs).count() == 40 * 39 // 2
    assert {(r.class_id, r.links) for r in nj.linked(docs).collect()} == {(0, 39)}
    assert [r.doc_id for r in nj.one_per_group(docs).collect()] == [0]


def test_intersections():
    rng = np.random.default_rng(1)
    found = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in found] for a in found]
    assert nj.overlaps(found, 640).tolist() == want == nj.overlaps(found).tolist() or all(nj.overlaps(found)[i, j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_larger_sides_are_joined_by_a_shuffle(spark, data, monkeypatch):
    from brightmill.llm import _shared

    docs = spark.read.parquet(f"{data}/documents.parquet")
    want, kept = sorted(map(tuple, nj.linked(docs).collect())), sorted(map(tuple, nj.one_per_group(docs).collect()))
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, nj.linked(docs).collect())) == want and sorted(map(tuple, nj.one_per_group(docs).collect())) == kept


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert nj.similar_pairs(docs).count() == 0
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id or 0, r.links) for r in nj.linked(docs).collect())
    assert got == [(False, 1, 1, 0), (False, 1, 1, 1), (False, 1, 1, 1), (False, 2, 1, 1), *((False, i, i, 0) for i in (3, 4, 5, 6, 7, 8)), (True, 0, 0, 0), (True, 0, 1, 1)]
    kept = nj.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = sorted([(r.doc_id is None, r.doc_id or 0) for r in kept.collect()])
    assert ids == [(False, 1), (False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert nj.linked(docs.limit(0)).count() == 0 and nj.similar_pairs(docs.limit(0)).count() == 0 and nj.one_per_group(docs.limit(0)).count() == 0


def test_chains_of_similar_documents_form_one_group(spark):
    """a ~ b ~ c ~ ... without all pairs being similar: one document stays."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 10 : i * 10 + 60]), "en", "a", 1, None, None, None) for i in range(12)]
    kept = nj.one_per_group(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.doc_id for r in kept] == [0]


def test_ids_of_any_type_and_clashing_names(spark):
    docs = awkward(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {(r.doc_id, r.class_id) for r in nj.linked(docs).filter("links > 0").collect()} == {("d1", "d1"), ("d2", "d1"), (None, "d1")}
    assert nj.one_per_group(docs).columns == docs.columns


def test_runs_reach_the_recall():
    for threshold in (0.5, 0.7, 0.8):
        n = nj.runs_needed(threshold, 0.97)
        assert nj.missed(threshold, n) <= 0.03 < nj.missed(threshold, n - 1) if n > 1 else True
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(300):  # pairs at the threshold, split to the full depth
        common = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = (nj.signature(np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)]))) for _ in range(2))
        paths = [{r << 56 | 1} for r in range(nj.runs_needed(0.5, 0.97))]
        met = False
        for p in paths:
            for _ in range(nj.DEPTH):
                here = np.array(sorted(p), np.uint64)
                ca, cb = (nj._children(here, np.tile(x, (len(here), 1)), 2) if len(here) else here for x in (a, b))
                p = set(ca.ravel().tolist()) & set(cb.ravel().tolist())
            met |= bool(p)
        hits += met
    assert hits >= 0.94 * 300
