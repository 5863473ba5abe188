"""The stages one after the other, each against a brute-force version on what the one before kept."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_decontam import brute as tiles
from test_decontam import words
from test_ngram_join import brute as similar
from test_suffix_dedup import brute as windows

from brightmill.llm import lang_id
from cases import awkward


def stages(spark, docs, sf_dir, folder):
    out = [docs]
    for name, f in cp.STAGES:
        f(spark, out[-1], sf_dir).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_every_stage_like_brute_force(spark, data, tmp_path):
    given = spark.read.parquet(f"{data}/documents.parquet")
    docs, a, b, c, d, packed = stages(spark, given, data, tmp_path)
    for x in (a, b, c, d):
        assert x.columns == given.columns
    rejected = {r.doc_id for r in lang_id.language_rows(docs).filter("not kept").collect()}
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - rejected
    group = {r.doc_id: r.doc_id for r in a.collect()}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in similar(a.collect()):
        x, y = sorted((top(x), top(y)))
        group[y] = x
    missed = {r.doc_id for r in b.collect()} - {top(x) for x in group}
    assert {top(x) for x in group} <= {r.doc_id for r in b.collect()} and len(missed) <= 0.03 * len(group)
    later, first = windows(b.collect(), 50)
    want = {}
    for r in b.collect():
        key = ((False, r.doc_id), r.text)
        want[r.doc_id] = [w for i, w in enumerate((r.text or "").split()) if i not in later.get(key, ()) or i in first.get(key, ())]
    assert {r.doc_id: r.text.split() for r in c.collect()} == {k: v for k, v in want.items() if v}
    bench = [words(x.text) for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dropped = {r.doc_id for r in c.collect()} - {r.doc_id for r in d.collect()}
    for r in c.collect():
        w = words(r.text)
        if len(w) > 400:
            continue
        near = [i for i in bench if len({tuple(i[k : k + 4]) for k in range(len(i) - 3)} & {tuple(w[k : k + 4]) for k in range(len(w) - 3)}) * 4 >= 0.25 * len(i)]
        leak = any(sum(t[0] for t in tiles(i, w, 4)) >= 0.5 * len(i) for i in near)
        assert leak == (r.doc_id in dropped)
    n = {r.doc_id: len(r.text.split()) for r in d.collect()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").cast("int").alias("n")).collect()} == n
    assert sorted(map(str, cp.run(spark, data).collect())) == sorted(map(str, packed.collect()))


def test_awkward_rows_pass_through(spark, data, tmp_path):
    out = stages(spark, awkward(spark), data, tmp_path / "a")
    assert out[-1].count() > 0
    none = stages(spark, awkward(spark, rows=False), data, tmp_path / "b")
    assert none[-1].count() == 0
