import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brightmill.llm import lang_id
from cases import awkward


def profile(text, max_n=3, top=300):
    t = " " + re.sub(r"[^\w]|[\d_]", " ", (text or "").lower()).strip() + " "
    t = re.sub(r" +", " ", t)
    c = Counter()
    for n in range(1, max_n + 1):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if g != " ":
                c[g] += 1
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:top]]


def code(g):
    out = 0
    for i, ch in enumerate(reversed(g)):
        out |= (ord(ch) + 1) << (21 * i)
    return out


def distance(doc, lang, top=300):
    rank = {g: i for i, g in enumerate(lang)}
    return sum(abs(rank[g] - i) if g in rank else top for i, g in enumerate(doc)) / (len(doc) * top)


TEXTS = {"en": "the cat sat on the mat and the dog ran after the other cat in the garden", "de": "die katze sass auf der matte und der hund lief hinter der anderen katze her", "fr": "le chat était assis sur le tapis et le chien courait après les autres"}


def test_distances_like_brute_force():
    profiles = {k: profile(v) for k, v in TEXTS.items()}
    model = lang_id.Profiles({k: [code(g) for g in v] for k, v in profiles.items()})
    texts = ["the dog and the cat", "Der Hund, die Katze!", "x", "aaaa aaaa", "été à la mer", "the cat " * 400]
    names, dist, letters = model.score(pa.array(texts))
    for t, n, d in zip(texts, names, dist):
        want = {k: distance(profile(t), p) for k, p in profiles.items()}
        best = min(want, key=lambda k: (round(want[k], 12), k))
        assert n == best and abs(d - want[best]) < 1e-9
    assert letters.all()


def test_language_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = lang_id.language_rows(docs).collect()
    assert len(rows) == docs.count()
    real = [r for r in rows if r.kept and r.declared]
    assert sum(r.lang_id == r.declared for r in real) >= 0.95 * len(real) and len(real) > 0.9 * len(rows)


def test_held_out_languages(spark, data):
    """Profiles of one half of the ids on the other, without the texts that both have."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = lang_id.train(docs.filter("doc_id % 2 = 0"))
    known = docs.filter("doc_id % 2 = 0").select("text")
    rows = lang_id.identify(docs.filter("doc_id % 2 = 1").join(known, "text", "left_anti"), model).filter("kept").collect()
    assert len(rows) > 300 and sum(r.lang_id == r.lang for r in rows) >= 0.95 * len(rows)


def test_copies_train_once_and_every_language_trains(spark):
    one, two = TEXTS["de"], TEXTS["fr"]
    rows = [(one, "mixed")] * 500 + [(two, "mixed")] + [(f"{TEXTS['en']} {'abcdefghijkl'[i]} {k}", f"l{i}") for i in range(12) for k in range(2)] * 250
    model = lang_id.train(spark.createDataFrame(rows, "text string, lang string"), per_language=20)
    assert model.names == sorted(["mixed", *(f"l{i}" for i in range(12))])
    rank = model.rank[:-1, model.names.index("mixed")]
    at = np.flatnonzero(rank >= 0)
    joined = " ".join(sorted((one, two), key=lambda t: hashlib.md5(t.encode()).hexdigest()))
    assert model.codes[at[np.argsort(rank[at])]].tolist() == [code(g) for g in profile(joined)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = lang_id.train(docs)
    out = lang_id.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_id", "distance", "kept_"]
    for r in out.collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_id, r.distance, r.kept_) == ("und", 1.0, False)
    kept = lang_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 6}
    assert lang_id.keep_identified(docs.limit(0)).count() == 0
    assert lang_id.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 7
