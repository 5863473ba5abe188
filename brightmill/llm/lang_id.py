"""Language identification by rank-order character n-gram profiles.

A text is normalised (lower case, runs of anything but letters become one blank), its 1- to
``max_n``-grams of characters within the whole text are counted, and the ``top`` most frequent form
its ranked profile (ties: shorter first, then code point order). The out-of-place distance to a
language is the sum over the document's n-grams of the rank difference, or ``top`` where the language
profile lacks the n-gram, divided by its largest possible value, so it lies in [0, 1].

Profiles are trained on a bounded sample of the distinct texts of each label (``per_language``; all of them
where there are no more); every document is then scored over its whole text.

Defined results: NULL, empty and letterless texts have language ``und``, distance 1 and are rejected;
ties between languages go to the first in alphabetical order; repeated rows are scored alike; rows
with a NULL ``doc_id`` are scored too; NULL labels do not train. Without any labelled row there are no
profiles: every row is ``und`` with distance 1, and only letterless texts are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, fresh, written
from ._text import rebatch

MAX_N, TOP = 3, 300
#: Most distinct labelled texts per language that train a profile.
PER_LANGUAGE = 400
#: Documents farther than this from every profile are rejected.
MAX_DISTANCE = 0.75
_NOT_LETTERS = r"[^\p{L}\p{M}]+"


def _normal(texts: pa.Array) -> pa.Array:
    x = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    x = pc.utf8_trim_whitespace(pc.replace_substring_regex(x, _NOT_LETTERS, " "))
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), x, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(x, ""), x, padded)  # what has no letters has no n-grams


def _ranked(texts: pa.Array, max_n: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram as a 63-bit code, rank) of the profiles of normalised texts, by document and rank."""
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return _profiles(chars, length, 0, max_n, top)


def _profiles(chars, length, base, max_n, top):
    n_docs = len(length)
    used = np.unique(chars)
    bits = max(1, int(len(used)).bit_length())
    if n_docs > 1 and bits * max_n + int(n_docs - 1).bit_length() > 63:
        half = n_docs // 2
        cut = int(length[:half].sum())
        parts = [_profiles(chars[:cut], length[:half], base, max_n, top), _profiles(chars[cut:], length[half:], base + half, max_n, top)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    local = (np.searchsorted(used, chars) + 1).astype(np.uint64)
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), length)
    shift = np.uint64(bits)
    wide = np.uint64(bits * max_n)
    docs, codes, counts, sizes = [], [], [], []
    code = local
    space = int(np.searchsorted(used, 32)) + 1 if len(used) and 32 in used else 0
    for n in range(1, max_n + 1):
        if n > 1:
            if len(local) < n:
                break
            code = (code[: len(local) - n + 1] << shift) | local[n - 1 :]
        d = doc[: len(code)]
        keep = d == doc[n - 1 :]
        if n == 1:
            keep &= local != space
        key = np.sort((d[keep] << wide) | code[keep])
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key_u = key[first]
        docs.append((key_u >> wide).astype(np.int64))
        codes.append(key_u & np.uint64((1 << int(wide)) - 1))
        counts.append(np.diff(np.append(first, len(key))))
        sizes.append(np.full(len(first), n, np.uint64))
    if not docs:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z
    docs, codes, counts, sizes = (np.concatenate(x) for x in (docs, codes, counts, sizes))
    often = counts > 1
    few = np.bincount(docs[often], minlength=n_docs) < top
    pick = often | few[docs]  # what occurs once matters only where a profile is not full without it
    docs, codes, counts, sizes = docs[pick], codes[pick], counts[pick], sizes[pick]
    order = np.argsort(-counts, kind="stable")  # the parts are in order of (n, document, code)
    order = order[np.argsort(docs[order], kind="stable")]
    docs, codes, sizes = docs[order], codes[order], sizes[order]
    begin = np.searchsorted(docs, np.arange(n_docs))
    rank = np.arange(len(docs)) - begin[docs]
    pick = rank < top
    docs, codes, rank = docs[pick], codes[pick], rank[pick]
    mask, full = np.uint64((1 << bits) - 1), np.zeros(len(codes), np.uint64)
    table = np.concatenate([np.zeros(1, np.uint64), used.astype(np.uint64) + np.uint64(1)])
    for k in range(max_n - 1, -1, -1):
        full = (full << np.uint64(21)) | table[((codes >> np.uint64(bits * k)) & mask).astype(np.int64)]
    return docs + base, full, rank


class Profiles:
    """Ranked profiles of all languages; small (``top`` entries a language) and sent with the tasks."""

    def __init__(self, by_language: dict[str, list[int]], max_n: int = MAX_N, top: int = TOP):
        self.names, self.max_n, self.top = sorted(by_language), max_n, top
        self.codes = np.unique(np.array([c for x in by_language.values() for c in x], np.uint64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, np.array(by_language[name], np.uint64)), j] = np.arange(len(by_language[name]))

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, distance and whether there are letters, for each text."""
        docs, codes, rank = _ranked(_normal(texts), self.max_n, self.top)
        size = np.bincount(docs, minlength=len(texts))
        if not self.names:
            return ["und"] * len(texts), np.ones(len(texts)), size > 0
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0 if len(self.codes) else at[at == len(self.codes)]
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        theirs = self.rank[at]
        away = np.where(theirs < 0, self.top, np.abs(theirs - rank[:, None]))
        total = np.stack([np.bincount(docs, away[:, j], len(texts)) for j in range(len(self.names))], 1)
        best = total.argmin(1)
        distance = np.where(size > 0, total[np.arange(len(texts)), best] / np.maximum(size * self.top, 1), 1.0)
        return [self.names[b] if s else "und" for b, s in zip(best, size)], distance, size > 0


def train(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, max_n: int = MAX_N, top: int = TOP) -> Profiles:
    """Profiles from the ``per_language`` distinct texts of each label whose MD5 sums are least, or all if there are fewer;
    a profile is that of these texts one behind the other, in the order of the sums."""
    narrow = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter("text is not null and label is not null")
    hashed = narrow.withColumn("h", F.md5("text"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    last = hashed.select("label", "h").distinct().withColumn("nth", nth).filter(F.col("nth") <= per_language).groupBy("label").agg(F.max("h").alias("last"))
    last = written(last, "last")
    picked = hashed.join(F.broadcast(last) if last.count() < 10_000 else last, "label").filter("h <= last").select("label", "h", "text").distinct()

    def profile(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        texts = pa.chunked_array([pa.array([" ".join(table["text"].to_pylist())], pa.large_string())])
        _, codes, _ = _ranked(_normal(texts.combine_chunks()), max_n, top)
        return pa.table({"label": pa.array([table["label"][0].as_py()]), "codes": pa.array([[int(c) for c in codes]], pa.list_(pa.int64()))})

    rows = picked.groupBy("label").applyInArrow(profile, "label string, codes array<bigint>").collect()
    discard(last)
    return Profiles({r.label: r.codes for r in rows}, max_n, top)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``docs`` with three more columns: the language, the distance, and whether the row is kept.

    The columns are named ``lang_id``, ``distance`` and ``kept``, with underscores added where the
    input has such names already. One pass over the data, no shuffle.
    """
    names = fresh(docs, "lang_id", "distance", "kept")
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema.add(name, kind)
    given = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        model = given.value
        for batch in rebatch(batches, 1024, 1 << 20):  # n-grams take about 80 times the text
            found, distance, letters = model.score(batch.column(batch.schema.get_field_index(text)))
            kept = letters & (distance <= max_distance) if model.names else letters
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(distance), pa.array(kept)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def language_rows(docs: DataFrame) -> DataFrame:
    """Train and identify: one row per document."""
    model = train(docs)
    return identify(docs.select("doc_id", "text", F.col("lang").alias("declared")), model).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns of ``docs``."""
    out = identify(docs, train(docs))
    return out.filter(F.col(out.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, * FROM documents),
picked AS (SELECT lang, text FROM (SELECT DISTINCT lang, text FROM d WHERE lang IS NOT NULL AND text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(text)) <= {PER_LANGUAGE}),
raw AS (SELECT NULL AS i, lang, string_agg(text, ' ' ORDER BY md5(text)) AS text FROM picked GROUP BY lang UNION ALL SELECT i, NULL, text FROM d),
normal AS (SELECT i, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) AS x FROM raw),
chars AS (SELECT i, lang, unnest(string_split(' ' || x || ' ', '')) AS a, generate_subscripts(string_split(' ' || x || ' ', ''), 1) AS p FROM normal WHERE x <> ''),
three AS (SELECT i, lang, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM chars WINDOW w AS (PARTITION BY i, lang ORDER BY p)),
gram AS (SELECT i, lang, 1 AS n, a AS g FROM three WHERE a <> ' ' UNION ALL SELECT i, lang, 2, a || b FROM three WHERE b IS NOT NULL UNION ALL SELECT i, lang, 3, a || b || c FROM three WHERE c IS NOT NULL),
ranked AS (SELECT i, lang, g, row_number() OVER (PARTITION BY i, lang ORDER BY count(*) DESC, n, g) - 1 AS r FROM gram GROUP BY i, lang, n, g QUALIFY r < {TOP}),
near AS (SELECT q.i, l.lang, sum(CASE WHEN t.r IS NULL THEN {TOP} ELSE abs(t.r - q.r) END) AS total, count(*) AS size
  FROM ranked q CROSS JOIN (SELECT DISTINCT lang FROM picked) l LEFT JOIN ranked t ON t.lang = l.lang AND t.g = q.g WHERE q.i IS NOT NULL GROUP BY q.i, l.lang),
best AS (SELECT i, lang, total / CAST(size * {TOP} AS DOUBLE) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY i ORDER BY total, lang) = 1)
SELECT doc_id, d.lang AS declared, coalesce(best.lang, 'und') AS lang_id, coalesce(distance, 1.0::DOUBLE) AS distance, coalesce(distance, 1) <= {MAX_DISTANCE} AS kept FROM d LEFT JOIN best USING (i)
"""
