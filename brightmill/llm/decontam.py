"""Benchmark decontamination by greedy string tiling.

Texts become tokens: lower-cased runs of letters, digits and underscores. Documents and benchmark
items are joined on shared seeds (``min_match`` consecutive tokens). For every pair whose seeds could
cover enough of the item, tiles are placed greedily: the longest run of tokens common to both that
overlaps no tile is marked, again and again, until none of ``min_match`` tokens is left. Runs are found
by running Karp-Rabin: rolling hashes of the free windows, for a search length that restarts higher
when a much longer match shows up and halves down to ``min_match``. Among runs of equal length the one
first in the item, then first in the document, is marked. The pair is a leak when tiles cover at least
``threshold`` of the item's tokens; order plays no part, so reordered passages count.

A benchmark whose measured size is below the broadcast limit goes to every task, and documents are read
once without a shuffle. Of a larger one every task gets a bitmap of its seeds, of a fixed size, and only the seeds of documents
that hit it are shuffled and joined; the results are the same. A task's memory is bounded: matching positions of very
long or repetitive texts are worked through in pieces of ``PAIRS``.

Defined results: NULL or empty documents have no leak; NULL, empty and shorter than ``min_match``
items never match; a NULL ``doc_id`` or ``item_id`` is carried as NULL; repeated rows each give their
own rows; extra columns are ignored in ``leaks`` and kept in ``drop_leaks``. Either side may be empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, add_columns, fresh, written
from ._text import NON_WORD, Tokens, _tables, grams, rebatch

MIN_MATCH = 4
THRESHOLD = 0.5
_BITS = 22
#: Bits of the bitmap of a large benchmark's seeds.
BITMAP_BITS = 27
#: Pairs of equal positions that are held at once.
PAIRS = 1 << 21


class _Rolling:
    """Karp-Rabin hashes of every window of a token sequence, for any window length."""

    def __init__(self, h: np.ndarray):
        self.powers, self.inverse = _tables(len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)])])

    def windows(self, s: int) -> np.ndarray:
        return (self.sums[s:] - self.sums[:-s]) * self.inverse[: len(self.sums) - s]


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(marked)])
    return c[s:] == c[:-s]


def tile(item: np.ndarray, text: np.ndarray, least: int, start: int = 32) -> list[tuple[int, int, int]]:
    """Tiles (length, item position, text position) of two token-hash sequences, in marking order."""
    if min(len(item), len(text)) < least:
        return []
    roll_i, roll_t = _Rolling(item), _Rolling(text)
    used_i, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []

    def scan(s: int) -> list[tuple[int, int, int]]:
        if s > min(len(item), len(text)):
            return []
        at_i, at_t = np.flatnonzero(_free(used_i, s)), np.flatnonzero(_free(used_t, s))
        wi, wt = roll_i.windows(s)[at_i], roll_t.windows(s)[at_t]
        order = np.argsort(wi, kind="stable")
        wi, at_i = wi[order], at_i[order]
        lo, hi = np.searchsorted(wi, wt, "left"), np.searchsorted(wi, wt, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        lo, n, at_t = lo[hit], n[hit], at_t[hit]
        ends = np.cumsum(n)
        runs: list[tuple[int, int, int]] = []  # length, item position, text position
        going: dict[int, int] = {}  # item position after the end of a run that reached the last piece's end: its place in runs
        begin, last = 0, -2
        while begin < len(n):
            upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            m = n[begin:upto]
            t = np.repeat(at_t[begin:upto], m)
            p = at_i[np.repeat(lo[begin:upto] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            order = np.lexsort((p, t - p))
            p, t = p[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(t) != 1)]))
            length = np.diff(np.append(first, len(p)))
            now: dict[int, int] = {}
            end = int(at_t[upto - 1])
            for k, p_, t_ in zip(length.tolist(), p[first].tolist(), t[first].tolist()):
                at = going.get(p_) if t_ == last + 1 else None
                if at is None:
                    at = len(runs)
                    runs.append((k + s - 1, p_, t_))
                else:
                    runs[at] = (runs[at][0] + k, *runs[at][1:])
                if t_ + k - 1 == end:
                    now[p_ + k] = at
            going, last, begin = now, end, upto
        out = []
        for n_, p_, t_ in runs:
            same = item[p_ : p_ + n_] == text[t_ : t_ + n_]
            if same.all():
                out.append((n_, p_, t_))
            else:
                out += _runs(same, p_, t_, s)
        return out

    s = max(least, min(start, len(item), len(text)))
    while True:
        found = scan(s)
        longest = max((x[0] for x in found), default=0)
        if longest >= 2 * s:
            s = longest
            continue
        heap = [(-n, p, t) for n, p, t in found]
        heapq.heapify(heap)
        while heap:
            n, p, t = heapq.heappop(heap)
            free = ~(used_i[p : p - n] | used_t[t : t - n])
            if free.all():
                used_i[p : p - n] = used_t[t : t - n] = True
                tiles.append((-n, p, t))
            else:
                for m, p2, t2 in _runs(free, p, t, s):
                    heapq.heappush(heap, (-m, p2, t2))
        if s == least:
            return tiles
        s = max(least, s // 2)


def _runs(flags: np.ndarray, p: int, t: int, least: int) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(b - a), p + int(a), t + int(a)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


class Index:
    """Seeds of all benchmark items."""

    def __init__(self, texts: list[str], min_match: int = MIN_MATCH, threshold: float = THRESHOLD):
        self.min_match, self.threshold = min_match, threshold
        tokens = Tokens(pa.array(texts, pa.large_string()), NON_WORD, lower=True)
        self.items = [tokens.hash[a:b] for a, b in zip(tokens.first, tokens.first[1:])]
        seeds = [grams(x, min_match) for x in self.items]
        seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
        item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in seeds)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        self.some = np.zeros(1 << _BITS, bool)
        self.some[(self.seed & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def match(self, column) -> list[tuple[int, int, float, int, int, int]]:
        """Leaks of a column of texts: (document, item, coverage, matched tokens, longest tile, tiles)."""
        if not len(self.seed):
            return []
        k = self.min_match
        tokens = Tokens(column, NON_WORD, lower=True)
        g = grams(tokens.hash, k)
        hit = np.flatnonzero(self.some[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.seed, g[hit], "left")
        n = np.searchsorted(self.seed, g[hit], "right") - lo
        doc = np.searchsorted(tokens.first, hit, "right") - 1
        inside = (n > 0) & (hit + k <= tokens.first[doc + 1])
        lo, n, doc = lo[inside], n[inside], doc[inside]
        if not len(n):
            return []
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        found = np.unique(np.stack([np.repeat(doc, n), self.item[at], self.at[at]], 1), axis=0)
        pair = np.flatnonzero(np.concatenate([[True], (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)]))
        out = []
        for a, b in zip(pair, np.append(pair[1:], len(found))):
            d, i = int(found[a, 0]), int(found[a, 1])
            where = found[a:b, 2]
            item = self.items[i]
            reach = k + int(np.minimum(np.diff(where), k).sum())  # tokens of the item that seeds could cover
            if reach < self.threshold * len(item):
                continue
            tiles = tile(item, tokens.hash[tokens.first[d] : tokens.first[d + 1]], k)
            total = sum(x[0] for x in tiles)
            if total >= self.threshold * len(item):
                out.append((d, i, total / len(item), total, max(x[0] for x in tiles), len(tiles)))
        return out


RESULT = "coverage double, matched_tokens int, longest_tile int, n_tiles int"
_KINDS = [pa.float64(), pa.int32(), pa.int32(), pa.int32()]


def _columns(found):
    return [pa.array([x[2 + i] for x in found], kind) for i, kind in enumerate(_KINDS)]


def _items(bench: DataFrame) -> tuple[DataFrame, bool]:
    items = bench.select("item_id", F.col("text").alias("text")).filter("text <> ''")
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first().b or 0
    return items, size * 16 <= BROADCAST_BYTES  # seeds, positions and hashes take about 16 times the text


def leaks(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per (document, item) whose tiles cover at least ``threshold`` of the item."""
    items, fits = _items(bench)
    docs = docs.select("doc_id", "text")
    if not fits:
        return _leaks_shuffled(docs, items, min_match, threshold).drop("th")
    rows = items.collect()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, {RESULT}"
    given = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

    def run(batches):
        ids, texts = given.value
        index, ids = Index(texts, min_match, threshold), pa.array(ids)
        for batch in rebatch(batches, 2048, 4 << 20):
            found = index.match(batch.column(1))
            if found:
                d, i = [pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(d), ids.take(i), *_columns(found)], names=["doc_id", "item_id", "coverage", "matched_tokens", "longest_tile", "n_tiles"])

    return docs.mapInArrow(run, schema)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of all seeds; the driver gets the words that are not zero, 2 ** (BITMAP_BITS - 6) at most."""
    shift = 64 - BITMAP_BITS
    place = F.shiftrightunsigned("seed", shift)
    words = seeds.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, %d) & 63 as int))" % shift)).alias("x"))
    got = words.toArrow()
    out = np.zeros(1 << max(0, BITMAP_BITS - 6), np.uint64)
    out[got["w"].to_numpy()] = got["x"].to_numpy().view(np.uint64)
    return out


def _in_bitmap(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    place = seeds >> np.uint64(64 - BITMAP_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _seeds(frame: DataFrame, keys: list[str], min_match: int, among=None) -> DataFrame:
    """Distinct seeds of each row (that hit a broadcast bitmap): the key columns, the seed, how many tokens of the text
    lie in its places, and how many tokens the text has."""
    schema = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys) + ", seed bigint, covers int, n_tokens int"

    def run(batches):
        for batch in rebatch(batches, 2048, 4 << 20):
            tokens = Tokens(batch.column(batch.schema.get_field_index("text")), NON_WORD, lower=True)
            g = grams(tokens.hash, min_match)
            if not len(g):
                continue
            doc = tokens.doc()[: len(g)]
            inside = np.flatnonzero(doc == tokens.doc()[min_match - 1 :])
            if among is not None:
                inside = inside[_in_bitmap(among.value, g[inside])]
            order = inside[np.lexsort((g[inside], doc[inside]))]  # places of a seed stay in order
            if not len(order):
                continue
            new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (g[order][1:] != g[order][:-1])])
            first = np.flatnonzero(new)
            covers = np.where(new, min_match, np.minimum(np.diff(order, prepend=0), min_match))
            covers = pa.array(np.add.reduceat(covers, first).astype(np.int32))
            row = pa.array(doc[order[first]].astype(np.int64))
            n = pa.array(tokens.counts().astype(np.int32)).take(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).take(row) for k in keys), pa.array(g[order[first]].view(np.int64)), covers, n], names=[*keys, "seed", "covers", "n_tokens"])

    return frame.select(*keys, "text").mapInArrow(run, schema)


def _leaks_shuffled(docs: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    items = items.select("item_id", F.col("text").alias("item_text"), F.xxhash64("text").alias("ih"))
    right = written(_seeds(items.select("item_id", "ih", F.col("item_text").alias("text")), ["item_id", "ih"], min_match).distinct(), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(right))
    left = _seeds(docs, ["doc_id", "th"], min_match, bits).drop("covers", "n_tokens").distinct()
    pairs = (
        left.hint("merge").join(right, "seed").groupBy("doc_id", "th", "item_id", "ih").agg(F.sum("covers").alias("n"), F.max("n_tokens").alias("size"))
        .filter(F.col("n") >= F.col("size") * threshold).select("doc_id", "th", "item_id", "ih")
    )

    def same(a, b, *cols):
        e = F.lit(True)
        for c in cols:
            e = e & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return e

    full = (
        pairs.alias("p").hint("merge").join(docs.alias("d"), same("p", "d", "doc_id", "th")).select("p.*", "d.text").alias("q")
        .join(items.alias("i"), same("q", "i", "item_id", "ih")).select("q.doc_id", "q.th", "q.item_id", "q.text", "i.item_text")
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, item_id {items.schema['item_id'].dataType.simpleString()}, {RESULT}"

    def run(batches):
        for batch in rebatch(batches, 1024, 8 << 20):
            texts, tests = Tokens(batch.column(3), NON_WORD, lower=True), Tokens(batch.column(4), NON_WORD, lower=True)
            found = []
            for r in range(batch.num_rows):
                item = tests.hash[tests.first[r] : tests.first[r + 1]]
                tiles = tile(item, texts.hash[texts.first[r] : texts.first[r + 1]], min_match)
                total = sum(x[0] for x in tiles)
                if tiles and total >= threshold * len(item):
                    found.append((r, 0, total / len(item), total, max(x[0] for x in tiles), len(tiles)))
            if found:
                row = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(row) for j in range(3)), *_columns(found)], names=["doc_id", "th", "item_id", "coverage", "matched_tokens", "longest_tile", "n_tiles"])

    return full.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    items, fits = _items(bench)
    if not fits:
        keyed, (key,) = add_columns(docs, th=F.xxhash64("text"))
        id_, th = fresh(keyed, "bad_id", "bad_th")
        bad = _leaks_shuffled(docs.select("doc_id", "text"), items, min_match, threshold).select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
        kept = keyed.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & F.col(key).eqNullSafe(F.col(th)), "left_anti")
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.sparkSession.sparkContext.broadcast([r.text for r in items.select("text").collect()])

    def run(batches):
        index = Index(given.value, min_match, threshold)
        for batch in rebatch(batches, 2048, 4 << 20):
            bad = {x[0] for x in index.match(batch.column(batch.schema.get_field_index("text")))}
            if bad:
                keep = np.ones(batch.num_rows, bool)
                keep[list(bad)] = False
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
