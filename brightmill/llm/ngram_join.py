"""N-gram Jaccard self-join of documents by the chosen-path method.

A text becomes the set of hashes of its word ``n``-grams (lower-cased words; a text of fewer than ``n`` words
is one gram). Rows with the same set are one entity from here on, so exact copies never meet each other
in a bucket. An entity's set is embedded as ``SIZE`` MinHash tokens (coordinate, value); two entities share
a token of a coordinate with probability equal to their Jaccard similarity.

One run starts with all entities in one bucket. A bucket picks ceil(1/threshold) coordinates by a hash
of its path and sends each member to one child bucket per picked token. Buckets of at most ``LIMIT`` are
compared pair by pair; larger ones are split again, up to ``DEPTH`` times, and what is large even then
(groups of copies that no split takes apart) is compared pair by pair too, in tiles of two blocks of about
``BLOCK`` members. Runs are repeated until a pair at the threshold is missed with a chance of at most 1 -
``RECALL``; that chance (``missed``) counts the splits, that all runs draw from the same tokens, and the estimate below.

Members carry the list of their buckets, so a pair that shares several is looked at in the first of them only, and
no pair is ever shuffled: a bucket passes on, for each member, the places of its partners. Pairs whose MinHash
estimate is more than ``MARGIN`` below the threshold end there; all others are verified on the full sets, which
travel to the buckets that hold pairs of theirs and are intersected all at once. What a bucket returns is one row per
member: how many links it has, and one member it is connected with.

Defined results: rows with NULL or wordless texts link to nothing, are classes of their own and are kept by
``one_per_group``; rows with a NULL ``doc_id`` count in classes and carry their class; ids may be of any orderable type; in
``similar_pairs`` copies are represented by the least id of their set (rows without one are in no pair); extra columns are
ignored by ``linked`` and ``similar_pairs`` and kept by ``one_per_group``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import add_columns, discard, fresh, small, written
from ._text import NON_WORD, Tokens, grams, mix, rebatch, segments

N = 3
THRESHOLD = 0.5
RECALL = 0.97
SIZE = 64
LIMIT, BLOCK = 256, 512
DEPTH = 3
#: How far below the threshold an estimate from SIZE tokens may lie (more than three deviations).
MARGIN = 0.2
_rng = np.random.default_rng(97)
_A = _rng.integers(0, 2**32, SIZE, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SIZE, dtype=np.uint32)


def sets(column, n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    tokens = Tokens(column, NON_WORD, lower=True)
    g = grams(tokens.hash, n)
    out = []
    for a, b in zip(tokens.first.tolist(), tokens.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(tokens.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    x = mix(s)
    return int(np.int64(x.sum(dtype=np.uint64).view(np.int64))), int(np.int64((mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)))


def signature(s: np.ndarray) -> np.ndarray:
    """The values of the SIZE MinHash tokens."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, ((x[at : at + 4096, None] ^ _B) * _A).min(0))
    return out


def branches(threshold: float) -> int:
    return math.ceil(1 / threshold)


def survival(q: float, k: int, depth: int) -> float:
    """Chance that two entities that share a fraction q of their tokens share a bucket after ``depth`` splits of one
    run into k children each."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - q * p) ** k
    return p


def least_equal(threshold: float) -> int:
    """Tokens of SIZE that a pair must share to be verified."""
    return max(0, math.floor((threshold - MARGIN) * SIZE))


def missed(threshold: float, runs: int, depth: int = DEPTH) -> float:
    """Bound of the chance to miss a pair at the threshold: the number of tokens it shares is binomial, and runs are
    independent once that number is given."""
    total = 0.0
    for a in range(SIZE + 1):
        chance = math.comb(SIZE, a) * threshold**a * (1 - threshold) ** (SIZE - a)
        total += chance * (1.0 if a < least_equal(threshold) else (1 - survival(a / SIZE, branches(threshold), depth)) ** runs)
    return total


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    runs = 1
    while missed(threshold, runs, depth) > 1 - recall:
        runs += 1
        if runs > 100:
            raise ValueError("this recall cannot be reached at this threshold")
    return runs


_RUN = np.uint64(0x7F << 56)


def _path(x: np.ndarray) -> np.ndarray:
    """56 bits of a hash; the run's number stands above them, so a pair's buckets of early runs come first."""
    return mix(x) >> np.uint64(8)


def _children(path: np.ndarray, sig: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) paths of the child buckets of members with these paths and signatures."""
    out = np.empty((len(path), k), np.uint64)
    first = mix(path ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SIZE)
    step = mix(path ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(SIZE) | np.uint64(1)
    for j in range(k):
        c = ((first + step * np.uint64(j)) % np.uint64(SIZE)).astype(np.int64)
        value = sig[np.arange(len(path)), c].astype(np.uint64)
        out[:, j] = (path & _RUN) | _path(path + mix(value * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)))
    return out


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def entities(docs: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, th (text hash), f1, f2 (set; NULL without words), size, sig."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in rebatch(batches, 1024, 4 << 20):
            found = sets(batch.column(2), n)
            prints = [fingerprint(s) if len(s) else (None, None) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([signature(s).tobytes() if len(s) else None for s in found], pa.binary())],
                names=["doc_id", "th", "f1", "f2", "size", "sig"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, th bigint, f1 bigint, f2 bigint, size int, sig binary"), "entities")


def _key(id_, th) -> Column:
    """Order of documents: NULL ids last."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("doc_id"), F.col(th).alias("th"))


def _distinct(ents: DataFrame) -> DataFrame:
    """One row per set: f1, f2, size, sig, rep (its first document), n_rows."""
    some = ents.filter("f1 is not null").groupBy("f1", "f2")
    return written(some.agg(F.first("sig").alias("sig"), F.first("size").alias("size"), F.min(_key("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("n_rows")), "distinct")


def _split(members: DataFrame, k: int, runs: int | None) -> DataFrame:
    """Members (path, f1, f2) of the child buckets; with ``runs``, from the roots of that many runs."""

    def run(batches):
        for batch in rebatch(batches, 4096):
            sig = _signatures(batch.column(batch.schema.get_field_index("sig")))
            if runs:
                paths = np.concatenate([_children(np.full(len(sig), (r << 56) | 1, np.uint64), sig, k) for r in range(runs)], 1)
            else:
                paths = _children(batch.column(batch.schema.get_field_index("path")).to_numpy().view(np.uint64), sig, k)
            row = pa.array(np.repeat(np.arange(len(sig)), paths.shape[1]))
            keys = [batch.column(batch.schema.get_field_index(c)).take(row) for c in ("f1", "f2")]
            yield pa.RecordBatch.from_arrays([pa.array(paths.ravel().view(np.int64)), *keys], names=["path", "f1", "f2"])

    return members.mapInArrow(run, "path bigint, f1 bigint, f2 bigint")


def _sized(members: DataFrame) -> DataFrame:
    """Members (a stored table) of buckets of two or more, with the bucket's size n. Sizes are counted before they are shuffled, and a
    bucket that holds much of the table may be joined in several tasks."""
    sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(sizes.hint("merge"), "path")


def _buckets(distinct: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """Members (path, f1, f2, n) of all buckets that are not split further, and the tables behind them."""
    k = branches(threshold)
    full = distinct.select("f1", "f2", "sig")
    level, leaves, tables = _split(full, k, runs_needed(threshold, recall)), [], []
    for depth in range(1, DEPTH + 1):
        members = written(level, "members")
        level = written(_sized(members), "level")
        discard(members)
        tables.append(level)
        big = level.filter(F.col("n") > LIMIT)
        if depth == DEPTH or not big.head(1):
            leaves.append(level)
            break
        leaves.append(level.filter(F.col("n") <= LIMIT))
        level = _split(big.select("path", "f1", "f2").join(full, ["f1", "f2"]), k, None)
    return reduce(DataFrame.unionByName, leaves), tables


_MEMBER = "path bigint, base bigint, side tinyint, f1 bigint, f2 bigint, size int, sketch binary, buckets binary"


def _spread(batches):
    """A row for each bucket, or tile of a large bucket, of each entity (f1, f2, size, sig, list of (path, n)).

    Members of a tile of two blocks have a side and are compared with the other side only.
    """
    for batch in rebatch(batches, 4096):
        f1, f2 = (batch.column(i).to_numpy() for i in (0, 1))
        sig = _signatures(batch.column(3))
        sketch = pa.array([r.tobytes() for r in np.ascontiguousarray(sig.view(np.uint8).reshape(-1, SIZE, 4)[:, :, 1])], pa.binary())
        lists = batch.column(4)
        each = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        base, n = each.field("path").to_numpy(), each.field("n").to_numpy()
        order = np.lexsort((base, row))
        row, base, n = row[order], base[order], n[order]
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        held = pa.array([base[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
        blocks = np.where(n > LIMIT, -(-n // BLOCK), 1)
        mine = (mix(f1.view(np.uint64) ^ mix(f2.view(np.uint64)))[row] % blocks.astype(np.uint64)).astype(np.int64)
        ends = np.cumsum(blocks)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, 16384):
            flat = np.arange(begin, min(begin + 16384, int(ends[-1])))
            e = np.searchsorted(ends, flat, "right")
            other = flat - (ends - blocks)[e]
            lo, hi = np.minimum(mine[e], other), np.maximum(mine[e], other)
            tile = _path(base[e].view(np.uint64) + mix((lo << 32 | hi).view(np.uint64) + np.uint64(1))).view(np.int64)
            side = np.where(lo == hi, -1, (mine[e] == hi).astype(np.int8)).astype(np.int8)
            r = pa.array(row[e])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(blocks[e] > 1, tile, base[e])), pa.array(base[e]), pa.array(side), *(batch.column(i).take(r) for i in (0, 1, 2)), sketch.take(r), held.take(r)], names=[c.split()[0] for c in _MEMBER.split(", ")]
            )


_MEETING = "path bigint, f1 bigint, f2 bigint, idx int, partners binary"


def _meetings(threshold: float):
    """Members of each bucket that have pairs to verify there, with the places of their later partners."""
    cut = least_equal(threshold)

    def run(batches):
        for table in segments(batches, "path", 16384):
            table = table.combine_chunks()
            path, base, side, f1, f2, size = (table[c].to_numpy() for c in ("path", "base", "side", "f1", "f2", "size"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SIZE)
            raw = table["buckets"].to_pylist()
            many = np.array([len(x) // 8 for x in raw])
            buckets = np.full((len(raw), max(1, many.max(initial=0))), -1, np.int64)
            buckets[np.arange(buckets.shape[1]) < many[:, None]] = np.frombuffer(b"".join(raw), np.int64)
            step = max(256, (1 << 22) // buckets.shape[1] ** 2)
            i, gap, first, second = np.arange(len(path)), 0, [], []
            while len(i):
                gap += 1
                i = i[i + gap < len(path)]
                i = i[path[i] == path[i + gap]]
                for at in range(0, len(i), 32768):
                    a = i[at : at + 32768]
                    b = a + gap
                    ok = ((side[a] < 0) | (side[a] != side[b])) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
                    a, b = a[ok], b[ok]
                    ok = (sketch[a] == sketch[b]).sum(1) >= cut
                    ok &= (f1[a] != f1[b]) | (f2[a] != f2[b])
                    a, b = a[ok], b[ok]
                    for k in range(0, len(a), step):
                        x, y = a[k : k + step], b[k : k + step]
                        own = buckets[x]
                        before = (own >= 0) & (own < base[x, None])  # buckets that come first
                        some = np.flatnonzero(before.any(1))
                        met = np.zeros(len(x), bool)
                        if len(some):
                            met[some] = ((own[some][:, :, None] == buckets[y[some]][:, None, :]) & before[some][:, :, None]).any((1, 2))
                        first.append(x[~met]), second.append(y[~met])
            if not first:
                continue
            a, b = np.concatenate(first), np.concatenate(second)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            start = np.searchsorted(path, path)
            rows = np.union1d(a, b)
            place = (b - start[b]).astype(np.int32)
            lo, hi = np.searchsorted(a, rows, "left").tolist(), np.searchsorted(a, rows, "right").tolist()
            partners = pa.array([place[p:q].tobytes() for p, q in zip(lo, hi)], pa.binary())
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(path[rows]), pa.array(f1[rows]), pa.array(f2[rows]), pa.array((rows - start[rows]).astype(np.int32)), partners], names=["path", "f1", "f2", "idx", "partners"])

    return run


def overlaps(found: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices over the shared elements."""
    m = len(found)
    every = np.concatenate(found)
    who = np.repeat(np.arange(m), [len(s) for s in found])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    name = np.cumsum(new) - 1
    shared = np.bincount(name)[name] > 1 if len(name) else np.zeros(0, bool)
    who, name = who[shared], name[shared]
    name = np.unique(name, return_inverse=True)[1]
    out, wide = np.zeros((m, m), np.float64), max(64, cells // max(m, 1))
    for at in range(0, int(name.max(initial=-1)) + 1, wide):
        a, b = np.searchsorted(name, [at, at + wide])
        part = np.zeros((m, min(wide, int(name[-1]) + 1 - at)), np.float32)
        part[who[a:b], name[a:b] - at] = 1
        out += part @ part.T  # sums of at most ``wide`` ones, exact in single precision
    return out.astype(np.int64)


_LINKS = "f1 bigint, f2 bigint, links bigint, r1 bigint, r2 bigint"
_PAIRS = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, jaccard double"


def _verify(threshold: float, pairs: bool):
    """Rows of _PAIRS, or of _LINKS (links of a member and a member it is connected with), from the sets in each bucket."""

    def run(batches):
        for table in segments(batches, "path", 4096, 32 << 20):
            path, f1, f2, idx = (table[c].to_numpy() for c in ("path", "f1", "f2", "idx"))
            edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            out = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(path)]):
                part = table.slice(a, b - a)
                here = {}
                for r, i in enumerate(idx[a:b].tolist()):
                    here.setdefault(i, r)  # identical rows of a document bring its set more than once
                rows = np.array(list(here.values()))
                place = np.full(max(here) + 1, -1)
                place[list(here)] = np.arange(len(rows))
                later = [np.frombuffer(x, np.int32) for x in part["partners"].take(pa.array(rows)).to_pylist()]
                x = np.repeat(np.arange(len(rows)), [len(p) for p in later])
                y = place[np.concatenate(later)]
                found = [np.frombuffer(g, np.uint64) for g in part["grams"].take(pa.array(rows)).to_pylist()]
                size = np.array([len(s) for s in found])
                common = overlaps(found)[x, y]
                jaccard = common / (size[x] + size[y] - common)
                ok = jaccard >= threshold
                x, y, jaccard = x[ok], y[ok], jaccard[ok]
                u, v = f1[a + rows], f2[a + rows]
                if pairs:
                    out.append((u[x], v[x], u[y], v[y], jaccard))
                    continue
                root = np.arange(len(rows))
                while True:
                    low = root.copy()
                    np.minimum.at(low, x, root[y])
                    np.minimum.at(low, y, root[x])
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
                links = np.bincount(x, minlength=len(rows)) + np.bincount(y, minlength=len(rows))
                some = np.flatnonzero(links)
                out.append((u[some], v[some], links[some], u[root[some]], v[root[some]]))
            if out:
                names = [c.split()[0] for c in (_PAIRS if pairs else _LINKS).split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return run


def _ship(n: int):
    """The set of each text for every bucket in its list ``needs`` (path, idx, partners)."""

    def run(batches):
        for batch in rebatch(batches, 512, 4 << 20):
            found = sets(batch.column(0), n)
            prints = [fingerprint(s) for s in found]
            u, v = (pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1))
            grams_ = pa.array([s.tobytes() for s in found], pa.binary())
            needs = batch.column(1)
            each = needs.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(needs.offsets)))
            ends = np.cumsum(np.array([len(s) for s in found])[row] * 8 + 64)
            at = 0
            while at < len(row):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (16 << 20), "right")))
                r = pa.array(row[at:upto])
                part = each.slice(at, upto - at)
                yield pa.RecordBatch.from_arrays([part.field("path"), u.take(r), v.take(r), part.field("idx"), part.field("partners"), grams_.take(r)], names=["path", "f1", "f2", "idx", "partners", "grams"])
                at = upto

    return run


def _verified(docs: DataFrame, distinct: DataFrame, threshold: float, recall: float, n: int, pairs: bool) -> DataFrame:
    """All linked pairs (_PAIRS), or the links and connections of their members (_LINKS; a row per bucket)."""
    leaves, tables = _buckets(distinct, threshold, recall)
    by = leaves.groupBy("f1", "f2").agg(F.collect_list(F.struct("path", "n")).alias("at"))
    members = by.join(distinct.select("f1", "f2", "size", "sig"), ["f1", "f2"]).select("f1", "f2", "size", "sig", "at")
    meetings = members.mapInArrow(_spread, _MEMBER).repartition("path").sortWithinPartitions("path", "f1", "f2").mapInArrow(_meetings(threshold), _MEETING)
    needed = meetings.groupBy("f1", "f2").agg(F.collect_list(F.struct("path", "idx", "partners")).alias("needs")).join(distinct.select("f1", "f2", "rep"), ["f1", "f2"])
    needed = written(needed.select(F.col("rep.doc_id").alias("need_id"), F.col("rep.th").alias("need_th"), "needs"), "needed")
    size = needed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("needs", F.lit(0).cast("long"), lambda t, x: t + 24 + F.octet_length(x["partners"]))).alias("b")).first()
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.col("text").alias("text")).filter("text is not null")
    fetched = texts.join(small(needed, size.n * 40 + (size.b or 0), 1), (F.col("th") == F.col("need_th")) & F.col("id").eqNullSafe(F.col("need_id"))).select("text", "needs")
    shipped = fetched.mapInArrow(_ship(n), _MEETING + ", grams binary").repartition("path").sortWithinPartitions("path")
    out = written(shipped.mapInArrow(_verify(threshold, pairs), _PAIRS if pairs else _LINKS), "pairs" if pairs else "links")
    discard(*tables, needed)
    return out


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """Pairs of different texts at or above the threshold: id_a < id_b, jaccard. Each set stands for all its copies and
    is named by its least id; the pairs of a large group are many, so ``linked`` is what scales."""
    distinct = _distinct(entities(docs, n))
    pairs = _verified(docs, distinct, threshold, recall, n, pairs=True)
    name = lambda *c: distinct.select(F.col("f1").alias(c[0]), F.col("f2").alias(c[1]), F.col("rep.doc_id").alias(c[2])).filter(F.col(c[2]).isNotNull())
    named = pairs.join(name("a1", "a2", "x"), ["a1", "a2"]).join(name("b1", "b2", "y"), ["b1", "b2"]).filter("x <> y")
    return named.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of edges (u, v): label is the component's least node.

    Labels spread along edges and jump to their labels' labels until nothing changes.
    """
    edges = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        step = step.alias("s").join(labels.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("node", F.least("label", "top").alias("label"), "old")
        new = written(step, "labels")
        discard(labels)
        labels = new
        if not labels.filter("label <> old").head(1):
            break
    discard(edges)
    return labels.select("node", "label")


def classes(docs: DataFrame, ents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """Sets of classes of more than one row: f1, f2, links (different sets it is linked to), best (the class's first
    document, as in ``_key``). Sets connected by links are one class."""
    distinct = _distinct(ents)
    found = _verified(docs, distinct, threshold, recall, n, pairs=False)
    node = lambda a, b: F.struct(F.col(a).alias("f1"), F.col(b).alias("f2"))
    groups = components(found.filter("f1 <> r1 or f2 <> r2").select(node("f1", "f2").alias("u"), node("r1", "r2").alias("v")))
    links = found.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    rows = distinct.select("f1", "f2", "rep", "n_rows").join(groups.select("node.f1", "node.f2", "label"), ["f1", "f2"], "left").filter("label is not null or n_rows > 1").join(links, ["f1", "f2"], "left")
    rows = written(rows, "classed")
    best = written(rows.filter("label is not null").groupBy("label").agg(F.min("rep").alias("first")), "best")
    out = rows.join(small(best, best.count(), 96), "label", "left")
    out = written(out.select("f1", "f2", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "rep").alias("best")), "classes")
    discard(found, distinct, rows, best)
    return out


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of the documents it is connected with by links or as a
    copy), links (how many different texts are at or above the threshold)."""
    ents = entities(docs, n)
    found = classes(docs, ents, threshold, recall, n)
    own = ents.select("doc_id", "f1", "f2")
    out = own.join(small(found, found.count(), 64), ["f1", "f2"], "left")
    return out.select("doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def one_per_group(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """``docs`` with one row of each group of near duplicates (connected pairs): the one with the least
    doc_id (NULLs last), then text hash; of rows with one id and text one stays."""
    ents = entities(docs, n)
    found = classes(docs, ents, threshold, recall, n)
    rows = ents.select("doc_id", "th", "f1", "f2").join(small(found, found.count(), 64), ["f1", "f2"])
    rows = rows.groupBy("doc_id", "th", (_key("doc_id", "th") == F.col("best")).alias("keeps")).agg(F.count(F.lit(1)).alias("c"))
    keyed, (th,) = add_columns(docs, text_hash=F.xxhash64("text"))
    id_, th_ = fresh(keyed, "id_", "th_")
    rows = written(rows.filter("not keeps or c > 1").select(F.col("doc_id").alias(id_), F.col("th").alias(th_), "keeps"), "decided")
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(th_))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    dropped, repeated = rows.filter("not keeps").select(id_, th_), rows.filter("keeps").select(id_, th_)
    out = keyed.join(small(dropped, dropped.count(), 32), on, "left_anti")
    again = repeated.count()
    if again:
        once = out.join(small(repeated, again, 32), on, "left_semi").dropDuplicates(["doc_id", th])
        out = out.join(small(repeated, again, 32), on, "left_anti").select(columns).union(once.select(columns))
    return out.select(columns)
