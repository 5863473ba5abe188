"""Exact top-k inner-product search by distributed histogram selection.

A stated set of rows are queries, and each is compared with every row. Vectors are packed into slabs, rows of a table in
the shared folder of at most ``SLAB_BYTES`` each; the queries of a slab form blocks of at most ``QUERIES``. A task
holds one slab and reads the query blocks one after the other from the shared folder, so its memory is bounded by a
slab, a block and a part of their scores, and no vectors are shuffled or broadcast. Round by round each slab counts, for
every query that is still open, its scores into a histogram of the query's current interval; the histograms are added
up over all slabs as they stream in, and the interval shrinks to the bin that holds the kth best score (it reaches below
that bin, never above, where the bin has fewer units than an interval has bins). When no more than ``slack`` scores
lie from an interval's lower edge up (or its bins are one unit wide) the edge is the query's cut. A last
pass keeps the scores at or above the cut (of one slab the first k by score and id, as no others can be
among the best), and the best ``k`` are ranked, ties by id.

Scores are sums of products in double precision, rounded to whole multiples of 1e-9, so equal vectors tie
exactly and each pass sees the same integers. What is shuffled per round is one compact histogram
per query and slab.

Defined results: NULL vectors, empty ones, vectors with a NULL or non-finite element and rows with a NULL id take no part;
a query is compared with the vectors of its own size; a row is never its own neighbour, but other rows with its id
are (each row is a query of its own); fewer than k other rows give fewer neighbours; very long vectors only make slabs of
fewer rows; ids may be of any orderable type; an empty table, or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, written
from ._text import rebatch

K = 10
SLAB_BYTES = 32 << 20
#: Most queries of a block, vectors and queries that are scored at once.
QUERIES, BLOCK, STEP = 1024, 2048, 256
BITS = 8
UNIT = 1e9
_LOWEST = -(1 << 62)


def _slabs(vectors: DataFrame, key: str, vector: str, queries: Column | None, slab_bytes: int) -> DataFrame | None:
    """The stored slabs: slab, d (vector size), ids (sorted), m (their vectors), q (which are queries), norm (largest)."""
    spark = vectors.sparkSession
    ask = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    v = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), ask.alias("q")).filter("id is not null and v is not null")
    single = v.schema["v"].dataType.elementType.simpleString() == "float"
    v = v.withColumn("v", F.col("v").cast("array<float>" if single else "array<double>"))
    v = v.filter(F.size("v") > 0).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("cells")).first()
    if not size.n:
        return None
    width = 4 if single else 8
    parts = max(-(-size.cells * width // slab_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-size.n // 512)))
    kind = v.schema["id"].dataType

    def pack(batches):
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 24

        def slab(d: int):
            nonlocal number
            t = pa.Table.from_batches(held.pop(d)[0]).combine_chunks()
            t = t.take(pc.sort_indices(t["id"]))
            m = np.asarray(t["v"].combine_chunks().flatten()).reshape(-1, d)
            number += 1
            norm = float(np.sqrt((m.astype(float) ** 2).sum(1).max()))
            ids = t["id"].combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([d], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.tobytes()], pa.binary()), pa.array([np.asarray(t["q"]).tobytes()], pa.binary()), pa.array([norm])],
                names=["slab", "d", "ids", "m", "q", "norm"],
            )

        for batch in rebatch(batches, 4096, slab_bytes // 4):
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for d in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == d)) if (sizes != d).any() else batch
                parts_, n = held.setdefault(d, ([], 0))
                parts_.append(own)
                held[d] = parts_, n + own.num_rows
                if (n + own.num_rows) * d * width >= slab_bytes:
                    yield slab(d)
        for d in list(held):
            yield slab(d)

    rows = v.repartition(int(parts)).mapInArrow(pack, f"slab bigint, d int, ids array<{kind.simpleString()}>, m binary, q binary, norm double")
    return written(rows, "slabs")


def _matrix(row, d: int, single: bool) -> np.ndarray:
    return np.frombuffer(row, np.float32 if single else np.float64).reshape(-1, d)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounded scores as integers."""
    s = q @ x.T
    s *= UNIT
    return np.rint(s, out=s).astype(np.int64)


def _reader(folder: str, columns: list[str], condition=None):
    """Rows of a table in the shared folder, one by one."""
    system, root = pafs.FileSystem.from_uri(folder)
    files = ds.dataset(root, filesystem=system, format="parquet", exclude_invalid_files=False)
    for batch in files.to_batches(columns=columns, filter=condition, batch_size=1, batch_readahead=0, fragment_readahead=0):
        yield from batch.to_pylist() if "ids" not in columns else ({c: batch.column(c)[i] if c == "ids" else batch.column(c)[i].as_py() for c in columns} for i in range(batch.num_rows))


def top_k(vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None, bits: int = BITS, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The k best neighbours of every row for which ``queries`` holds (all rows by default): query_id, neighbor_id, rank
    (from 1), score."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, neighbor_id {kind}, rank int, score double"
    slabs = _slabs(vectors, key, vector, queries, slab_bytes)
    if slabs is None:
        return spark.createDataFrame([], schema)
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    slack, bins, step, block, most = 4 * k, 1 << bits, STEP, BLOCK, QUERIES
    norm = slabs.agg(F.max("norm")).first()[0]
    reach = int(norm * norm * UNIT) + 2
    widest = max(0, (2 * reach).bit_length() - bits)
    state = f"qb bigint, slab bigint, d int, ids array<{kind}>, m binary, pos binary, low binary, shift binary, above binary, done binary, open boolean"
    names = [c.split()[0] for c in state.split(", ")]

    def first(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                d, number = batch.column(1)[r].as_py(), batch.column(0)[r].as_py()
                ids, m = batch.column(2)[r].values, _matrix(batch.column(3)[r].as_py(), d, single)
                chosen = np.flatnonzero(np.frombuffer(batch.column(4)[r].as_py(), bool))
                for at in range(0, len(chosen), most):
                    pos = chosen[at : at + most]
                    n = len(pos)
                    begin = (np.full(n, -reach, np.int64), np.full(n, widest, np.int64), np.zeros(n, np.int64), np.zeros(n, bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(number << 16) + at // most], pa.int64()), pa.array([number], pa.int64()), pa.array([d], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.take(pa.array(pos)))]
                        + [pa.array([x.tobytes()], pa.binary()) for x in (m[pos], pos.astype(np.int32), *begin)] + [pa.array([True])], names=names,
                    )

    limits = written(slabs.select("slab", "d", "ids", "m", "q").mapInArrow(first, state), "limits")

    def against(batches, folder: str, columns: list[str], condition):
        """Every slab with every query block of its vector size: slab number, ids, vectors, block."""
        for batch in batches:
            for r in range(batch.num_rows):
                number, d = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                ids, x = batch.column(2)[r].values, _matrix(batch.column(3)[r].as_py(), d, single)
                for q in _reader(folder, columns, condition & (ds.field("d") == d)):
                    yield number, ids, x, q

    def counting(folder: str):
        def count(batches):
            for number, _, x, row in against(batches, folder, ["qb", "slab", "d", "m", "pos", "low", "shift", "done"], ds.field("open")):
                low, shift = (np.frombuffer(row[c], np.int64) for c in ("low", "shift"))
                open_ = np.flatnonzero(~np.frombuffer(row["done"], bool))
                q, pos = _matrix(row["m"], row["d"], single).astype(float), np.frombuffer(row["pos"], np.int32)
                h = np.zeros(len(low) * bins, np.int64)
                for begin in range(0, len(x), block):
                    part = x[begin : begin + block].astype(float)
                    for at in range(0, len(open_), step):
                        i = open_[at : at + step]
                        s = _scores(q[i], part)
                        s -= low[i, None]
                        s >>= shift[i, None]
                        if row["slab"] == number:
                            own = np.flatnonzero((pos[i] >= begin) & (pos[i] < begin + len(part)))
                            s[own, pos[i][own] - begin] = -1
                        inside = np.flatnonzero(s.view(np.uint64) < bins)  # below the interval wraps round
                        s += (i * bins)[:, None]
                        h += np.bincount(s.ravel()[inside], minlength=len(h))
                some = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array([row["qb"]], pa.int64()), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([h[some].astype(np.int32).tobytes()], pa.binary())], names=["qb", "i", "c"])

        return count

    def moved(row: dict, h: np.ndarray) -> dict:
        """The state after a round, from the histograms of all slabs."""
        low, shift, above, done = (np.frombuffer(row[c], t) for c, t in (("low", np.int64), ("shift", np.int64), ("above", np.int64), ("done", bool)))
        n = len(low)
        h = h.reshape(n, bins)
        tail = h[:, ::-1].cumsum(1)[:, ::-1] + above[:, None]  # scores from each bin's lower edge up
        enough = tail >= k
        few = ~enough.any(1)
        j = np.where(few, 0, bins - 1 - enough[:, ::-1].argmax(1))
        rows = np.arange(n)
        beyond = np.where(j + 1 < bins, tail[rows, np.minimum(j + 1, bins - 1)], above)
        finished = few | (tail[rows, j] <= slack) | (shift == 0)
        finer = np.maximum(shift - bits, 0)
        inner = low + ((j + 1) << shift) - (bins << finer)  # ends where the bin ends, as the scores from there up are in ``above``
        low, above = np.where(done, low, np.where(finished, low + (j << shift), inner)), np.where(done, above, beyond)
        shift, done = np.where(done | finished, shift, finer), done | finished
        return row | {"low": low.tobytes(), "shift": shift.tobytes(), "above": above.tobytes(), "done": done.tobytes(), "open": not bool(done.all())}

    def refine(batches):
        """Rows sorted by block: its state first, then its histograms, which are added up one by one."""
        row = h = None

        def out():
            new = moved(row, h)
            ids = new["ids"]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids.values)], pa.int32()), ids.values) if c == "ids" else pa.array([new[c]], kinds[c]) for c in names], names=names)

        kinds = {"qb": pa.int64(), "slab": pa.int64(), "d": pa.int32(), "open": pa.bool_()} | {c: pa.binary() for c in ("m", "pos", "low", "shift", "above", "done")}
        for batch in batches:
            index = {c: batch.column(batch.schema.get_field_index(c)) for c in [*names, "i", "c"]}
            for r in range(batch.num_rows):
                if index["i"][r].is_valid:
                    h[np.frombuffer(index["i"][r].as_py(), np.int32)] += np.frombuffer(index["c"][r].as_py(), np.int32)
                    continue
                if row is not None:
                    yield out()
                row = {c: index[c][r] if c == "ids" else index[c][r].as_py() for c in names}
                h = np.zeros(len(row["done"]) * bins, np.int64)
        if row is not None:
            yield out()

    while limits.filter("open").head(1):
        counts = slabs.select("slab", "d", "ids", "m").mapInArrow(counting(limits._stored_at), "qb bigint, i binary, c binary")
        both = limits.filter("open").unionByName(counts, allowMissingColumns=True).repartition("qb").sortWithinPartitions("qb", F.col("i").isNotNull())
        new = written(both.mapInArrow(refine, state).unionByName(limits.filter("not open")), "limits")
        discard(limits)
        limits = new

    last = limits._stored_at
    found = f"qb bigint, q int, query_id {kind}, neighbor_id {kind}, s bigint"

    def keep(batches):
        for number, ids, x, row in against(batches, last, ["qb", "slab", "d", "ids", "m", "pos", "low"], ds.field("qb") >= 0):
            q, pos, low, own_ids = _matrix(row["m"], row["d"], single).astype(float), np.frombuffer(row["pos"], np.int32), np.frombuffer(row["low"], np.int64), row["ids"].values
            held = []
            for begin in range(0, len(x), block):
                part = x[begin : begin + block].astype(float)
                for at in range(0, len(q), step):
                    s = _scores(q[at : at + step], part)
                    if row["slab"] == number:
                        own = np.flatnonzero((pos[at : at + step] >= begin) & (pos[at : at + step] < begin + len(part)))
                        s[own, pos[at : at + step][own] - begin] = _LOWEST
                    r, c = np.nonzero((s >= low[at : at + step, None]) & (s > _LOWEST))
                    v = s[r, c]
                    held.append(_best(r + at, c + begin, v, k))
            r, c, v = _best(*(np.concatenate(z) for z in zip(*held)), k)
            yield pa.RecordBatch.from_arrays([pa.array([row["qb"]] * len(r), pa.int64()), pa.array(r.astype(np.int32)), own_ids.take(pa.array(r)), ids.take(pa.array(c)), pa.array(v)], names=["qb", "q", "query_id", "neighbor_id", "s"])

    best = slabs.select("slab", "d", "ids", "m").mapInArrow(keep, found)
    rank = F.row_number().over(Window.partitionBy("qb", "q").orderBy(F.desc("s"), "neighbor_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", (F.col("s") / UNIT).alias("score"))


def _best(r: np.ndarray, c: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (row, place, score) of each row; places are in order of id."""
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    new = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    place = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
    return r[place < k], c[place < k], v[place < k]


#: The registered query asks for every row whose id is divisible by this.
EVERY = 20


def search(vectors: DataFrame) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by EVERY, among all rows."""
    return top_k(vectors, queries=F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.i, a.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(round_even(list_inner_product(a.e, b.e) * 1e9, 0) AS BIGINT) AS s
      FROM v a JOIN v b ON a.i <> b.i AND len(a.e) = len(b.e) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, neighbor_id) AS n FROM s)
SELECT query_id, neighbor_id, CAST(n AS INTEGER) AS rank, s / 1e9 AS score FROM r WHERE n <= {K}
"""
