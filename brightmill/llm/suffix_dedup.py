"""Exact repeated-passage detection with a suffix order built column by column.

A text is a sequence of blank-separated tokens. A window is ``min_tokens`` consecutive tokens; it repeats when
the same window stands elsewhere in the corpus (another document, or another place of the same one). Of
the copies of a window the one with the least (doc_id, text hash, position) is the first; NULL ids last.

1. Windows are grouped by their minimizer (the least hash of a 10-gram inside). Neighbouring windows with
   one minimizer form a piece; equal windows always fall under equal minimizers, so minimizers seen in one piece only cannot
   repeat and are dropped. They are counted before they are shuffled, so a minimizer of boilerplate gathers in no task.
   Two pieces are one if their minimizers and their 64-bit hashes agree (128 bits that depend on all tokens); a piece that is
   the only one of its minimizer repeats as a whole, and has no partner to be compared with.
2. The other distinct pieces, one copy each, form document collections. Where a minimizer has more than ``COLLECTION`` of
   them, they are cut again by further minimizers (other hash functions), as many as halvings are needed, and equal windows
   still meet. For each collection the suffix order is built by column-wise insertion (BCR):
   in round j the suffix of length j of every piece is inserted, i.e. one symbol per piece goes into the collection's
   Burrows-Wheeler transform at the place its last-to-first mapping gives, and the common prefixes with the new
   neighbours follow from range minima of the previous round's. Symbols stand in one external file per column; transform,
   common prefixes and suffix names in external files of the shared folder that each round reads and writes
   sequentially, in blocks of ``BLOCK`` entries. Ranks and minima are carried from block to block.
3. Suffixes joined by common prefixes of at least ``min_tokens`` are copies of one window; they are read off the files
   in blocks, too.

A task holds a block, and a few numbers per piece and per different token of a collection; suffixes and symbols are on
disk. A collection has about ``COLLECTION`` pieces, more only if so many share all their minimizers. Texts are
read twice and not shuffled, unless the list of pieces to fetch exceeds the broadcast limit.

Defined results: NULL, empty and shorter than ``min_tokens`` texts have no windows; identical rows (same id
and text) count as one document; NULL ids take part; ids may be of any orderable type; an empty table gives no rows;
extra columns are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import add_columns, discard, fresh, scratch, small, written
from ._text import Tokens, U, _tables, grams, mix, rebatch, windows_min

MIN_TOKENS = 50
GRAM = 10
COLLECTION = 4096
#: Longest piece, in windows.
PIECE = 48
#: Entries of the external files that are held at once.
BLOCK = 1 << 20


# ---- column-wise construction ----------------------------------------------------------------------------


class Files:
    """Numpy columns as files of one folder, written and read as sequential streams of blocks. A new version of a column
    goes to a file of its own and the old one is deleted, so short-lived versions need not reach the disk."""

    def __init__(self, folder: str):
        self.system, root = pafs.FileSystem.from_uri(folder)
        self.root = f"{root}/{uuid.uuid4().hex}"
        self.system.create_dir(self.root, recursive=True)
        self.version: dict[str, int] = {}
        self.streams: dict[str, object] = {}

    def append(self, name: str, values: np.ndarray) -> None:
        """Add to the next version of a column."""
        if name not in self.streams:
            self.streams[name] = self.system.open_output_stream(f"{self.root}/{name}-{self.version.get(name, 0) + 1}")
        self.streams[name].write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")

    def turn(self, *names: str) -> None:
        """Finish the next version of columns; it replaces the one before."""
        for name in names:
            self.streams.pop(name).close()
            n = self.version.get(name, 0)
            self.version[name] = n + 1
            if n:
                self.system.delete_file(f"{self.root}/{name}-{n}")

    def blocks(self, name: str, kind, block: int):
        with self.system.open_input_stream(f"{self.root}/{name}-{self.version[name]}") as f:
            while raw := f.read(block * np.dtype(kind).itemsize):
                yield np.frombuffer(raw, kind)

    def read(self, name: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *self.blocks(name, kind, BLOCK)])

    def close(self) -> None:
        for f in self.streams.values():
            f.close()
        self.system.delete_dir(self.root)


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo..hi], both ends included."""
    size = 64
    blocks = -(-len(x) // size)
    grid = np.full(blocks * size, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(blocks, size)
    head = np.minimum.accumulate(grid, 1)
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1]
    bl, bh = lo // size, hi // size
    out = np.empty(len(lo), x.dtype)
    inside = np.flatnonzero(bl == bh)
    for at in range(0, len(inside), 8192):
        q = inside[at : at + 8192]
        cells = grid[bl[q]]
        place = np.arange(size)
        out[q] = np.where((place >= (lo[q] % size)[:, None]) & (place <= (hi[q] % size)[:, None]), cells, np.iinfo(x.dtype).max).min(1)
    q = np.flatnonzero(bl != bh)
    if len(q):
        value = np.minimum(tail.reshape(-1)[lo[q]] if tail.flags.c_contiguous else tail[bl[q], lo[q] % size], head[bh[q], hi[q] % size])
        span = bh[q] - bl[q] - 1
        table, width = head[:, -1], 1
        level = np.where(span > 0, np.floor(np.log2(np.maximum(span, 1))).astype(np.int64), -1)
        for k in range(int(level.max()) + 1):
            now = np.flatnonzero(level == k)
            if len(now):
                a = bl[q][now] + 1
                b = bh[q][now] - width
                value[now] = np.minimum(value[now], np.minimum(table[a], table[b]))
            if len(table) > width:
                table = np.minimum(table[:-width], table[width:])
            width *= 2
        out[q] = value
    return out


def put_columns(files: Files, symbols: np.ndarray, length: np.ndarray, width: int) -> None:
    """Append the symbols of more sequences, one file per column: column j holds the symbol before the suffix of length j
    of each sequence, 0 where it has none."""
    ends = np.cumsum(length)
    for j in range(width):
        files.append(f"column{j}", np.where(length > j, symbols[np.maximum(ends - 1 - j, 0)] if len(symbols) else 0, 0).astype(symbols.dtype))


def _carried(files: Files, at: np.ndarray, sym: np.ndarray, n_symbols: int, name, count, block: int):
    """(symbol, rank among the places of that symbol, common prefix with the place before it, index in ``at`` or -1) of
    the places ``at`` of the last round's suffixes, and of the places of the same symbol right after them."""
    wanted = np.zeros(n_symbols + 1, bool)
    wanted[sym] = True
    seen, last_new = np.zeros(n_symbols + 1, np.int64), np.zeros(n_symbols + 1, bool)
    most = np.iinfo(count).max
    since = np.full(n_symbols + 1, most, count)  # least common prefix after a symbol's last place
    out, begin = [], 0
    for bwt, lcp in zip(files.blocks("bwt", name, block), files.blocks("lcp", count, block)):
        place = np.flatnonzero(wanted[bwt])
        s = bwt[place]
        order = np.argsort(s, kind="stable")
        s, place = s[order].astype(np.int64), place[order]
        new = np.full(len(bwt), -1)
        q0, q1 = np.searchsorted(at, [begin, begin + len(bwt)])
        new[at[q0:q1] - begin] = np.arange(q0, q1)
        which = new[place]
        head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        group = np.diff(np.append(first, len(s)))
        rank = seen[s] + np.arange(len(s)) - np.repeat(first, group)
        before_new = np.concatenate([[False], which[:-1] >= 0]) if len(s) else np.zeros(0, bool)
        before_new[first] = last_new[s[first]]
        touch = np.flatnonzero((which >= 0) | before_new)
        value = np.zeros(len(touch), count)
        inner = np.flatnonzero(~head[touch])
        if len(inner):
            k = touch[inner]
            value[inner] = 1 + range_min(lcp, place[k - 1] + 1, place[k])
        outer = np.flatnonzero(head[touch] & (seen[s[touch]] > 0))
        if len(outer):
            k = touch[outer]
            value[outer] = 1 + np.minimum(since[s[k]], np.minimum.accumulate(lcp)[place[k]])
        out.append((s[touch], rank[touch], value, which[touch]))
        np.minimum(since, lcp.min(), out=since)
        final = first + group - 1
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], most).astype(count)
        since[s[final]] = after[place[final] + 1]
        last_new[s[final]] = which[final] >= 0
        seen[s[first]] += group
        begin += len(bwt)
    return (np.concatenate(x) for x in zip(*out))


def suffix_order(files: Files, m: int, width: int, n_symbols: int, block: int = BLOCK) -> tuple[np.dtype, np.dtype]:
    """Order all suffixes of m sequences of at most ``width`` symbols in 1..n_symbols, whose columns are in ``files``:
    leaves the files ``own`` (sequence), ``size`` (suffix length) and ``lcp`` (common prefix with the one before).

    Every sequence ends in a symbol of its own, smaller than all others. Returns the types of own, and of size and lcp.
    """
    # the narrowest types that hold the values, as all of this is written again each round
    name, who, count = (np.min_scalar_type(int(x)) for x in (n_symbols, max(m - 1, 0), width + 1))

    def column(j: int) -> np.ndarray:
        return files.read(f"column{j}", name) if j < width else np.zeros(m, name)

    sym = column(0)
    for file, values in (("own", np.arange(m, dtype=who)), ("size", np.zeros(m, count)), ("bwt", sym), ("lcp", np.zeros(m, count))):
        files.append(file, values)
    files.turn("own", "size", "bwt", "lcp")
    total = np.bincount(sym, minlength=n_symbols + 1)
    total[0] = 0
    at = np.flatnonzero(sym)
    sym, seq = sym[at].astype(np.int64), at
    for j in range(1, width + 1):
        s, rank, value, which = _carried(files, at, sym, n_symbols, name, count, block)
        # a suffix stands behind the m empty ones, those of smaller symbols and those of its symbol that come first
        index = m + (np.cumsum(total) - total)[s] + rank
        order = np.argsort(index)
        index, value, which = index[order], value[order], which[order]
        fresh_ = which >= 0
        into, seq = index[fresh_], seq[which[fresh_]]
        next_ = column(j)[seq]
        again, new_value = index[~fresh_], value[~fresh_]
        before = into - np.arange(len(into))  # entries of the old files that come before
        more = {"own": seq.astype(who), "size": np.full(len(into), j, count), "bwt": next_.astype(name), "lcp": value[fresh_]}
        for file, kind in (("own", who), ("size", count), ("bwt", name), ("lcp", count)):
            begin = done = out_at = 0
            for x in files.blocks(file, kind, block):
                upto = int(np.searchsorted(before, begin + len(x), "left"))
                y = np.insert(x, before[done:upto] - begin, more[file][done:upto])
                if file == "lcp":
                    u0, u1 = np.searchsorted(again, [out_at, out_at + len(y)])
                    y[again[u0:u1] - out_at] = new_value[u0:u1]
                files.append(file, y)
                begin, done, out_at = begin + len(x), upto, out_at + len(y)
            files.append(file, more[file][done:])  # what comes after all entries
        files.turn("own", "size", "bwt", "lcp")
        total += np.bincount(next_, minlength=n_symbols + 1)
        total[0] = 0
        some = np.flatnonzero(next_)
        at, sym, seq = into[some], next_[some].astype(np.int64), seq[some]
        if not len(at):
            break
    return who, count


# ---- pieces --------------------------------------------------------------------------------------------------


def pieces(tokens: Tokens, min_tokens: int = MIN_TOKENS, gram: int = GRAM):
    """Arrays of all pieces: document, minimizer, piece hash, start (token in the document), windows, and
    whether the minimizer stands at several places in it."""
    empty = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    h = tokens.hash
    gram = min(gram, min_tokens)
    g = grams(h, gram)
    w = min_tokens - gram + 1
    if len(g) < w:
        return empty
    least = windows_min(g, w)
    counts = tokens.counts()
    doc = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    valid = np.arange(len(least)) + min_tokens <= tokens.first[doc + 1]
    edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])]))
    n = np.diff(np.append(edge, len(least)))
    ok = valid[edge]
    start, n = edge[ok], n[ok]
    if not len(start):
        return empty
    m = least[start]
    inner = np.concatenate([[0], np.cumsum(g[: len(least)] == least)])
    times = inner[start + n] - inner[start]
    for at in range(0, len(start), 8192):
        e = (start[at : at + 8192] + n[at : at + 8192])[:, None] + np.arange(w - 1)
        times[at : at + 8192] += (g[np.minimum(e, len(g) - 1)] == m[at : at + 8192, None]).sum(1)
    several = times > 1
    if n.max() > PIECE:
        parts = -(-n // PIECE)
        row = np.repeat(np.arange(len(n)), parts)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, n, m, several = start[row] + inner * PIECE, np.minimum(PIECE, n[row] - inner * PIECE), m[row], several[row]
    powers, inverse = _tables(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])])
    end = start + n + min_tokens - 1
    piece = mix((sums[end] - sums[start]) * inverse[start] + n.astype(np.uint64))
    d = doc[start]
    return d, m, piece, start - tokens.first[d], n, several


def recut(h: np.ndarray, m: np.ndarray, begin: np.ndarray, n: np.ndarray, cuts: np.ndarray, min_tokens: int, gram: int = GRAM):
    """Pieces (places in ``h`` and windows) cut by ``cuts`` further minimizers each: index of the piece, key, first window in
    it, and windows of every part. Without cuts a piece is one part, with its minimizer as the key."""
    plain = np.flatnonzero(cuts == 0)
    parts = [(plain, m[plain], np.zeros(len(plain), np.int64), n[plain].astype(np.int64))]
    gram = min(gram, min_tokens)
    for i in np.flatnonzero(cuts).tolist():
        g = grams(h[begin[i] : begin[i] + n[i] + min_tokens - 1], gram)
        key = np.full(n[i], m[i])
        for c in range(cuts[i]):
            key = mix(key + windows_min(mix(g ^ U(0x2545F4914F6CDD1D + 2 * c)), min_tokens - gram + 1))
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        parts.append((np.full(len(edge), i), key[edge], edge, np.diff(np.append(edge, n[i]))))
    return (np.concatenate(x) for x in zip(*parts))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"), F.col("start").alias("start"))


_SEQ = "key bigint, m bigint, piece bigint, skip int, copies bigint, id {0}, th bigint, start int, tokens binary"
_RUN = "m bigint, piece bigint, at int, n int, f_none boolean, f_id {0}, f_th bigint, f_start int"


class Collection:
    """Pieces of one collection: their tokens go to external files as they come, a few numbers of each stay."""

    def __init__(self, folder: str):
        self.files, self.rows, self.n, self.width, self.last = Files(folder), [], 0, 0, None
        self.known = np.zeros(0, np.uint64)

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows sorted by (key, m, piece, skip); of equal ones (identical rows of documents) the first counts."""
        name = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
        new = np.concatenate([[self.last is None or (name[0] != self.last).any()], (name[1:] != name[:-1]).any(1)])
        self.last = name[-1]
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            return
        raw = [np.frombuffer(x, np.uint64) for x in batch.column(8).to_pylist()]
        length = np.array([len(x) for x in raw])
        self.known = np.union1d(self.known, np.concatenate(raw))
        self.files.append("text", np.concatenate(raw))
        self.rows.append((batch.select(["m", "piece", "skip", "copies", "id", "th", "start"]), length))
        self.n += batch.num_rows
        self.width = max(self.width, int(length.max()))

    def runs(self, min_tokens: int, block: int):
        """Repeated windows, as runs of (piece, offset) with their first copy."""
        files = self.files
        try:
            files.turn("text")
            name = np.min_scalar_type(len(self.known))
            source, held = files.blocks("text", np.uint64, block), np.zeros(0, np.uint64)
            for _, length in self.rows:  # tokens get small names and are turned into columns, batch by batch
                while len(held) < length.sum():
                    held = np.concatenate([held, next(source)])
                put_columns(files, (np.searchsorted(self.known, held[: length.sum()]) + 1).astype(name), length, self.width)
                held = held[length.sum() :]
            files.turn(*(f"column{j}" for j in range(self.width)))
            who, count = suffix_order(files, self.n, self.width, len(self.known), block)
            table = pa.Table.from_batches([b for b, _ in self.rows])
            yield from _classes(table, np.concatenate([x for _, x in self.rows]), files, who, count, min_tokens, block)
        finally:
            files.close()


def _rank(ids: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the ids; NULLs come last."""
    ids = ids.combine_chunks()
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy()
    place = {v: n for n, v in enumerate(sorted({v for v in ids.to_pylist() if v is not None}))}
    return np.array([place[v] if v is not None else len(place) for v in ids.to_pylist()], np.int64)


def _classes(table: pa.Table, length: np.ndarray, files: Files, who, count, min_tokens: int, block: int):
    """Runs of repeated windows, read off the ordered suffixes in blocks of whole classes of equal windows."""
    copies, th, start, skip = (table[c].to_numpy() for c in ("copies", "th", "start", "skip"))
    ident = _rank(table["id"])
    kept = [np.zeros(0, np.int64)] * 3
    blocks = zip(files.blocks("own", who, block), files.blocks("size", count, block), files.blocks("lcp", count, block))
    for seq, size, lcp in _with_end(blocks):
        if seq is not None:
            kept = [np.concatenate([a, b.astype(np.int64)]) for a, b in zip(kept, (seq, size, lcp))]
            cut = np.flatnonzero(kept[2] < min_tokens)
            if not len(cut) or cut[-1] == 0:
                continue
            done, kept = [x[: cut[-1]] for x in kept], [x[cut[-1] :] for x in kept]
        else:
            done = kept
        cls = np.cumsum(done[2] < min_tokens)
        pick = done[1] >= min_tokens
        seq, cls = done[0][pick], cls[pick]
        at = length[seq] - done[1][pick]
        order = np.lexsort((start[seq] + at, th[seq], ident[seq], cls))
        seq, cls, at = seq[order], cls[order], at[order]
        if not len(seq):
            continue
        head = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        group = np.diff(np.append(head, len(cls)))
        again = np.repeat(np.add.reduceat(copies[seq], head) > 1, group)
        lead = np.repeat(head, group)
        seq, at, f_seq, f_at = seq[again], at[again], seq[lead][again], at[lead][again]
        if not len(seq):
            continue
        order = np.lexsort((at, seq))
        seq, at, f_seq, f_at = (x[order] for x in (seq, at, f_seq, f_at))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(seq) != 0) | (np.diff(at) != 1) | (np.diff(f_seq) != 0) | (np.diff(f_at) != 1)]))
        n = np.diff(np.append(new, len(seq)))
        at = at[new] + skip[seq[new]]
        s, f = pa.array(seq[new]), pa.array(f_seq[new])
        first = table.select(["id", "th", "start"]).take(f).combine_chunks()
        ids = first["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [table["m"].combine_chunks().take(s), table["piece"].combine_chunks().take(s), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), ids.is_null(), ids, first["th"].combine_chunks(), pa.array((first["start"].to_numpy() + f_at[new]).astype(np.int32))],
            names=["m", "piece", "at", "n", "f_none", "f_id", "f_th", "f_start"],
        )


def _with_end(blocks):
    yield from blocks
    yield None, None, None


def repeated_windows(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Runs of repeated windows: doc_id, th (text hash), start, n (windows), is_first."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("text")).filter("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in rebatch(batches, 2048, 3 << 20):
            d, m, piece, start, n, several = pieces(Tokens(batch.column(2)), min_tokens)
            if len(d):
                row = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(piece.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(several)],
                    names=["m", "piece", "doc_id", "th", "start", "n", "several"],
                )

    every = written(texts.mapInArrow(cut, f"m bigint, piece bigint, doc_id {kind}, th bigint, start int, n int, several boolean"), "pieces")
    often = written(every.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("several").alias("s")).filter("c > 1 or s").select("m"), "often")
    found = every.join(small(often, often.count(), 16), "m").dropDuplicates(["m", "piece", "doc_id", "th", "start"])  # identical rows count once
    found = written(found.select("m", "piece", "doc_id", "th", "start", "n", "several"), "found")
    discard(every, often)
    distinct = found.groupBy("m", "piece").agg(F.min(_first()).alias("o"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("several").alias("several"))
    distinct = written(distinct, "distinct")
    shared = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("pieces"), F.max("several").alias("s"))
    distinct_ = distinct.join(shared.hint("merge"), "m")
    whole = distinct_.filter("pieces = 1 and not s and copies > 1")
    cuts = F.greatest(F.lit(0), F.ceil(F.log2(F.col("pieces") / F.lit(COLLECTION)))).cast("int")
    lists = distinct_.filter("pieces > 1 or s").groupBy(F.col("o.id").alias("w_id"), F.col("o.th").alias("w_th")).agg(F.collect_list(F.struct("m", "piece", "copies", F.col("o.start").alias("start"), "n", cuts.alias("cuts"))).alias("w"))
    lists = written(lists, "wanted")
    size = lists.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("w")).alias("n")).first()
    fetched = texts.join(small(lists, (size.n or 0) * 56 + size.docs * 32, 1), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("doc_id", "th", "text", "w")

    def ship(batches):
        for batch in rebatch(batches, 512, 3 << 20):
            tokens = Tokens(batch.column(2))
            w = batch.column(3)
            x = w.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(w.offsets)))
            m, start, n, cuts = (x.field(c).to_numpy() for c in ("m", "start", "n", "cuts"))
            begin = tokens.first[row] + start
            part, key, skip, length = recut(tokens.hash, m.view(np.uint64), begin, n, cuts, min_tokens)
            begin = begin[part] + skip
            out = [tokens.hash[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + length + min_tokens - 1).tolist())]
            row, part_ = pa.array(row[part]), pa.array(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *(x.field(c).take(part_) for c in ("m", "piece")), pa.array(skip.astype(np.int32)), x.field("copies").take(part_), batch.column(0).take(row), batch.column(1).take(row), pa.array((start[part] + skip).astype(np.int32)), pa.array(out, pa.binary())],
                names=["key", "m", "piece", "skip", "copies", "id", "th", "start", "tokens"],
            )

    folder, most, block = scratch(spark, "suffixes"), COLLECTION, BLOCK

    def build(batches):
        """Collections of whole keys, from rows sorted by (key, m, piece, skip)."""
        held, last = None, None
        for batch in rebatch(batches, 1024):
            if not batch.num_rows:
                continue
            m = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[last is None or m[0] != last], m[1:] != m[:-1]]))
            last, at = m[-1], 0
            for e in edge.tolist():
                if held is not None and held.n + e - at >= most:
                    if e > at:
                        held.add(batch.slice(at, e - at))
                    yield from held.runs(min_tokens, block)
                    held, at = None, e
            held = held or Collection(folder)
            held.add(batch.slice(at))
        if held is not None:
            yield from held.runs(min_tokens, block)

    ordered = written(fetched.mapInArrow(ship, _SEQ.format(kind)).repartition("key").sortWithinPartitions("key", "m", "piece", "skip").mapInArrow(build, _RUN.format(kind)), "ordered")
    plain = whole.select("m", "piece", F.lit(0).alias("at"), "n", F.col("o.none").alias("f_none"), F.col("o.id").alias("f_id"), F.col("o.th").alias("f_th"), F.col("o.start").alias("f_start"))
    runs = written(ordered.unionByName(plain), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")) & (F.col("start") == F.col("f_start"))
    # a piece may stand in very many documents: its rows are joined where they are, or in several tasks
    some = found.select("m", "piece", "doc_id", "th", F.col("start").alias("begin")).join(small(runs, runs.count(), 72), ["m", "piece"]).withColumn("start", F.col("begin") + F.col("at"))
    out = written(some.select("doc_id", "th", "start", "n", same.alias("is_first")), "windows")
    discard(found, distinct, lists, ordered, runs)
    return out


def _spans(windows: DataFrame, min_tokens: int) -> DataFrame:
    """Maximal runs of neighbouring repeated windows that are all first, or all not: doc_id, th,
    start_token, n_tokens, is_first."""
    w = Window.partitionBy("doc_id", "th", "is_first").orderBy("start")
    runs = windows.withColumn("fresh", F.coalesce((F.col("start") != F.lag(F.col("start") + F.col("n")).over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "th", "is_first", "island").agg(F.min("start").alias("start_token"), (F.sum("n") + F.lit(min_tokens - 1)).cast("int").alias("n_tokens")).drop("island")


def repeats(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Every maximal repeated passage of every document: doc_id, start_token, n_tokens, is_first.

    Passages of first copies and of later copies are listed separately (is_first).
    """
    return _spans(repeated_windows(docs, min_tokens), min_tokens).select("doc_id", "start_token", "n_tokens", "is_first")


def without_repeats(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` without later copies of repeated passages.

    A token goes when it lies in a later copy of a window and in no first copy of one, so each distinct window
    survives in its first place. ``n_chars``, if there is such a column, is counted again in changed rows, and
    rows that lose all their tokens go.
    """
    spans = _spans(repeated_windows(docs, min_tokens), min_tokens)
    by = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start_token", "n_tokens", "is_first")).alias("s"), F.min("is_first").alias("all_first")).filter("not all_first")
    keyed, (th,) = add_columns(docs, text_hash=F.xxhash64("text"))
    id_, th_, list_name = fresh(keyed, "s_id", "s_th", "spans_")
    by = written(by.select(F.col("doc_id").alias(id_), F.col("th").alias(th_), F.col("s").alias(list_name)), "spans")
    size = by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(list_name)).alias("s")).first()
    side = small(by, size.n * 48 + (size.s or 0) * 24, 1)
    joined = keyed.join(side, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(th_)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], list_name)
    names = docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for batch in rebatch(batches, 1024, 4 << 20):
            lists = batch.column(len(names))
            hit = np.flatnonzero(np.asarray(lists.is_valid()))
            columns = list(batch.columns[: len(names)])
            if len(hit):
                texts = columns[text_at].to_pylist()
                part = columns[text_at].take(pa.array(hit))
                tokens = Tokens(part, hashed=False)
                keep = np.ones(batch.num_rows, bool)
                chars = columns[chars_at].to_pylist() if chars_at is not None else None
                for i, r in enumerate(hit.tolist()):
                    a, b = tokens.first[i], tokens.first[i + 1]
                    later, first = np.zeros(b - a + 1, np.int32), np.zeros(b - a + 1, np.int32)
                    for s in lists[r].as_py():
                        mark = first if s["is_first"] else later
                        mark[s["start_token"]] += 1
                        mark[s["start_token"] + s["n_tokens"]] -= 1
                    stay = (np.cumsum(later)[:-1] == 0) | (np.cumsum(first)[:-1] > 0)
                    if stay.all():
                        continue
                    keep[r] = stay.any()
                    base = tokens.offsets[i]
                    raw = tokens.data[base : tokens.offsets[i + 1]].tobytes()
                    start = np.append(tokens.start[a:b] - base, len(raw))
                    start[0] = 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], stay.view(np.int8), [0]])))
                    texts[r] = b"".join(raw[start[x] : start[y]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())).decode()
                    if not stay[-1]:
                        texts[r] = texts[r].rstrip()
                    if chars is not None:
                        chars[r] = len(texts[r])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars is not None:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)


SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS t
           FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - {MIN_TOKENS} + 2), lambda i: md5(array_to_string(t[i:i + {MIN_TOKENS} - 1], ' ')))) AS g,
             unnest(range(0, len(t) - {MIN_TOKENS} + 1)) AS s FROM w WHERE len(t) >= {MIN_TOKENS}),
c AS (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, s) = 1 AS is_first FROM g),
i AS (SELECT doc_id, s, is_first, s - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY s) AS island FROM c WHERE n > 1)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_token, CAST(count(*) + {MIN_TOKENS} - 1 AS INTEGER) AS n_tokens, is_first
FROM i GROUP BY doc_id, is_first, island
"""
