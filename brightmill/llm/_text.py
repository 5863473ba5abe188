"""Vectorised tokenising and hashing over whole Arrow batches, without a Python loop per word.

Token hash: every byte value has a random 64-bit number; a token's hash is the sum of its bytes'
numbers times powers of an odd radix, taken from differences of one running sum, then mixed.
All arithmetic is modulo 2**64, so a token's hash does not depend on where in a batch it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RADIX = 0xD1342543DE82EF95 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64) | U(1)
#: Bytes that end a token.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = False
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _RADIX, np.uint64))])
        _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(_RADIX, -1, 2**64), np.uint64))])
    return _powers, _inverse


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; NULL counts as an empty text. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Tokens:
    """Tokens of a column of texts: ``start``/``end`` byte positions, ``hash``, and ``first`` with the
    index of each document's first token (one more entry than documents)."""

    def __init__(self, column, delimiters: np.ndarray = SPACES, lower: bool = False, hashed: bool = True):
        if lower:
            column = pc.utf8_lower(column)
        self.data, self.offsets = data, offsets = string_bytes(column)
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = np.empty(n + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(delimiters[data], out=word[1:-1])
        starts = word[1:-1] & ~word[:-2]
        inner = offsets[(offsets > 0) & (offsets < n)]
        starts[inner] = word[1:-1][inner]
        ends = word[1:-1] & ~word[2:]
        last = inner - 1
        ends[last] = word[1:-1][last]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            self.hash = self._hash(data, self.start, self.end)

    @staticmethod
    def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            lo = start[at]
            upto = max(at + 1, int(np.searchsorted(end, lo + step, "right")))
            hi = end[upto - 1]
            powers, inverse = _tables(int(hi - lo) + 1)
            run = np.empty(hi - lo + 1, np.uint64)
            run[0] = 0
            np.cumsum(_BYTE[data[lo:hi]] * powers[: hi - lo], out=run[1:])
            s, e = start[at:upto] - lo, end[at:upto] - lo
            out[at:upto] = mix((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = upto
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document index of every token."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive tokens from each position (len(h) - n + 1 of them, at least 0)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for i in range(1, n):
        out *= U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
        out += h[i : i + m]
    return mix(out)


def windows_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    m, span = x, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def rebatch(batches, rows: int = 4096, size: int = 24 << 20):
    """Arrow batches cut so that none has more than ``rows`` rows or (but for single rows) ``size`` bytes."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes > size:
            step = max(1, min(rows, int(batch.num_rows * size / batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def segments(batches, key: str, rows: int = 65536, size: int = 64 << 20):
    """Tables of all rows of whole key groups, from batches sorted by ``key``: each table holds one or
    more whole groups, of about ``rows`` rows or ``size`` bytes; more only if one group has more."""
    held, n, held_bytes = [], 0, 0
    for batch in rebatch(batches, rows, size):
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
        if n < rows and held_bytes < size:
            continue
        last = batch.column(batch.schema.get_field_index(key))
        final = last[batch.num_rows - 1]
        same = pc.equal(last, final) if final.is_valid else pc.is_null(last)
        begin = int(pc.index(same, True).as_py())
        if begin == 0 and not _ends_before(held, key, final):
            continue
        rest = batch.slice(begin)
        held[-1] = batch.slice(0, begin)
        yield pa.Table.from_batches(held)
        held, n, held_bytes = [rest], rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _ends_before(held, key: str, final) -> bool:
    """Whether the group of the last batch begins with it."""
    if len(held) < 2:
        return False
    before = held[-2].column(held[-2].schema.get_field_index(key))
    return not before[len(before) - 1].equals(final)
