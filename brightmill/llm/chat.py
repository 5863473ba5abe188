"""Chat formatting: whole conversations assembled into one text each, column-wise.

Every turn becomes header + content + footer of the chat template. For a batch of turns the lengths of
all these segments, their running offsets and the scatter indices of every byte are computed in numpy;
headers and contents are then copied into one preallocated buffer that becomes the Arrow column. No
Python loop runs over turns or characters.

Turns are ordered by turn, then role, then content (NULL first). Conversations are brought together by one
shuffle on conv_id and sorted within partitions (Spark spills); a batch never splits a conversation.

Defined results: a NULL role reads ``user``; a NULL content is empty; control markers of the template inside roles
or contents are broken by a space (``<|`` becomes ``< |``) so that no content can open a turn; NULL turns
sort first; repeated rows and equal turns are all kept; turns with a NULL conv_id form one conversation
with a NULL id; conv_id may be of any orderable type; a batch has about 64 MB or one conversation, which may have 2 GB, as any
value in Spark; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import segments, string_bytes

BEGIN, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"


def scatter(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], total: int, step: int = 1 << 22) -> np.ndarray:
    """One buffer of ``total`` bytes from (source bytes, source starts, lengths, target starts) segments."""
    out = np.empty(total, np.uint8)
    for source, start, length, target in parts:
        if not len(length):
            continue
        ends = np.cumsum(length)
        at = 0
        while at < len(length):  # pieces of bounded index size
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            n = length[at:upto]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(target[at:upto], n) + inner] = source[np.repeat(start[at:upto], n) + inner]
            at = upto
    return out


def assemble(new: np.ndarray, role: pa.Array, content: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts of conversations (a new one starts where ``new`` is true), and their numbers of turns."""
    n = len(new)
    rb, ro = string_bytes(role)
    cb, co = string_bytes(content)
    rl, cl = np.diff(ro), np.diff(co)
    fixed = [np.frombuffer(x, np.uint8) for x in (BEGIN, MIDDLE, END)]
    lengths = np.stack([np.full(n, len(BEGIN)), rl, np.full(n, len(MIDDLE)), cl, np.full(n, len(END))], 1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    zero = np.zeros(n, np.int64)
    parts = [
        (fixed[0], zero, lengths[:, 0], starts[:, 0]), (rb, ro[:-1], rl, starts[:, 1]), (fixed[1], zero, lengths[:, 2], starts[:, 2]),
        (cb, co[:-1], cl, starts[:, 3]), (fixed[2], zero, lengths[:, 4], starts[:, 4]),
    ]
    total = int(ends[-1, -1]) if n else 0
    buffer = scatter(parts, total)
    first = np.flatnonzero(new)
    offsets = np.append(starts[first, 0], total).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buffer))
    return text, np.diff(np.append(first, n)).astype(np.int32)


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, chat."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", "turn", safe(F.coalesce(F.col("role").cast("string"), F.lit("user"))).alias("role"), F.col("text").cast("string").alias("raw"))
    rows = rows.select("conv_id", "turn", "role", safe(F.coalesce("raw", F.lit(""))).alias("text"), F.col("raw").isNotNull().alias("given"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "given", "text").drop("given", "turn")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for table in segments(batches, "conv_id", 16384):
            table = table.combine_chunks()
            key = table["conv_id"].combine_chunks()
            valid = np.asarray(key.is_valid())
            other = np.asarray(pc.fill_null(pc.not_equal(key[1:], key[:-1]), False))
            new = np.concatenate([[True], other | (valid[1:] != valid[:-1])])
            text, n = assemble(new, table["role"], table["text"])
            out = pa.RecordBatch.from_arrays([key.take(pa.array(np.flatnonzero(new))), pa.array(n), text], names=["conv_id", "n_turns", "chat"])
            for part in [out] if out.nbytes < 1 << 30 else [out.slice(i, 1) for i in range(out.num_rows)]:
                yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(2).cast(pa.string())], names=part.schema.names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns int, chat string")


SQL = """
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'user'), '<|', '< |') AS role,
                  replace(coalesce(text, ''), '<|', '< |') AS text, text IS NOT NULL AS given FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, given, text) AS chat
FROM t GROUP BY conv_id
"""
