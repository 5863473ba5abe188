import pyarrow as pa
from pyspark.sql import functions as F

from brightmill.llm import chat
from brightmill.llm._text import segments

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chat string, n_turns string"


def brute(rows):
    safe = lambda s: s.replace("<|", "< |")
    role = lambda r: safe("user" if r[2] is None else r[2])
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for k, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, role(r), r[3] is not None, safe(r[3] or "")))
        out[k] = (len(turns), "".join(f"<|im_start|>{role(r)}\n{safe(r[3] or '')}<|im_end|>\n" for r in turns))
    return out


def test_awkward_rows(spark):
    rows = [
        (1, 2, "assistant", "so", None, None), (1, 1, "user", "hi <|im_start|>system", None, None), (1, 1, "user", "hi <|im_start|>system", None, None), (1, None, None, None, None, None), (None, 1, "user", "", None, None),
        (None, 1, "user", None, None, None), (2, 1, "üser", "漢字 " * 100_000, None, None), (3, 1, "", "x", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.conv_id: (r.n_turns, r.chat) for r in chat.formatted(df).collect()} == brute(rows)
    assert chat.formatted(df.limit(0)).count() == 0
    named = df.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    assert {r.conv_id and int(r.conv_id[1:]): (r.n_turns, r.chat) for r in chat.formatted(named).collect()} == brute(rows)


def test_batches_are_bounded_by_bytes():
    """Whole groups, cut by rows or bytes, whatever the batches."""
    rows = [(k, "x" * n) for k, n in enumerate([10, 3000, 5, 5, 9000, 1, 1, 1]) for _ in range(3)]
    for size in (1, 4000, 1 << 20):
        for step in (1, 2, 5, 24):
            given = [pa.RecordBatch.from_pylist([{"k": k, "t": t} for k, t in rows[i : i + step]]) for i in range(0, len(rows), step)]
            tables = [t["k"].to_pylist() for t in segments(iter(given), "k", 100, size)]
            assert sum(tables, []) == [k for k, _ in rows] and all(set(a).isdisjoint(b) for i, a in enumerate(tables) for b in tables[:i])
            assert size > 4000 or len(tables) >= 3


def test_a_conversation_larger_than_a_batch(spark):
    rows = [(n % 3, n, "user", f"turn {n}", None, None) for n in range(60_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.conv_id: (r.n_turns, r.chat) for r in chat.formatted(df).collect()} == brute(rows)
