"""Size-checked joins and column-name helpers used by the corpus operators, over the stored tables of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch, stored

__all__ = ["BROADCAST_BYTES", "add_columns", "discard", "fresh", "scratch", "small", "written"]

#: Rows of the batches that Spark hands to Python, where the session has Spark's default of 10,000: so many long texts
#: would take much memory beside the heap.
BATCH_ROWS = 2048
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most bytes (estimated) that a join may broadcast; larger sides are shuffled.
BROADCAST_BYTES = 48 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored in the shared folder and read back. Lowers the session's Arrow batches to BATCH_ROWS."""
    if df.sparkSession.conf.get(_SETTING, "10000") == "10000":
        df.sparkSession.conf.set(_SETTING, str(BATCH_ROWS))
    return stored(df, label)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its counted ``rows`` stay below BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash (in any letter case) with the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(df: DataFrame, **exprs) -> tuple[DataFrame, list[str]]:
    """``df`` with computed columns under unused names, and those names."""
    names = fresh(df, *exprs)
    return df.withColumns(dict(zip(names, exprs.values()))), names
