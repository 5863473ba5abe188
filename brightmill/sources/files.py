"""Source files as rows: project, path, rel, content (bytes); and who may read which."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.findings import excluded
from ..session import scratch


#: Largest file that is read; more does not fit a value.
MAX_BYTES = (1 << 31) - 1024
_ROWS = "project string, path string, rel string, content binary"


def list_tree(spark: SparkSession, root: str | Path, project: str = "") -> DataFrame:
    """All files of a directory tree (project, path, rel), or one file (whose rel is ``.``), hidden ones too. The two upper
    levels are listed by the driver, what lies below by tasks; the folder must be visible to all of them."""
    root = Path(root).resolve()
    if root.is_file():
        return spark.createDataFrame([(project, str(root), ".")], _ROWS.rpartition(",")[0])
    upper = [y for x in root.iterdir() for y in (x.iterdir() if x.is_dir() and not x.is_symlink() else [x])]
    cut = len(str(root).rstrip("/")) + 1

    def walk(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                found = [top] if os.path.isfile(top) else []
                for folder, _, names in os.walk(top) if not os.path.islink(top) else ():
                    found += [f"{folder}/{n}" for n in names if os.path.isfile(f"{folder}/{n}")]
                    if len(found) >= 10_000:
                        yield rows(found)
                        found = []
                yield rows(found)

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([project] * len(found), pa.string()), pa.array(found, pa.string()), pa.array([f[cut:] for f in found], pa.string())], names=["project", "path", "rel"])

    tops = spark.createDataFrame([(str(x),) for x in sorted(upper)], "path string")
    return tops.repartition(max(1, min(len(upper), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(walk, "project string, path string, rel string")


def with_content(files: DataFrame, batch_bytes: int = 32 << 20) -> DataFrame:
    """Listed files with their bytes; what cannot be read or exceeds MAX_BYTES has none. Filter by path before."""

    def read(batches):
        for batch in batches:
            held, size, begin = [], 0, 0
            for n, path in enumerate(batch.column(1).to_pylist()):
                try:
                    content = Path(path).read_bytes() if os.path.getsize(path) <= MAX_BYTES else None
                except OSError:
                    content = None
                held.append(content)
                size += len(content or b"")
                if size >= batch_bytes or n == batch.num_rows - 1:
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=["project", "path", "rel", "content"])
                    held, size, begin = [], 0, n + 1

    return files.select("project", "path", "rel").mapInArrow(read, _ROWS)


def is_code(path: Column) -> Column:
    """Whether a path is that of a Python, TypeScript or JavaScript file."""
    return path.rlike(r"\.(?:py|" + "|".join(R.TS_SUFFIXES) + ")$")


def read_tree(spark: SparkSession, root: str | Path, project: str = "") -> DataFrame:
    """Files of a tree with the contents of Python, TypeScript and JavaScript files; no others are read."""
    files = list_tree(spark, root, project)
    return with_content(files.filter(is_code(F.col("path")))).unionByName(files.filter(~is_code(F.col("path"))).withColumn("content", F.lit(None).cast("binary")))


def upload_tree(spark: SparkSession, root: str | Path, project: str = "", batch_bytes: int = 64 << 20) -> DataFrame:
    """Like ``read_tree`` for a folder of the driver's machine, which executors cannot see: its files are written to
    the shared folder as rows, in batches of bounded size."""
    root = Path(root).resolve()
    folder, held, size = scratch(spark, "tree"), [], 0

    def flush():
        nonlocal held, size
        spark.createDataFrame(held, _ROWS).write.mode("append").parquet(folder)
        held, size = [], 0

    for p in sorted(x for x in root.rglob("*") if x.is_file() and not x.is_symlink()):
        code = p.suffix.removeprefix(".") in ("py", *R.TS_SUFFIXES) and p.stat().st_size <= MAX_BYTES
        held.append((project, str(p), str(p.relative_to(root)), bytearray(p.read_bytes()) if code else None))
        size += p.stat().st_size if code else 0
        if size >= batch_bytes or len(held) >= 10_000:
            flush()
    flush()
    return spark.read.schema(_ROWS).parquet(folder)


def read_table(files: DataFrame, project: str = "project", path: str = "path", content: str = "content") -> DataFrame:
    """Files that are rows already: many projects at once. Contents may be text or bytes."""
    return files.select(F.col(project).cast("string").alias("project"), F.col(path).alias("path"), F.col(path).alias("rel"), F.col(content).cast("binary").alias("content"))


def _name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _is_test(path: Column) -> Column:
    return _name(path).startswith("test_") | _name(path).endswith("_test.py")


def is_python(path: Column) -> Column:
    return path.endswith(".py")


def scanned(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Python files that the capability detectors and the graph read."""
    return is_python(path) & ~excluded(path, [*R.SCAN_SKIPS, *more]) & ~_is_test(path)


def searched(path: Column) -> Column:
    """Python files that are searched for entry points."""
    return is_python(path) & ~excluded(path, R.ENTRY_SKIPS) & ~_is_test(path)


def is_script(path: Column) -> Column:
    """TypeScript and JavaScript files that are searched for entry points."""
    name = _name(path)
    typed = F.lit(False)
    for s in R.TS_SUFFIXES:
        typed = typed | path.endswith("." + s)
    declared = name.rlike(r"\.d\.[cm]?ts$")
    return typed & ~declared & ~name.rlike(r"\.(test|spec)\.") & ~name.rlike(r"\.min\.[cm]?js") & ~excluded(path, R.TS_SKIPS)
