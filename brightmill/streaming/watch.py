"""Findings of files as they land in a folder (Structured Streaming).

Every micro-batch parses its new files once and runs the detectors on them; results that need whole projects
(graph, reachability) are left to batch scans. Files are told apart by path, so a file is analysed once.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parser import parse
from ..operators import detectors, findings
from ..sources.files import is_python

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def landing(spark: SparkSession, folder: str | Path, project: str = "", per_batch: int = 10_000) -> DataFrame:
    """Streaming files(project, path, rel, content) of a folder; folders that do not change are listed again for
    each batch, of at most ``per_batch`` files. Names that begin with ``_`` or ``.`` are hidden to the streaming file
    source; batch scans read them."""
    rows = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(str(folder))
    path = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(F.lit(project).alias("project"), path.alias("path"), path.alias("rel"), "content").filter(is_python(F.col("path")))


def found(files: DataFrame) -> DataFrame:
    """Findings of all built-in detectors, with ids."""
    return findings.with_ids(findings.enrich(detectors.detect(parse(files))))


def watch(files: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the findings of each micro-batch to a Parquet table; a batch that is repeated after a failure
    replaces its own folder, so nothing is counted twice."""

    def store(batch: DataFrame, number: int) -> None:
        found(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
