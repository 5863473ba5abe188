"""Session helpers: stored intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether the driver runs all tasks."""
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error elsewhere, as a
    machine-local folder would be lost with its machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="brightmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends in files, and a lost executor costs a reread
    instead of a recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def sized(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges. Without a hint a plan goes by the bytes of files: facts and stored tables
    are a hundred times larger as rows (names repeat), and millions of them would be sent to the driver and to every task."""
    return df.hint("merge")


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
