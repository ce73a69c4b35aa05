"""Scratch paths in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine that names none gets a temporary one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quern-"))
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder with its file system, removed when the driver's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(p)
    return system.makeQualified(p).toString()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the scratch folder, and a reader of it: what several jobs read, or a lineage that is cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
