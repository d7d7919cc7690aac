"""Scratch tables: results written once and read by many plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints; one of this machine only where the master is
    local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="trackmill-"))
        path = context.getCheckpointDir().get()
    return path.rstrip("/")


def kept(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write a table (to ``path``, or to a fresh scratch folder) and read it back."""
    path = path or f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str):
    """Arrow's file system of a path (local, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))
