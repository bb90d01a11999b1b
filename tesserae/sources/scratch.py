"""Folders that the driver and all executors see, for what an operator has to write on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Without that setting a local master gets a temporary one; on a cluster
    executors could not see each other's files, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


def written(rows: DataFrame, *by: str) -> DataFrame:
    """``rows``, computed once: later reads, and losing an executor, don't compute them again. ``by``: columns of folders, so
    that a read of some of their values opens no others."""
    path = shared_folder(rows.sparkSession)
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
