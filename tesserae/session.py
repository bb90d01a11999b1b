"""A session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; everything else stays with the cluster's defaults unless given."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
