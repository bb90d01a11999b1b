"""Incremental ingest as a stream: the checkpoint remembers the files, the state the identifiers seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_papers(spark: SparkSession, path: str, schema: str, key: str = "paper_id", files_each: int | None = None) -> DataFrame:
    """Rows of JSON-lines files as they arrive, each key once."""
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.json(path).dropDuplicates([key])


def run_available(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is there and stops. ``write`` gets each batch and its number; writing a batch again under the same
    number must change nothing (a folder per batch, overwritten, will do)."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def to_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A ``write`` that is safe to repeat."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
