"""Runs that take up where an earlier one ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scratch import written


def new_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, one for each key."""
    return rows.join(known.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def pending(todo: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What a resumed run still has to do; all of it with ``force``."""
    return todo if force else todo.join(done.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with the same key."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.select(*base.columns))


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in ``buckets`` folders by hash of the key, for ``upsert_into``."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert_into(path: str, changes: DataFrame, key: str, buckets: int) -> int:
    """``upsert`` of a table that ``write_bucketed`` wrote: only the buckets of changed keys are read and written again, the
    files of all others stay. The number of such buckets. What is written is read from the old files, so it goes to a folder
    of its own first."""
    spark = changes.sparkSession
    placed = changes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    base = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = written(upsert(base, placed.select(*base.columns), key))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def flagged(parsed: DataFrame) -> DataFrame:
    """Papers whose diagnostics ask for the other parser."""
    return parsed.where(F.coalesce("diagnostics.needs_fallback_parser", F.lit(False)))


def last_by_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """A lookup table: of repeated keys the last row counts."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), pos).alias("r")).select("r.*")


def select_run(rows: DataFrame, key: str, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The rows that a run is asked for. ``limit=0`` is an error, not 'no limit'."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive; leave it out for no limit")
    rows = rows.where(F.col(key).isin(only)) if only else rows
    return rows.orderBy(key).limit(limit) if limit else rows


def in_batches(todo: DataFrame, key: str, process, size: int, stop=lambda result: False) -> list:
    """Processes rows in batches of about ``size`` by hash of the key, one job each, until ``stop`` says so: finished
    batches stay finished. ``todo`` is computed once, and each batch reads its own rows alone."""
    n = max(1, -(-todo.count() // size))
    if n == 1:
        return [process(todo)]
    dealt = written(todo.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition("_batch"), "_batch")
    results = []
    for i in range(n):
        results.append(process(dealt.where(F.col("_batch") == i).drop("_batch")))
        if stop(results[-1]):
            break
    return results
