"""What the jobs share: settings from a file, their command line, reading what may not be there yet."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tesserae.session import session


def settings_from(spark: SparkSession, path: str | None, kind: type):
    """``kind`` (a dataclass) from a JSON file, read by Spark as any store's; what the file leaves out has its default,
    what ``kind`` doesn't know is an error."""
    if path is None:
        return kind()
    row = spark.read.option("multiLine", True).json(path).head()
    given = {k: v for k, v in row.asDict(recursive=True).items() if v is not None} if row else {}
    if unknown := given.keys() - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings in {path}: {sorted(unknown)}")
    return kind(**given)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table at ``path``, without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(name: str, about: str | None, kind: type, paths: Sequence[str], work: Callable, argv: Sequence[str] | None = None) -> None:
    """The command line: ``paths`` by name, and ``--config``. Only here a session starts and ends."""
    parser = argparse.ArgumentParser(prog=name, description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help="path, of any store that Spark reads")
    parser.add_argument("--config", help="JSON file with settings")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(name)
    try:
        config = settings_from(spark, given.pop("config"), kind)
        work(spark, *(given[p] for p in paths), config)
    finally:
        spark.stop()
