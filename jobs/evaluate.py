"""Compares ways to cut documents for search: which of them finds the documents that hold a question's passage?

    python -m jobs.evaluate --documents IN --questions ASKED --output OUT --config jobs/evaluate.json

Each configuration cuts the documents into windows of words (``window`` 0: whole documents), indexes them and ranks documents
by their best window. A document is right for a question if it holds the question's words in a row. Written are

- ``rankings``: the first ``depth`` documents of each question, by configuration and language of the document;
- ``scores``: hit rates, mean reciprocal rank and recall by configuration;
- ``report``: the same as CSV and Markdown, for people;
- ``index``: the lexical index of each configuration, to search with; ``whole`` is that of whole documents. Beside it stands
  what it was ``made`` of: a rerun over the same files reads the index that is there.
- ``made``: what the right documents, and each configuration's rankings and scores, were made of.

A rerun writes over what belongs to the configurations it was asked for and leaves those of others; the report tells of all.
What was made of the same files, of documents and of questions, in the same way is left as it stands.
Rows without identifier are left out; of unlike rows with one identifier the largest counts.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, stored
from jobs.ingest import NO_LANG
from tesserae.operators import evaluate as metrics
from tesserae.operators import retrieval
from tesserae.sources import catalog, files

log = logging.getLogger("jobs.evaluate")

RANKINGS = "query_id long, doc long, lang string, score double, rank int, is_right boolean, config string, part_lang string"
SCORES = "hit_at_5 double, hit_at_10 double, mrr_at_10 double, recall_at_10 double, n_queries long, n_with_gold long, config string"


@dataclass(frozen=True)
class Settings:
    #: Name, words in a window and between the starts of two; a window of 0 words is the whole document.
    configs: list[dict] = field(default_factory=lambda: [{"name": "whole", "window": 0, "step": 0}, {"name": "w650", "window": 650, "step": 560}, {"name": "w200", "window": 200, "step": 150}])
    #: Ranks that are written for each question.
    depth: int = 10


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each identifier. Texts only move where there is one twice."""
    named = rows.where(F.col(key).isNotNull())
    if named.groupBy(key).count().where("count > 1").isEmpty():
        return named
    others = [c for c in rows.columns if c != key]
    return named.groupBy(key).agg(F.max(F.struct("text", *(c for c in others if c != "text"))).alias("r")).select(key, *(F.col(f"r.{c}") for c in others))


def _stands(spark: SparkSession, path: str, mark: str) -> bool:
    return [r[0] for r in stored(spark, path, "state string").collect()] == [mark]


def _tell(spark: SparkSession, path: str, mark: str) -> None:
    """``mark``: what something was made of, once all of it is written; until then empty."""
    spark.range(1).select(F.lit(mark).alias("state")).write.mode("overwrite").parquet(path)


def indexed(documents: DataFrame, path: str, window: int, step: int, state: str = "") -> retrieval.Index:
    """The index of windows, or of whole documents, written to ``path``. Its keys are (``doc_id``, ``part``). One that was
    made of the same ``state`` (files of the documents, empty: not known) in the same way is read instead."""
    spark = documents.sparkSession
    mark = json.dumps([state, window, step, "packed"])
    if state and _stands(spark, f"{path}/made", mark):
        log.info("%s stands: made of the same files", path)
        return retrieval.read_index(spark, path, blocks=False)
    _tell(spark, f"{path}/made", "")
    held = retrieval.write_index(documents, path, blocks=False, windows=(window, step))
    _tell(spark, f"{path}/made", mark)
    return held


def ranked_documents(questions: DataFrame, held: retrieval.Index, depth: int) -> DataFrame:
    """``query_id``, ``doc``, ``score`` (of the document's best window), ``rank``."""
    best = retrieval.best_documents(questions, held, depth, "item_id")
    return retrieval.ranked(best, [F.round("score", 9).desc(), F.col("doc")]).where(F.col("rank") <= depth)


def gold_of(questions: DataFrame, documents: DataFrame, whole: retrieval.Index) -> DataFrame:
    """``query_id``, ``doc`` of the documents that hold a question's words in a row."""
    return retrieval.holders(questions, documents, whole, query_key="item_id")


def evaluate(spark: SparkSession, documents: str, questions: str, output: str, settings: Settings = Settings()) -> list[str]:
    """Evaluates all configurations of ``settings``; their names."""
    if odd := [c["name"] for c in settings.configs if not re.fullmatch(r"[A-Za-z0-9_.-]+", c["name"])]:
        raise ValueError(f"configurations name folders; these can't: {odd}")
    docs = one_each(spark.read.parquet(documents).select("doc_id", "lang", "text"), "doc_id")
    asked = one_each(spark.read.parquet(questions).select("item_id", "text"), "item_id")
    log.info("read %d documents of %s, %d questions of %s", docs.count(), documents, asked.count(), questions)
    state = json.dumps([documents, *catalog.table_state(spark, documents)])
    of = [state, json.dumps([questions, *catalog.table_state(spark, questions)])]
    # what is right is a matter of whole documents, whatever the configurations
    whole = indexed(docs, f"{output}/whole", 0, 0, state)
    if not _stands(spark, f"{output}/made/gold", json.dumps(of)):
        _tell(spark, f"{output}/made/gold", "")
        gold_of(asked, docs, whole).write.mode("overwrite").parquet(f"{output}/gold")
        _tell(spark, f"{output}/made/gold", json.dumps(of))
    gold = spark.read.schema("query_id long, doc long").parquet(f"{output}/gold")
    right = gold.withColumn("is_right", F.lit(True))
    langs = docs.select(F.col("doc_id").alias("doc"), "lang")
    for config in settings.configs:
        name = config["name"]
        held = indexed(docs, f"{output}/index/config={name}", config["window"], config["step"], state) if config["window"] else whole
        made, mark = f"{output}/made/config={name}", json.dumps([*of, config["window"], config["step"], settings.depth])
        if _stands(spark, made, mark):
            log.info("%s: rankings and scores stand: made of the same files", name)
            continue
        _tell(spark, made, "")
        found = ranked_documents(asked, held, settings.depth).join(right, ["query_id", "doc"], "left").join(langs, "doc", "left")
        rows = found.select("query_id", "doc", "lang", "score", "rank", F.coalesce("is_right", F.lit(False)).alias("is_right"), F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit(NO_LANG)).alias("part_lang"))
        rows.repartition("part_lang").write.mode("overwrite").partitionBy("part_lang").parquet(f"{output}/rankings/config={name}")
        ranks = stored(spark, f"{output}/rankings", RANKINGS).where(F.col("config") == name)
        told = metrics.summary(metrics.by_query(asked.select(F.col("item_id").alias("query_id")), ranks.select("query_id", "doc", "rank"), gold))
        told.coalesce(1).write.mode("overwrite").parquet(f"{output}/scores/config={name}")
        _tell(spark, made, mark)
        log.info("%s: indexed %d texts, wrote %d ranks to %s/rankings", name, held.n_docs, ranks.count(), output)
    scores = stored(spark, f"{output}/scores", SCORES)
    files.write_eval(scores.select("config", *(c for c in scores.columns if c != "config")).orderBy("config"), f"{output}/report")
    log.info("wrote scores of %d configurations to %s/scores and %s/report", scores.count(), output, output)
    return [c["name"] for c in settings.configs]


if __name__ == "__main__":
    main("evaluate", __doc__, Settings, ("documents", "questions", "output"), evaluate)
