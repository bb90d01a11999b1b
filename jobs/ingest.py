"""Takes what is new in a growing folder of documents into a corpus that is ready for search.

    python -m jobs.ingest --documents IN --output OUT --checkpoint MARK --config jobs/ingest.json

New files (Parquet, columns of ``documents``) come as a file stream; the checkpoint remembers which were taken. A batch
leaves out rows without identifier and documents that an earlier batch has; of rows with one identifier one counts, whatever
their order. It writes three tables, each below ``OUT/<table>/batch=<number>`` by language:

- ``documents``: the texts as they came;
- ``chunks``: sliding windows of words with the pages (lines) that they cover;
- ``terms``: for each term the chunks that hold it and its occurrences in them. The figures of batches add up, so lexical
  statistics of the whole corpus never need its texts again.

A batch that was broken off is done again under its number and writes over what it left. So a rerun changes nothing, whether
the last run ended or not. Texts move once, to their place in the corpus; chunks and terms are made where they lie.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, stored
from tesserae.operators import chunking, incremental, retrieval

log = logging.getLogger("jobs.ingest")

DOCUMENTS = "doc_id long, lang string, source string, text string, batch int, part_lang string"
CHUNKS = "chunk_id string, doc_id long, lang string, page_start int, page_end int, token_count int, text string, batch int, part_lang string"
TERMS = "lang string, term string, df long, tf long, batch int, part_lang string"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "terms": TERMS}
#: The partition of texts without language; ``lang`` itself stays as it is.
NO_LANG = "none"


@dataclass(frozen=True)
class Settings:
    #: Words in a window, and from the start of one to that of the next.
    window: int = chunking.WINDOW
    step: int = chunking.STEP
    #: Files that one batch takes at most.
    files_per_batch: int = 1000


def corpus(spark: SparkSession, output: str, table: str) -> DataFrame:
    """``documents``, ``chunks`` or ``terms`` of all batches. ``terms`` has a row for each batch that a term is in."""
    return stored(spark, f"{output}/{table}", SCHEMAS[table])


def term_statistics(spark: SparkSession, output: str) -> DataFrame:
    """``lang``, ``term``, ``df``, ``tf`` of the whole corpus."""
    return corpus(spark, output, "terms").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def new_documents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Documents that ``known`` hasn't got, each once. The largest of unlike rows with one identifier counts."""
    named = rows.where("doc_id is not null")
    fresh = incremental.pending(named.select("doc_id", "lang", "source", "text"), known, "doc_id")
    return fresh.groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "r.lang", "r.source", "r.text")


def chunks_of(documents: DataFrame, settings: Settings) -> DataFrame:
    """Windows over the words of each document; its lines are its pages."""
    pages = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).alias("page_number"), x.alias("text")))
    papers = documents.select(F.col("doc_id").cast("string").alias("paper_id"), F.col("lang").alias("title"), pages.alias("pages"))
    made = chunking.fixed_chunks(papers, settings.window, settings.step)
    return made.select("chunk_id", F.col("paper_id").cast("long").alias("doc_id"), F.col("title").alias("lang"), "page_start", "page_end", "token_count", "text")


def terms_of(chunks: DataFrame) -> DataFrame:
    held = retrieval.postings(chunks, key="lang")  # a row is a chunk
    return held.groupBy(F.col("doc").alias("lang"), "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _writer(output: str, settings: Settings) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, table: str, number: int) -> DataFrame:
        part = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit(NO_LANG))
        rows.withColumn("part_lang", part).write.mode("overwrite").partitionBy("part_lang").parquet(f"{output}/{table}/batch={number}")
        return corpus(rows.sparkSession, output, table).where(F.col("batch") == number)

    def take(batch: DataFrame, number: int) -> None:
        known = corpus(batch.sparkSession, output, "documents").where(F.col("batch") < number)
        documents = write(new_documents(batch, known), "documents", number)
        chunks = write(chunks_of(documents, settings), "chunks", number)
        terms = write(terms_of(chunks), "terms", number)
        read, kept = batch.count(), documents.count()
        log.info("batch %d: read %d rows, took %d documents, left out %d", number, read, kept, read - kept)
        log.info("batch %d: wrote %d chunks and %d terms to %s", number, chunks.count(), terms.count(), output)

    return take


def as_stream_path(path: str) -> str:
    """File streams take folders and patterns only; a table may be a single file, so its name becomes a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings = Settings()) -> int:
    """Takes all files that are new since the last run with this checkpoint; the number of batches it took. Returns when the stream has ended."""
    files = as_stream_path(documents)
    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(files)
    query = stream.writeStream.foreachBatch(_writer(output, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    taken = sum(1 for p in query.recentProgress if p["numInputRows"])
    log.info("read %s: %d new batches; %s has %d documents", documents, taken, output, corpus(spark, output, "documents").count())
    return taken


if __name__ == "__main__":
    main("ingest", __doc__, Settings, ("documents", "output", "checkpoint"), ingest)
