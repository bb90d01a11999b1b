"""The jobs over the whole tables, each twice into one new folder: what stands there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evaluate, ingest
from jobs.common import stored
from tesserae.plans.documents import PAGED
from tesserae.plans.search import GOLD, METRICS, TOKENS
from tesserae.sources import catalog

TOLD = ("hit_at_5", "hit_at_10", "mrr_at_10", "recall_at_10", "n_queries", "n_with_gold")


def job1_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks (``n`` words, ``m`` its first page) and terms (``n`` chunks, ``m`` occurrences) of the corpus."""
    folder = catalog.shared_folder(spark)
    for _ in range(2):
        ingest.ingest(spark, f"{d}/documents.parquet", f"{folder}/corpus", f"{folder}/mark")
    chunks = ingest.corpus(spark, f"{folder}/corpus", "chunks").select(F.lit("chunk").alias("kind"), "lang", F.col("chunk_id").alias("key"), F.col("token_count").cast("long").alias("n"), F.col("page_start").cast("long").alias("m"), F.md5("text").alias("md5"))
    terms = ingest.term_statistics(spark, f"{folder}/corpus").select(F.lit("term").alias("kind"), "lang", F.col("term").alias("key"), F.col("df").alias("n"), F.col("tf").alias("m"), F.lit(None).cast("string").alias("md5"))
    return chunks.unionByName(terms)


def job2_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all configurations (``kind`` is ``ranking``) and their figures (``kind`` is the figure's name)."""
    folder = catalog.shared_folder(spark)
    for _ in range(2):
        evaluate.evaluate(spark, f"{d}/documents.parquet", f"{d}/benchmark.parquet", folder)
    ranks = stored(spark, f"{folder}/rankings", evaluate.RANKINGS).select(F.lit("ranking").alias("kind"), "config", "query_id", "doc", "lang", "rank", "is_right", F.round("score", 4).alias("value"))
    figures = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("value")) for c in TOLD))).alias("t")
    none = {"query_id": "long", "doc": "long", "lang": "string", "rank": "int", "is_right": "boolean"}
    told = stored(spark, f"{folder}/scores", evaluate.SCORES).select("config", figures).select("t.kind", "config", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "t.value")
    return ranks.unionByName(told)


QUERIES = {f.__name__: f for f in (job1_ingest, job2_evaluate)}


def _windows(window: int, step: int) -> str:
    """Windows over the words ``tk``: ``doc_id``, ``k``, ``page``, ``n``, ``text``."""
    starts = f"SELECT doc_id, unnest(range(0, (greatest(0, ceil((n - {window}) / {step}.0)) + 1)::BIGINT)) AS k FROM (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1)"
    return f"SELECT doc_id, k, min(page) AS page, count(*) AS n, string_agg(t, ' ' ORDER BY pos) AS text FROM ({starts}) JOIN tk USING (doc_id) WHERE pos >= k * {step} AND pos < k * {step} + {window} GROUP BY ALL"


def _ranks(name: str, texts: str) -> str:
    """Tables ``<name>_...``: documents ranked by their best text of ``texts`` (``doc_id``, ``k``, ``text``)."""
    return f"""
{name}_c AS ({texts}), {name}_tok AS (SELECT doc_id, k, unnest({TOKENS.format('text')}) AS term FROM {name}_c), {name}_tf AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id, k) AS dl FROM (SELECT doc_id, k, term, count(*) AS tf FROM {name}_tok GROUP BY ALL)),
{name}_n AS (SELECT (SELECT count(*) FROM {name}_c) AS n_docs, (SELECT count(*) FROM {name}_tok) / (SELECT count(*) FROM {name}_c)::DOUBLE AS avgdl),
{name}_raw AS (SELECT term, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM {name}_tf, {name}_n GROUP BY term, n_docs),
{name}_idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw),
{name}_s AS (SELECT query_id, doc_id, k, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM {name}_tf JOIN q USING (term) JOIN {name}_idf USING (term), {name}_n GROUP BY ALL HAVING score > 0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT query_id, doc_id AS doc, max(score) AS score FROM {name}_s GROUP BY ALL) QUALIFY rank <= 10)"""


_CONFIGS = {"whole": "SELECT doc_id, 0 AS k, text FROM documents", "w650": _windows(650, 560), "w200": _windows(200, 150)}
_ASKED = f"q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
_RANKS = " UNION ALL ".join(f"SELECT 'ranking' AS kind, '{c}' AS config, r.query_id, r.doc, lang, r.rank::INT AS rank, gold.doc IS NOT NULL AS is_right, round(score, 4) AS value FROM {c} r LEFT JOIN gold USING (query_id, doc) JOIN documents ON doc_id = r.doc" for c in _CONFIGS)
_FIGURES = " UNION ALL ".join(METRICS.format(name=f"'{c}' AS config,", bm=c) for c in _CONFIGS)
ORACLES = {
    "job1_ingest": f"""WITH {PAGED}, c AS ({_windows(650, 560)}), t AS (SELECT doc_id, k, unnest({TOKENS.format('text')}) AS term FROM c)
SELECT 'chunk' AS kind, lang, doc_id || '::fixed::chunk' || k AS key, n, page AS m, md5(c.text) AS md5 FROM c JOIN documents USING (doc_id)
UNION ALL SELECT 'term', lang, term, count(DISTINCT (doc_id, k)), count(*), NULL FROM t JOIN documents USING (doc_id) GROUP BY lang, term""",
    "job2_evaluate": f"WITH {PAGED}, {_ASKED}, {GOLD}, {', '.join(_ranks(c, x) for c, x in _CONFIGS.items())}, fig AS ({_FIGURES}) {_RANKS} UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}', config, NULL, NULL, NULL, NULL, NULL, {f}::DOUBLE FROM fig" for f in TOLD),
}
