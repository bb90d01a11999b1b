"""Retrieval and evaluation queries: documents as chunks, benchmark passages as questions, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import embed_text, tokens
from tesserae.operators import answer, evaluate, facts, retrieval
from tesserae.plans.facts import BEST, REC, records
from tesserae.plans.tables import table
from tesserae.sources import catalog
from tesserae.sources.scratch import shared_folder, written


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark: SparkSession, d: str) -> retrieval.Index:
    return catalog.index_of(spark, f"{d}/documents.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector asks."""
    return _vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _doc_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags cover the labelled documents only, as arrays."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels.select("doc_id"), "doc_id").select(F.col("doc_id").alias("doc"), F.array("lang").alias("signal_type"), F.array("source").alias("asset_class"))


def _score(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("query_id", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"), *extra)


TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
BM25 = f"""
tok AS (SELECT doc_id AS doc, unnest({TOKENS.format('text')}) AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS doc, coalesce(len({TOKENS.format('text')}), 0) AS dl FROM documents),
n AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
df0 AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df0, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm_scores AS (
  SELECT query_id, doc, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (doc), n GROUP BY ALL HAVING score > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM bm_scores QUALIFY rank <= 30)"""
DENSE = """
dn AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 30)"""
TAGS = "tags AS (SELECT doc_id AS doc, [lang] AS signal_type, [source] AS asset_class FROM documents JOIN (SELECT doc_id FROM labels) USING (doc_id))"


def r1_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"), F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def r2_bm25_stats(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def r2_doc_lengths(spark, d):
    return retrieval.doc_lengths(table(spark, d, "documents"))


def r3_bm25_topk(spark, d):
    return _score(retrieval.bm25(_questions(spark, d), _index(spark, d)))


def r4_dense_topk(spark, d):
    return _score(retrieval.dense(_vector_questions(spark, d), _vectors(spark, d)))


def _both(spark, d, post=lambda rows: rows):
    """Two rankings over the same identifiers: vectors, and lexical results of every question."""
    left = post(retrieval.dense(_vector_questions(spark, d), _vectors(spark, d)))
    right = post(retrieval.bm25(_questions(spark, d), _index(spark, d)))
    again = lambda rows: retrieval.ranked(rows.drop("rank"), [F.round("score", 9).desc(), F.col("doc")])
    return again(left), again(right)


def r5_tag_postfilter(spark, d):
    found = retrieval.bm25(_questions(spark, d), _index(spark, d))
    return _score(retrieval.tag_filter(found, _doc_tags(spark, d), {"signal_type": "en"}))


def r5_missing_tags(spark, d):
    """With an allow-list, untagged documents pass and the tags of the others still count."""
    found = retrieval.bm25(_questions(spark, d), _index(spark, d))
    ids = table(spark, d, "documents").where("n_chars > 1000").select("doc_id")
    return _score(retrieval.tag_filter(found, _doc_tags(spark, d), {"signal_type": "en"}, ids))


def r5_prefilter(spark, d):
    docs = table(spark, d, "documents")
    return _score(retrieval.search(_questions(spark, d), docs, k=30, tags=_doc_tags(spark, d), wanted={"signal_type": "fr"}, filter_mode="pre", held=_index(spark, d)))


def r6_rrf(spark, d):
    return retrieval.fuse(*_both(spark, d)).select("query_id", "doc", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


def r8_hybrid_norerank(spark, d):
    return retrieval.fuse(*_both(spark, d), k=5).select("query_id", "doc", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


def r7_rerank_standin(spark, d):
    q, docs = _questions(spark, d), table(spark, d, "documents")
    found = retrieval.bm25(q, _index(spark, d)).where(F.col("rank") <= retrieval.RERANKED)
    return _score(retrieval.rerank_standin(q, found, docs, 8))


def r9_embed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(embed_text(F.col("lang"), F.col("source"), F.col("text"))).alias("md5"))


def r10_embed_standin(spark, d):
    return retrieval.embed_standin(table(spark, d, "documents"))


def r11_lookup(spark, d):
    """Results with the columns of their documents."""
    found = retrieval.bm25(_questions(spark, d), _index(spark, d), 5)
    return found.join(table(spark, d, "documents").withColumnRenamed("doc_id", "doc"), "doc").select("query_id", "doc", "lang", "source", F.col("rank").cast("long").alias("rank"))


def _gold(spark, d):
    return written(retrieval.holders(_questions(spark, d), table(spark, d, "documents"), _index(spark, d)))  # read several times


def e1_hit_mrr(spark, d):
    q = _questions(spark, d)
    return evaluate.summary(evaluate.by_query(q, retrieval.bm25(q, _index(spark, d), 10), _gold(spark, d)))


def _configs(spark, d):
    """All of a text, and its first 500 characters, which is what the second configuration is about."""
    q, gold = _questions(spark, d), _gold(spark, d)
    short = table(spark, d, "documents").withColumn("text", F.substring("text", 1, 500))
    held = retrieval.write_index(short, shared_folder(spark), blocks=False)
    return {"full": (q, retrieval.bm25(q, _index(spark, d)), gold), "first_500": (q, retrieval.bm25(q, held), gold)}


def e2_config_grid(spark, d):
    return evaluate.grid(_configs(spark, d))


def e3_ablation(spark, d):
    return evaluate.ablation(written(evaluate.grid(_configs(spark, d))), "full", ["first_500"])


def a2_retrieval_batch(spark, d):
    """Questions with one filter, two, or none; a filter that leaves too little widens the search."""
    lang = F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("no such"), F.lit(None).cast("string")), (F.col("item_id") % 4).cast("int"))
    source = F.when(F.col("item_id") % 3 == 1, F.lit("src0"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", lang.alias("signal_type"), source.alias("asset_class"))
    return _score(answer.retrieved_batch(asked, _index(spark, d), _doc_tags(spark, d)), "widened")


def a3_hybrid_batch(spark, d):
    """Structured matches of four questions in one pass, and the chunks of the best papers for every benchmark passage."""
    found = answer.structured_batch(records(spark, d), HYBRID)
    q = _questions(spark, d)
    matches = q.select("query_id", (F.col("query_id") % len(HYBRID)).alias("_p")).join(found.withColumnRenamed("query_id", "_p"), "_p")
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("user:"), (F.col("doc_id") % 200).cast("string")).alias("paper_id"))
    return _score(answer.hybrid_batch(q, matches, papers, _index(spark, d)))


def a3_structured_batch(spark, d):
    found = answer.structured_batch(records(spark, d), HYBRID)
    return found.select("query_id", F.col("place").cast("long").alias("place"), "paper_id", F.col("matching_metric.value").alias("value"), "total_matches")


def _asked_of_facts(spark, d):
    """A question for each customer: filters, a part of a metric's name and a threshold by its columns."""
    k = F.col("c_custkey")
    pick = lambda n, *values: F.get(F.array(*values), (k % n).cast("int"))
    none, words = F.array().cast("array<string>"), lambda *v: F.array(*map(F.lit, v))
    return table(spark, d, "customer").select(
        k.alias("query_id"), pick(4, none, words("error"), words("view", "click"), none).alias("signal_type"), F.when(k % 3 == 0, F.array(F.concat(F.lit("c"), (k % 2).cast("string")))).otherwise(none).alias("asset_class"),
        pick(5, *map(F.lit, ("click", "IC", "e", "", "no such"))).alias("keyword"), pick(7, *map(F.lit, (">", "<", "none", ">=", "<=", ">", "<"))).alias("operator"), (F.abs("c_acctbal") % 90).alias("threshold"), F.when(k % 11 == 0, "ratio").alias("unit"),
    )


def a4_questions(spark, d):
    found = answer.structured_questions(records(spark, d), _asked_of_facts(spark, d))
    return found.select("query_id", F.col("place").cast("long").alias("place"), "paper_id", F.col("matching_metric.value").alias("value"), "total_matches")


HYBRID = {
    0: facts.Params(("click", "view"), ("c0", "c1"), "purchase", ">", 50.0), 1: facts.Params(keyword="error", operator="<", threshold=5.0),
    2: facts.Params(asset_class=("c2",)), 3: facts.Params(keyword="no such"),
}
SHORT = BM25.replace("FROM documents", "FROM (SELECT doc_id, substr(text, 1, 500) AS text FROM documents)").replace("tok AS", "s_tok AS").replace("tf AS (SELECT doc, term", "s_tf AS (SELECT doc, term").replace("dl AS (SELECT doc_id", "s_dl AS (SELECT doc_id")
for _name in ("n AS (SELECT count", "df0 AS", "raw AS (SELECT term", "idf AS (SELECT term", "q AS (SELECT query_id", "bm_scores AS", "bm AS"):
    SHORT = SHORT.replace(_name, "s_" + _name)
for _a, _b in (("FROM tok", "FROM s_tok"), ("FROM dl)", "FROM s_dl)"), ("FROM tf GROUP", "FROM s_tf GROUP"), ("FROM df0, n", "FROM s_df0, s_n"), ("(SELECT avg(raw) FROM raw)", "(SELECT avg(raw) FROM s_raw)"), ("FROM raw)", "FROM s_raw)"), ("FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (doc), n", "FROM s_tf JOIN s_q USING (term) JOIN s_idf USING (term) JOIN s_dl USING (doc), s_n"), ("FROM bm_scores", "FROM s_bm_scores")):
    SHORT = SHORT.replace(_a, _b)
NORM = "' ' || array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ') || ' '"
GOLD = f"gold AS (SELECT item_id AS query_id, doc_id AS doc FROM (SELECT doc_id, {NORM.format('text')} AS t FROM documents) d, (SELECT item_id, {NORM.format('text')} AS t FROM benchmark) b WHERE contains(d.t, b.t) AND b.t <> '  ')"
METRICS = """SELECT {name} round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_at_10,
  round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr_at_10, round(avg(recall), 6) AS recall_at_10, count(*) AS n_queries, count(*) FILTER (n_gold > 0) AS n_with_gold
FROM (SELECT b.item_id, min(rank) AS r, count(rank) / greatest(max(g.n), 1)::DOUBLE AS recall, coalesce(max(g.n), 0) AS n_gold
  FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g ON g.query_id = b.item_id
  LEFT JOIN (SELECT query_id, rank FROM {bm} JOIN gold USING (query_id, doc) WHERE rank <= 10) h ON h.query_id = b.item_id GROUP BY 1)"""
POST = "SELECT query_id, doc, round(score, 4) AS score, rank FROM bm"

QUERIES = {f.__name__: f for f in (r1_tokenize, r2_bm25_stats, r2_doc_lengths, r3_bm25_topk, r4_dense_topk, r5_tag_postfilter, r5_missing_tags, r5_prefilter, r6_rrf, r8_hybrid_norerank, r7_rerank_standin, r9_embed_text, r10_embed_standin, r11_lookup, e1_hit_mrr, e2_config_grid, e3_ablation, a2_retrieval_batch, a3_hybrid_batch, a3_structured_batch, a4_questions)}
RRF = """f AS (SELECT query_id, doc, sum(s) AS score, min(seen) AS seen FROM (
    SELECT query_id, doc, 1.0::DOUBLE / (60 + rank) AS s, {{'list': 0, 'rank': rank}} AS seen FROM dn UNION ALL SELECT query_id, doc, 1.0::DOUBLE / (60 + rank), {{'list': 1, 'rank': rank}} FROM bm) GROUP BY ALL)
SELECT query_id, doc, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM f {0}"""
PARAMS = f"""
best AS ({BEST}), low AS (SELECT user_id, event_id, event_type, value FROM ev WHERE event_type = 'error' AND value < 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1),
sb0 AS (SELECT 0 AS query_id, user_id, -value AS k, value FROM best JOIN rec USING (user_id) WHERE list_has_any(signal, ['click', 'view']) AND asset IN ('c0', 'c1')
  UNION ALL SELECT 1, user_id, value, value FROM low UNION ALL SELECT 2, user_id, 0, NULL FROM rec WHERE asset = 'c2'),
sb AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k, user_id) AS place, 'user:' || user_id AS paper_id, value, count(*) OVER (PARTITION BY query_id) AS total_matches FROM sb0)"""
ORACLES = {
    "a2_retrieval_batch": f"""WITH {BM25}, {TAGS}, f AS (SELECT item_id AS query_id, ['en', 'fr', 'no such', NULL][item_id % 4 + 1] AS s, CASE WHEN item_id % 3 = 1 THEN 'src0' END AS a FROM benchmark),
p AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM bm_scores JOIN f USING (query_id) LEFT JOIN tags USING (doc)
  WHERE (s IS NULL OR coalesce(list_contains(signal_type, s), false)) AND (a IS NULL OR coalesce(list_contains(asset_class, a), false)) QUALIFY rank <= 8),
w AS (SELECT query_id FROM f LEFT JOIN (SELECT query_id, count(*) AS n FROM p GROUP BY 1) USING (query_id) WHERE (s IS NOT NULL OR a IS NOT NULL) AND coalesce(n, 0) < 4)
SELECT query_id, doc, round(score, 4) AS score, rank, false AS widened FROM p WHERE query_id NOT IN (SELECT query_id FROM w) UNION ALL SELECT query_id, doc, round(score, 4), rank, true FROM bm WHERE rank <= 8 AND query_id IN (SELECT query_id FROM w)""",
    "a3_hybrid_batch": f"""WITH {BM25}, {REC}, {PARAMS}, al AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS doc FROM benchmark b JOIN sb ON sb.query_id = b.item_id % 4 AND place <= 3 JOIN documents d ON sb.paper_id = 'user:' || (d.doc_id % 200))
SELECT query_id, doc, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM bm_scores JOIN al USING (query_id, doc) QUALIFY rank <= 8""",
    "a3_structured_batch": f"WITH {REC}, {PARAMS} SELECT query_id::BIGINT AS query_id, place, paper_id, value, total_matches FROM sb WHERE place <= 25",
    "a4_questions": f"""WITH {REC}, q AS (SELECT c_custkey AS query_id, [[], ['error'], ['view', 'click'], []][c_custkey % 4 + 1] AS s, CASE WHEN c_custkey % 3 = 0 THEN 'c' || (c_custkey % 2) END AS a, ['click', 'ic', 'e', '', 'no such'][c_custkey % 5 + 1] AS kw,
  ['>', '<', 'none', '>=', '<=', '>', '<'][c_custkey % 7 + 1] AS op, abs(c_acctbal) % 90 AS t, CASE WHEN c_custkey % 11 = 0 THEN 'ratio' END AS u FROM customer),
qr AS (SELECT query_id, kw, op, t, u, user_id FROM q JOIN rec ON (len(s) = 0 OR list_has_any(signal, s)) AND (a IS NULL OR a = asset)),
x AS (SELECT query_id, qr.user_id, op, value FROM qr JOIN ev ON ev.user_id = qr.user_id AND kw <> '' AND contains(lower(event_type), kw) AND (u IS NULL OR unit = u)
    AND CASE op WHEN '>' THEN value > t WHEN '>=' THEN value >= t WHEN '<' THEN value < t WHEN '<=' THEN value <= t ELSE true END
  QUALIFY row_number() OVER (PARTITION BY query_id, qr.user_id ORDER BY CASE WHEN op IN ('>', '>=') THEN -value WHEN op IN ('<', '<=') THEN value ELSE 0 END, event_id) = 1
  UNION ALL SELECT query_id, user_id, 'none', NULL FROM qr WHERE kw = ''),
y AS (SELECT query_id, user_id, value, count(*) OVER (PARTITION BY query_id) AS total_matches, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN value IS NULL THEN 0 WHEN op IN ('<', '<=') THEN value ELSE -value END, user_id) AS place FROM x)
SELECT query_id, place, 'user:' || user_id AS paper_id, value, total_matches FROM y WHERE place <= 25""",
    "r1_tokenize": f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens, len({TOKENS.format('text')}) AS n_tokens FROM documents",
    "r2_bm25_stats": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "r2_doc_lengths": f"WITH {BM25} SELECT doc, dl FROM dl",
    "r3_bm25_topk": f"WITH {BM25} {POST}",
    "r4_dense_topk": f"WITH {DENSE} SELECT query_id, doc, round(score, 4) AS score, rank FROM dn",
    "r5_tag_postfilter": f"WITH {BM25}, {TAGS} {POST} JOIN tags USING (doc) WHERE list_contains(signal_type, 'en')",
    "r5_missing_tags": f"WITH {BM25}, {TAGS} {POST} LEFT JOIN tags USING (doc) WHERE doc IN (SELECT doc_id FROM documents WHERE n_chars > 1000) AND (signal_type IS NULL OR list_contains(signal_type, 'en'))",
    "r5_prefilter": "WITH " + BM25.replace("FROM tf JOIN q", "FROM (SELECT * FROM tf WHERE doc IN (SELECT doc_id FROM documents JOIN (SELECT doc_id FROM labels) USING (doc_id) WHERE lang = 'fr')) tf JOIN q") + f" {POST}",
    "r6_rrf": f"WITH {BM25}, {DENSE}, " + RRF.format(""),
    "r8_hybrid_norerank": f"WITH {BM25}, {DENSE}, " + RRF.format("QUALIFY rank <= 5"),
    "r9_embed_text": "SELECT doc_id, md5(lang || chr(10) || source || chr(10) || chr(10) || text) AS md5 FROM documents",
    "r11_lookup": f"WITH {BM25} SELECT query_id, doc, lang, source, rank FROM bm JOIN documents ON doc_id = doc WHERE rank <= 5",
    "e1_hit_mrr": f"WITH {BM25}, {GOLD} " + METRICS.format(name="", bm="bm"),
    "e2_config_grid": f"WITH {BM25}, {SHORT}, {GOLD} " + METRICS.format(name="'full' AS config,", bm="bm") + " UNION ALL " + METRICS.format(name="'first_500' AS config,", bm="s_bm"),
    "e3_ablation": f"WITH {BM25}, {SHORT}, {GOLD}, g AS (" + METRICS.format(name="'full' AS config,", bm="bm") + " UNION ALL " + METRICS.format(name="'first_500' AS config,", bm="s_bm") + """)
SELECT a.config AS baseline, b.config AS variant, a.hit_at_5 AS baseline_hit_at_5, b.hit_at_5 AS variant_hit_at_5, round(b.hit_at_5 - a.hit_at_5, 6) AS delta_hit_at_5,
  a.mrr_at_10 AS baseline_mrr_at_10, b.mrr_at_10 AS variant_mrr_at_10, round(b.mrr_at_10 - a.mrr_at_10, 6) AS delta_mrr_at_10 FROM g a, g b WHERE a.config = 'full' AND b.config = 'first_500'""",
}
