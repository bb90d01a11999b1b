"""Fact queries: a record per user, a metric per event; labels stand for curated tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import extract, facts, validate
from tesserae.plans.tables import table

UNIT = {"click": "ratio", "view": "percent", "purchase": "currency", "error": "count", "signup": "stddev"}


def records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    unit = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in UNIT.items()), F.lit("other"))
    quote = F.concat(F.lit("reported "), F.col("event_type"), F.lit(" of "), F.col("value").cast("string"), F.when(F.col("event_id") % 7 == 0, "%").otherwise(""))
    metric = F.struct(F.col("event_id").alias("pos"), F.col("event_type").alias("metric_name"), "value", unit.alias("unit"), F.lit("").alias("context"), quote.alias("evidence_quote"), F.lit("").alias("source_location"))
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(metric)).alias("m"), F.array_sort(F.collect_set(F.when(F.col("value") > 100, F.col("event_type")))).alias("signal_type"))
    metrics = F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in ("metric_name", "value", "unit", "context", "evidence_quote", "source_location"))))
    return per.select(
        F.col("user_id").alias("file_name"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("paper_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"),
        F.struct("signal_type", F.array(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))).alias("asset_class"), F.lit("s").alias("methodology_summary"), metrics.alias("performance_metrics")).alias("extraction"),
    )


REC = f"""
ev AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in UNIT.items())} ELSE 'other' END AS unit,
  'reported ' || event_type || ' of ' || value::VARCHAR || CASE WHEN event_id % 7 = 0 THEN '%' ELSE '' END AS quote FROM events),
rec AS (SELECT user_id, 'user:' || user_id AS paper_id, 'User ' || user_id AS title, 'c' || (user_id % 3) AS asset,
  coalesce(list_sort(list(DISTINCT event_type) FILTER (value > 100)), []) AS signal FROM ev GROUP BY ALL)"""
PICK = "SELECT user_id, event_id, event_type, value, unit FROM ev WHERE contains(lower(event_type), '{kw}') AND value {op} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {by}) = 1"


def _flat(df: DataFrame, *more) -> DataFrame:
    return df.select("paper_id", "title", F.array_join("signal_type", ",").alias("signal_type"), F.array_join("asset_class", ",").alias("asset_class"), F.col("matching_metric.metric_name").alias("metric"), F.col("matching_metric.value").alias("value"), F.col("matching_metric.unit").alias("unit"), *more)


def q1_array_overlap(spark, d):
    return facts.matches(records(spark, d), facts.Params(signal_type=("error", "purchase"), asset_class=("c1", "c2"))).select("paper_id")


def q2_allow_list(spark, d):
    ids = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("id"))
    return facts.matches(records(spark, d), facts.Params(), ids).select("paper_id")


def q3_substring(spark, d):
    return facts.fact_table(records(spark, d)).where(facts.names_match(F.col("metric_name"), "IC")).select("paper_id", F.col("pos").cast("long").alias("pos"), "metric_name", "value")


def q4_threshold(spark, d):
    rows = facts.fact_table(records(spark, d))
    return rows.agg(*(F.count(F.when(facts.compare(F.col("value"), op, 20.0), 1)).alias(name) for op, name in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"))))


def q5_best_metric(spark, d):
    metrics = F.col("extraction.performance_metrics")
    pick = lambda op: facts.best_metric(metrics, facts.Params(keyword="click", operator=op, threshold=20.0))
    return records(spark, d).select("paper_id", *(pick(op)["value"].alias(name) for op, name in ((">", "most"), ("<", "least"), ("none", "first"))))


def q6_requires_metric(spark, d):
    """Only with a keyword does a record need a metric; an operator alone asks nothing."""
    r = records(spark, d)
    one = facts.matches(r, facts.Params(keyword="purchase", operator=">", threshold=150.0)).select("paper_id", F.lit("keyword").alias("asked"))
    return one.unionByName(facts.matches(r, facts.Params(operator=">", threshold=150.0)).select("paper_id", F.lit("operator").alias("asked")))


def q7_topk(spark, d):
    return _flat(facts.structured_query(records(spark, d), facts.Params(keyword="error", operator="<", threshold=5.0)))


def q8_projection(spark, d):
    return _flat(facts.structured_query(records(spark, d), facts.Params(asset_class=("c0",))), "methodology_summary")


def q9_structured(spark, d):
    return _flat(facts.structured_query(records(spark, d), facts.Params(("click", "view"), ("c0", "c1"), "purchase", ">", 50.0), with_total=True), "total_matches")


def q10_total_count(spark, d):
    r = records(spark, d)
    return facts.summary(r, facts.Params(("click", "view"), ("c0", "c1"), "purchase", ">", 50.0)).unionByName(facts.summary(r, facts.Params(keyword="no such"))).unionByName(facts.summary(r, facts.Params()))


def _quotes(spark, d):
    """Every turn as a quote, and what its conversation opened with as the source."""
    c = table(spark, d, "conversations")
    quotes = c.select(F.concat_ws("/", "conv_id", "turn").alias("quote_id"), F.col("conv_id").alias("source_id"), F.col("text").alias("quote"))
    return quotes, c.groupBy(F.col("conv_id").alias("source_id")).agg(F.min_by("text", "turn").alias("text"))


def v1_containment(spark, d):
    quotes, sources = _quotes(spark, d)
    return quotes.join(sources, "source_id").select("quote_id", validate.is_grounded(F.col("quote"), F.col("text"), 0.3).alias("grounded"))


def v1_containment_join(spark, d):
    return validate.grounded(*_quotes(spark, d), 0.3).select("quote_id", F.round("share", 6).alias("share"), "grounded")


def v5_extract(spark, d):
    """A paper per user from what its events report, through the stand-in extractor, checked and with its metadata."""
    quote = F.concat(F.lit("reported "), F.col("event_type"), F.lit(" of "), F.col("value").cast("string"), F.when(F.col("event_id") % 7 == 0, "%").otherwise(""))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", quote.alias("q")))), lambda x: x["q"]), "\n")
    per = table(spark, d, "events").groupBy("user_id").agg(told.alias("text"))
    section = F.struct(F.lit("Results").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("text").alias("text"))
    none = F.array().cast("array<struct<table_id:string,page:int,caption:string,bbox:array<double>,html:string,rows:array<array<string>>>>")
    papers = per.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("paper_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"), F.array(section).alias("sections"), none.alias("tables"))
    made = extract.process_papers(papers, extract.extract_standin, _curated(spark, d), "stand-in", "2000-01-01T00:00:00+00:00")
    metrics, meta = F.col("extraction.performance_metrics"), F.col("extraction_meta")
    total = F.aggregate(metrics, F.lit(0.0), lambda s, m: s + m["value"])
    return made.select("paper_id", "title", F.size(metrics).cast("long").alias("n_metrics"), F.round(total, 4).alias("total"), meta["input_tokens"].alias("input_tokens"), F.array_join(meta["validation_flags"], "|").alias("flags"), F.array_join(meta["curation_signal_type"], ",").alias("curated"), "error")


def v2_range(spark, d):
    rows = facts.fact_table(records(spark, d))
    return rows.where(validate.out_of_range(F.col("metric_name"), F.col("value"), F.col("unit"))).select("paper_id", F.col("pos").cast("long").alias("pos"), "metric_name", "value", "unit")


def _curated(spark, d):
    """Curated tags for two users of three."""
    return table(spark, d, "events").where("user_id % 3 <> 1").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 120, F.col("event_type")))).alias("signal_type")).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("paper_id"), "signal_type", F.array(F.when(F.col("user_id") % 2 == 0, "c0").otherwise("other")).alias("asset_class"))


def v3_tag_mismatch(spark, d):
    both = records(spark, d).select("paper_id", F.col("extraction.signal_type").alias("s"), F.col("extraction.asset_class").alias("a")).join(_curated(spark, d), "paper_id")
    return both.select("paper_id", validate.tag_mismatch(F.col("s"), F.col("signal_type")).alias("signal"), validate.tag_mismatch(F.col("a"), F.col("asset_class")).alias("asset"))


def _sources(spark, d):
    return records(spark, d).where("file_name % 5 <> 0").select("paper_id", F.lit("reported click of 1 view purchase").alias("source"))


def v4_flags(spark, d):
    return validate.validate(records(spark, d), _sources(spark, d), _curated(spark, d)).select("paper_id", F.array_join("new_flags", "|").alias("flags"))


def v6_revalidate(spark, d):
    meta = records(spark, d).withColumn("extraction_meta", F.struct(F.array(F.lit("no_curation_tags_to_cross_check")).alias("validation_flags")))
    return validate.revalidate(meta, _sources(spark, d), _curated(spark, d)).select("paper_id", F.size("flags").cast("long").alias("n_flags"), "changed")


def v7_flag_counts(spark, d):
    return validate.flag_counts(validate.validate(records(spark, d), _sources(spark, d), _curated(spark, d)).select(F.col("new_flags").alias("flags")))


def v8_schema(spark, d):
    """Records of users don't fit the enumerations; each violation is named."""
    extraction = F.col("extraction").withField("data_period", F.lit("")).withField("universe", F.lit(None).cast("string")).withField("extraction_confidence", F.lit("high"))
    return records(spark, d).select("paper_id", F.array_join(validate.schema_errors(extraction), "|").alias("errors"))


def e4_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def e5_distinct(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


def s11_summary(spark, d):
    """One line per record: tags joined, the sample metric (first named like ``click``, else the first)."""
    metrics = F.col("extraction.performance_metrics")
    sample = F.coalesce(F.get(F.filter(metrics, lambda m: F.contains(F.lower(m["metric_name"]), F.lit("click"))), F.lit(0)), F.get(metrics, F.lit(0)))
    return records(spark, d).select("paper_id", "title", F.array_join("extraction.signal_type", ";").alias("signal_type"), F.size(metrics).cast("long").alias("num_performance_metrics"), F.coalesce(F.concat(sample["metric_name"], F.lit("="), sample["value"].cast("string"), sample["unit"]), F.lit("")).alias("sample_metric"))


RANGE = """CASE unit WHEN 'ratio' THEN value BETWEEN -15 AND 20 WHEN 'percent' THEN value BETWEEN -500 AND 5000 WHEN 'stddev' THEN value BETWEEN 0 AND 500
  WHEN 'count' THEN value BETWEEN 0 AND 1e12 WHEN 'currency' THEN value BETWEEN -1e15 AND 1e15 ELSE value BETWEEN -1e12 AND 1e12 END"""
CUR = """
cur AS (SELECT 'user:' || user_id AS paper_id, coalesce(list_sort(list(DISTINCT event_type) FILTER (value > 120)), []) AS cs, CASE WHEN user_id % 2 = 0 THEN 'c0' ELSE 'other' END AS ca
  FROM events WHERE user_id % 3 <> 1 GROUP BY user_id)"""
MIS = """len(cs) > 0 AND NOT list_has_any(signal, cs) AND signal <> ['other'] AND cs <> ['other'] AS signal_mis, asset <> ca AND asset <> 'other' AND ca <> 'other' AS asset_mis"""
FLAGS = f"""
src AS (SELECT paper_id, user_id % 5 <> 0 AS has_source, signal, asset, user_id FROM rec),
mf AS (SELECT user_id, event_id, list_filter(['unverified_quote:''' || event_type || '''', CASE WHEN NOT ({RANGE}) THEN 'metric_out_of_range:''' || event_type || '''=' || value::VARCHAR || unit END],
    lambda x: x IS NOT NULL) AS f,
  len(list_filter(regexp_extract_all(lower(quote), '[a-z0-9]+'), lambda w: len(w) >= 3)) AS n,
  len(list_filter(regexp_extract_all(lower(quote), '[a-z0-9]+'), lambda w: len(w) >= 3 AND w IN ('reported', 'click', 'view', 'purchase'))) AS hit FROM ev),
mf2 AS (SELECT user_id, flatten(list(CASE WHEN n = 0 OR hit / n >= 0.7 THEN list_filter(f, lambda x: NOT starts_with(x, 'unverified')) ELSE f END ORDER BY event_id)) AS f FROM mf GROUP BY user_id),
fl AS (SELECT src.paper_id, CASE WHEN has_source THEN list_concat(f, CASE WHEN cur.paper_id IS NULL THEN ['no_curation_tags_to_cross_check'] ELSE
    list_filter([CASE WHEN len(cs) > 0 AND NOT list_has_any(signal, cs) AND signal <> ['other'] AND cs <> ['other'] THEN 'signal_type_disagrees_with_curation' END,
      CASE WHEN asset <> ca AND asset <> 'other' AND ca <> 'other' THEN 'asset_class_disagrees_with_curation' END], lambda x: x IS NOT NULL) END) END AS flags
  FROM src JOIN mf2 USING (user_id) LEFT JOIN cur ON cur.paper_id = src.paper_id)"""
QUOTES = """
qs AS (SELECT c.conv_id || '/' || c.turn AS quote_id, list_filter(regexp_extract_all(lower(c.text), '[a-z0-9]+'), lambda w: len(w) >= 3) AS q, regexp_extract_all(lower(o.text), '[a-z0-9]+') AS s
  FROM conversations c JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1) o USING (conv_id)),
sh AS (SELECT quote_id, CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(q, lambda w: list_contains(s, w))) / len(q)::DOUBLE END AS share FROM qs)"""
MET = "SELECT paper_id, title, array_to_string(signal, ',') AS signal_type, asset AS asset_class, event_type AS metric, value, unit"

QUERIES = {f.__name__: f for f in (q1_array_overlap, q2_allow_list, q3_substring, q4_threshold, q5_best_metric, q6_requires_metric, q7_topk, q8_projection, q9_structured, q10_total_count, v1_containment, v1_containment_join, v5_extract, v2_range, v3_tag_mismatch, v4_flags, v6_revalidate, v7_flag_counts, v8_schema, e4_stats, e5_distinct, s11_summary)}
BEST = PICK.format(kw="purchase", op="> 50", by="value DESC, event_id")
ORACLES = {
    "q1_array_overlap": f"WITH {REC} SELECT paper_id FROM rec WHERE list_has_any(signal, ['error', 'purchase']) AND asset IN ('c1', 'c2')",
    "q2_allow_list": f"WITH {REC} SELECT paper_id FROM rec WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "q3_substring": f"WITH {REC} SELECT 'user:' || user_id AS paper_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS metric_name, value FROM ev QUALIFY contains(lower(event_type), 'ic')",
    "q4_threshold": "SELECT count(*) FILTER (value > 20) AS gt, count(*) FILTER (value >= 20) AS ge, count(*) FILTER (value < 20) AS lt, count(*) FILTER (value <= 20) AS le FROM events",
    "q5_best_metric": f"WITH {REC}, a AS ({PICK.format(kw='click', op='> 20', by='value DESC, event_id')}), b AS ({PICK.format(kw='click', op='< 20', by='value, event_id')}), c AS ({PICK.format(kw='click', op='IS NOT NULL', by='event_id')}) SELECT paper_id, a.value AS most, b.value AS least, c.value AS first FROM rec LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)",
    "q6_requires_metric": f"WITH {REC} SELECT paper_id, 'keyword' AS asked FROM rec WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase' AND value > 150) UNION ALL SELECT paper_id, 'operator' FROM rec",
    "q7_topk": f"WITH {REC}, p AS ({PICK.format(kw='error', op='< 5', by='value, event_id')}) {MET} FROM p JOIN rec USING (user_id) ORDER BY value, user_id LIMIT 25",
    "q8_projection": f"WITH {REC} SELECT paper_id, title, array_to_string(signal, ',') AS signal_type, asset AS asset_class, NULL::VARCHAR AS metric, NULL::DOUBLE AS value, NULL::VARCHAR AS unit, 's' AS methodology_summary FROM rec WHERE asset = 'c0' ORDER BY user_id LIMIT 25",
    "q9_structured": f"WITH {REC}, p AS ({BEST}), m AS ({MET}, user_id FROM p JOIN rec USING (user_id) WHERE list_has_any(signal, ['click', 'view']) AND asset IN ('c0', 'c1')) SELECT * EXCLUDE (user_id), (SELECT count(*) FROM m) AS total_matches FROM m ORDER BY value DESC, user_id LIMIT 25",
    "q10_total_count": f"WITH {REC}, p AS ({BEST}), n AS (SELECT count(*) AS c FROM p JOIN rec USING (user_id) WHERE list_has_any(signal, ['click', 'view']) AND asset IN ('c0', 'c1')) SELECT c AS total_matches, CASE WHEN c = 0 THEN 'nothing fits' ELSE c || ' fit: signal_type in click, view; asset_class in c0, c1; purchase > 50.0' END AS summary FROM n UNION ALL SELECT 0, 'nothing fits' UNION ALL SELECT count(*), count(*) || ' fit' FROM rec",
    "v1_containment": f"WITH {QUOTES} SELECT quote_id, share >= 0.3 AS grounded FROM sh",
    "v1_containment_join": f"WITH {QUOTES} SELECT quote_id, round(share, 6) AS share, share >= 0.3 AS grounded FROM sh",
    "v5_extract": f"""WITH {REC}, {CUR}, x AS (SELECT user_id, value, event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'percent' ELSE 'ratio' END AS unit FROM ev),
m AS (SELECT user_id, count(*) AS n, round(sum(value ORDER BY event_id), 4) AS total,
  coalesce(list('metric_out_of_range:' || chr(39) || event_type || chr(39) || '=' || value::VARCHAR || unit ORDER BY event_id) FILTER (NOT (CASE unit WHEN 'ratio' THEN value BETWEEN -15 AND 20 ELSE value BETWEEN -500 AND 5000 END)), []) AS f FROM x GROUP BY user_id)
SELECT rec.paper_id, title, n AS n_metrics, total, 5 + 4 * n AS input_tokens, array_to_string(list_concat(f, CASE WHEN cur.paper_id IS NULL THEN ['no_curation_tags_to_cross_check'] ELSE [] END), '|') AS flags,
  coalesce(array_to_string(cs, ','), '') AS curated, NULL::VARCHAR AS error FROM rec JOIN m USING (user_id) LEFT JOIN cur ON cur.paper_id = rec.paper_id""",
    "v2_range": f"WITH {REC} SELECT 'user:' || user_id AS paper_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS metric_name, value, unit FROM ev QUALIFY NOT ({RANGE})",
    "v3_tag_mismatch": f"WITH {REC}, {CUR}, x AS (SELECT rec.paper_id, {MIS} FROM rec JOIN cur ON cur.paper_id = rec.paper_id) SELECT paper_id, signal_mis AS signal, asset_mis AS asset FROM x",
    "v4_flags": f"WITH {REC}, {CUR}, {FLAGS} SELECT paper_id, array_to_string(flags, '|') AS flags FROM fl",
    "v6_revalidate": f"WITH {REC}, {CUR}, {FLAGS} SELECT paper_id, coalesce(len(flags), 1) AS n_flags, flags IS NOT NULL AND flags <> ['no_curation_tags_to_cross_check'] AS changed FROM fl",
    "v7_flag_counts": f"WITH {REC}, {CUR}, {FLAGS} SELECT split_part(f, ':', 1) AS flag, count(*) AS n FROM (SELECT unnest(flags) AS f FROM fl) GROUP BY 1",
    "v8_schema": f"WITH {REC} SELECT paper_id, array_to_string(list_filter([CASE WHEN len(signal) = 0 THEN 'signal_type: empty' END, CASE WHEN len(signal) > 0 THEN 'signal_type: value' END, 'asset_class: value', 'universe: missing'], lambda x: x IS NOT NULL), '|') AS errors FROM rec",
    "e4_stats": "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang",
    "e5_distinct": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events",
    "s11_summary": f"WITH {REC}, m AS (SELECT user_id, count(*) AS n, coalesce(arg_min(event_type || '=' || value || unit, event_id) FILTER (contains(event_type, 'click')), arg_min(event_type || '=' || value || unit, event_id)) AS s FROM ev GROUP BY user_id) SELECT paper_id, title, array_to_string(signal, ';') AS signal_type, n AS num_performance_metrics, s AS sample_metric FROM rec JOIN m USING (user_id)",
}
