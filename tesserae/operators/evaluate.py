"""Retrieval metrics from the side of the queries: a query without a hit, or without gold, counts as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_query(queries: DataFrame, results: DataFrame, gold: DataFrame, depth: int = 10) -> DataFrame:
    """``query_id``, ``first`` (rank of the first gold document within ``depth``), ``found``, ``n_gold``."""
    n_gold = gold.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = results.where(F.col("rank") <= depth).join(gold.distinct(), ["query_id", "doc"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.countDistinct("doc").alias("found"))
    out = queries.select("query_id").join(n_gold, "query_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", "first", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"))


def _metrics() -> list:
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return [
        F.round(hit(5), 6).alias("hit_at_5"), F.round(hit(10), 6).alias("hit_at_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr_at_10"),
        F.round(F.avg(F.col("found") / F.greatest("n_gold", F.lit(1))), 6).alias("recall_at_10"), F.count(F.lit(1)).alias("n_queries"), F.count(F.when(F.col("n_gold") > 0, 1)).alias("n_with_gold"),
    ]


def summary(per_query: DataFrame) -> DataFrame:
    """Hit rates at 5 and 10, mean reciprocal rank, recall (share of the gold found), and how many queries have gold."""
    return per_query.agg(*_metrics())


def grid(configs: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """The summary of each configuration (``queries``, ``results``, ``gold``)."""
    rows = None
    for name, parts in configs.items():
        one = by_query(*parts).withColumn("config", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("config").agg(*_metrics())


def ablation(results: DataFrame, baseline: str, variants: list[str]) -> DataFrame:
    """Each variant beside the baseline, with the differences."""
    columns = ("hit_at_5", "mrr_at_10")
    side = lambda name: results.select(F.col("config").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    both = side("baseline").where(F.col("baseline") == baseline).crossJoin(side("variant").where(F.col("variant").isin(variants)))
    return both.select("baseline", "variant", *(F.col(x) for c in columns for x in (f"baseline_{c}", f"variant_{c}")), *(F.round(F.col(f"variant_{c}") - F.col(f"baseline_{c}"), 6).alias(f"delta_{c}") for c in columns))
