"""A corpus pipeline: quality rules, quality classifier, near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes what a stage returns to the shared folder and hands it to the next.

Rows with null identifiers pass through the stages that compare documents. Of repeated rows of a document near-dedup
leaves one, that with the least text. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import near_dedup, packing, quality_model, quality_rules, substring_dedup
from tesserae.llm.shared import bound_batches, materialise, sieved, table

#: Near duplicates share at least this percentage of their five-word shingles.
NEAR_PERCENT = 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do boilerplate lines of the others."""
    bound_batches(spark)
    return quality_rules.accepted(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones among them, rejects go."""
    forest = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.quality_scores(docs, forest, tuple(docs.columns))
    return scored.where(F.col("score") >= quality_model.THRESHOLD).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest identifier."""
    found = materialise(near_dedup.near_duplicates(docs, percent=NEAR_PERCENT))
    gone = materialise(found.where("not kept").select("doc_id").distinct())
    # only documents that may be gone, or that come more than once, move
    maybe, rest = sieved(docs, F.col("doc_id"), gone, "doc_id")
    rest = rest.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))
    again = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    rest = materialise(rest)
    row = F.struct(*docs.columns)
    one = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text"), F.to_json(row))).alias("r")).select("r.*")
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; so do documents of which no word is left."""
    cut = substring_dedup.substring_dedup(docs)
    cut = cut.where(F.col("removed").isNull() | F.col("text").rlike(quality_rules.WORD)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-dedup", near), ("substring dedup", substrings), ("packing", packed)]
#: Trees, components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
