"""Sources and sinks over whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.functions.text import category_query, short_id


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def jsonl(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """Lines of JSON; blank lines are skipped. A missing file is an error unless ``optional``: then it has no rows."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their relevant papers; of a repeated identifier each line is a question."""
    return jsonl(spark, path, schemas.EVAL_QUERIES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per file, with ``file_name`` as the corpus order; files whose name starts with ``_`` are none."""
    rows = spark.read.schema(schemas.RECORDS).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file_name", F.col("_metadata.file_name")).where(~F.startswith("file_name", F.lit("_")))


def parsed_papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PARSED).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def listing(entries: DataFrame) -> DataFrame:
    """Entries of a paper listing (``entry_id, title, authors, published, updated, categories, primary_category, pdf_url,
    abstract``; times as timestamps) as papers."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    key = short_id(F.col("entry_id"))
    return entries.select(
        F.concat(F.lit("arxiv:"), key).alias("paper_id"), F.trim("title").alias("title"), "authors", iso("published").alias("published"), iso("updated").alias("updated"), "categories", "primary_category",
        F.col("entry_id").alias("url"), "pdf_url", F.trim("abstract").alias("abstract"), F.concat(F.translate(key, "/", "_"), F.lit(".pdf")).alias("pdf_path"),
    )


def staged_listing(spark: SparkSession, path: str, categories: list[str], terms: str | None = None, most: int | None = 150) -> DataFrame:
    """A paged listing that was fetched to files, newest first. Offline: the query is only recorded (``query``)."""
    rows = spark.read.schema("entry_id string, title string, authors array<string>, published timestamp, updated timestamp, categories array<string>, primary_category string, pdf_url string, abstract string").json(path)
    rows = rows.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    rows = rows.orderBy(F.desc("published"), "entry_id")
    rows = rows.limit(most) if most else rows
    return listing(rows).withColumn("query", category_query(F.array(*map(F.lit, categories)), F.lit(terms)))


def fetched_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files fetched before, as ``path`` and ``content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_parsed(papers: DataFrame, path: str) -> None:
    """Parsed papers by identifier, ready for pruned reads."""
    papers.withColumn("paper", F.col("paper_id")).write.mode("overwrite").partitionBy("paper").parquet(path)


def write_index(vectors: DataFrame, path: str, model: str, dim: int) -> None:
    """Vectors with their own keys, and one row that tells how they were made."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    info = vectors.agg(F.count(F.lit(1)).alias("num_vectors")).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "num_vectors")
    info.coalesce(1).write.mode("overwrite").json(f"{path}/info")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.json(f"{path}/info")


def summary_lines(rows: DataFrame) -> DataFrame:
    """The nine columns of the summary table, ordered by file."""
    e, meta = F.col("extraction"), F.col("extraction_meta.validation_flags")
    metrics, empty = e["performance_metrics"], F.array().cast("array<string>")
    sample = F.coalesce(F.get(F.filter(metrics, lambda m: F.contains(F.lower(m["metric_name"]), F.lit("sharpe"))), F.lit(0)), F.get(metrics, F.lit(0)))
    return rows.orderBy("file_name").select(
        "paper_id", "title", F.array_join(F.coalesce(e["signal_type"], empty), ";").alias("signal_type"), F.array_join(F.coalesce(e["asset_class"], empty), ";").alias("asset_class"), F.coalesce(F.size(metrics), F.lit(0)).alias("num_performance_metrics"),
        F.coalesce(F.concat(sample["metric_name"], F.lit("="), sample["value"].cast("string"), sample["unit"]), F.lit("")).alias("sample_metric"), F.coalesce(e["extraction_confidence"], F.lit("")).alias("extraction_confidence"), F.size(F.coalesce(meta, empty)).alias("num_validation_flags"), F.array_join(F.coalesce(meta, empty), ";").alias("validation_flags"),
    )


def write_summary(rows: DataFrame, path: str) -> None:
    summary_lines(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_eval(results: DataFrame, path: str, digits: int = 4) -> None:
    """Evaluation results with a fixed number of digits, as CSV and as a Markdown table."""
    shown = results.select(*(F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in results.dtypes))
    shown.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    lines = shown.select(F.concat(F.lit("| "), F.array_join(F.array(*shown.columns), " | "), F.lit(" |")).alias("value"))
    head = results.sparkSession.createDataFrame([("| " + " | ".join(shown.columns) + " |",), ("|" + "---|" * len(shown.columns),)], "value string")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(f"{path}/md")


def split_failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that worked, and a dead-letter table of the others with the time."""
    good = rows.where(F.col(error).isNull()).drop(error)
    return good, rows.where(F.col(error).isNotNull()).withColumn("failed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def append_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").json(path)
