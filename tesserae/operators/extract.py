"""Facts from papers through a pluggable extractor, checked against their source; failures stay rows of their own."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import count_words
from tesserae.operators import chunking, incremental, validate
from tesserae.operators.answer import DayQuota, with_retries
from tesserae.schemas import EXTRACTION
from tesserae.sources import files

_REPORTED = re.compile(r"reported (\w+) of (-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)(%?)")


#: Papers whose results a task holds at once.
AT_ONCE = 64


def extract_standin(text: str) -> dict:
    """A rule-based stand-in for a model: sentences like 'reported x of 1.5%' as metrics. Not comparable with a model."""
    metrics = [
        {"metric_name": m[1], "value": float(m[2]), "unit": "percent" if m[3] else "ratio", "context": "", "evidence_quote": m[0], "source_location": ""}
        for m in _REPORTED.finditer(text)
    ]
    return {"signal_type": ["other"], "asset_class": ["other"], "methodology_summary": "", "data_period": "not reported", "universe": "not reported", "performance_metrics": metrics, "key_findings": [], "limitations": [], "extraction_confidence": "low", "extraction_notes": ""}


def extracted(sources: DataFrame, extractor: Callable[[str], dict], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``paper_id``, ``extraction``, ``error``, ``stop`` for each of ``sources`` (``paper_id``, ``source``). A failure is a
    row with ``error``; once the day's quota is spent (``stop``), a task asks no more."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = None
        for pdf in frames:
            for at in range(0, len(pdf), AT_ONCE):
                part, rows = pdf.iloc[at : at + AT_ONCE], []
                for paper, text in zip(part["paper_id"], part["source"], strict=True):
                    made, error = None, spent
                    if not spent:
                        try:
                            made = with_retries(lambda: extractor(text or ""), tries, sleep=sleep)  # noqa: B023
                        except DayQuota as e:
                            error = spent = f"DayQuota: {e}"
                        except Exception as e:  # noqa: BLE001 - one paper's failure is a row
                            error = f"{type(e).__name__}: {e.__cause__ or e}"
                    rows.append((paper, made, error, spent is not None))
                yield pd.DataFrame(rows, columns=["paper_id", "extraction", "error", "stop"])

    return sources.select("paper_id", "source").mapInPandas(run, f"paper_id string, extraction {EXTRACTION}, error string, stop boolean")


def process_papers(papers: DataFrame, extractor: Callable[[str], dict], tags: DataFrame, model: str, at: str | None = None, count=count_words, **options) -> DataFrame:
    """Records (``paper_id``, ``title``, ``extraction``, ``extraction_meta``) of parsed papers, with ``error`` and ``stop``.
    ``tags``: curated ones, ``paper_id`` and two arrays; ``at``: the time to note, now if left out."""
    sources = chunking.paper_text(papers)
    made = extracted(sources, extractor, **options)
    rows = made.join(papers.select("paper_id", "title"), "paper_id").join(sources.select("paper_id", count(F.col("source")).cast("long").alias("_n")), "paper_id")
    flagged = validate.validate(rows, sources, tags)
    known = tags.select("paper_id", F.col("signal_type").alias("_s"), F.col("asset_class").alias("_a"))
    empty = F.array().cast("array<string>")
    meta = F.struct(
        F.lit(model).alias("model"), F.lit(at or datetime.now(timezone.utc).isoformat()).alias("extracted_at"), F.col("_n").alias("input_tokens"), F.coalesce("new_flags", empty).alias("validation_flags"),
        F.coalesce("_s", empty).alias("curation_signal_type"), F.coalesce("_a", empty).alias("curation_asset_class"), F.lit(False).alias("manually_corrected"),
    )
    told = F.when(F.col("error").isNull(), meta)
    return flagged.join(known, "paper_id", "left").select("paper_id", "title", "extraction", told.alias("extraction_meta"), "error", "stop")


def run_extraction(papers: DataFrame, done: DataFrame, path: str, extractor: Callable[[str], dict], tags: DataFrame, model: str, size: int = 1000, force: bool = False, **options) -> list[dict]:
    """Extracts what is still to do, in batches of about ``size`` papers; each batch's records and failures are written
    below ``path`` before the next begins, and a spent quota ends the run. Returns how many worked and failed in each."""
    todo = incremental.pending(papers, done, "paper_id", force)

    def batch(rows: DataFrame) -> dict:
        made = process_papers(rows, extractor, tags, model, **options)
        folder = f"{path}/all-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
        made.write.parquet(folder)  # models are asked once
        made = rows.sparkSession.read.schema(made.schema).parquet(folder)
        good, failed = files.split_failures(made)
        good.drop("stop").write.mode("append").json(f"{path}/records")
        files.append_failures(failed.where("error not like 'DayQuota%'").select("paper_id", "error", "failed_at"), f"{path}/failed")
        told = made.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("ok"), F.count("error").alias("failed"), F.coalesce(F.max("stop"), F.lit(False)).alias("stop"))
        return told.head().asDict()

    return incremental.in_batches(todo, "paper_id", batch, size, lambda r: r["stop"])
