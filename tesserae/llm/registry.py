"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = (
    "quality_rules",
    "bpe",
    "packing",
    "licenses",
    "warc",
    "quality_model",
    "near_dedup",
    "language_model",
    "fingerprints",
    "substring_dedup",
    "divergence",
    "url_filter",
)


def _all(name: str) -> dict:
    modules = [*(f"tesserae.llm.{m}" for m in MODULES), "corpus_pipeline"]
    return {k: v for module in modules for k, v in getattr(import_module(module), name).items()}


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
