"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules of this folder with ``QUERIES`` and ``ORACLES``.
MODULES: tuple[str, ...] = ("search", "facts", "documents", "jobs")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        more = getattr(import_module(f"tesserae.plans.{module}"), name)
        if clash := found.keys() & more.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= more
    return found


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
