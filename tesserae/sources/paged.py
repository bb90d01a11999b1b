"""A paged listing as a data source: a partition for each page, fetched by a pluggable function.

``spark.dataSource.register(PagedListing)``, then ``spark.read.format("paged_listing")`` with the options ``fetch``
(``module:function``; called with query, first entry and page size, returns a list of dicts), ``query``, ``max``,
``page_size`` and ``retries``. Nothing here uses the network; ``replay`` answers from pages that were fetched before.

A page that fails after all tries is one row with ``error`` and its number, and does not stop the others. A page beyond
the last entry is empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("entry_id", "title", "authors", "published", "updated", "categories", "primary_category", "pdf_url", "abstract")
SCHEMA = "page int, pos int, entry_id string, title string, authors array<string>, published string, updated string, categories array<string>, primary_category string, pdf_url string, abstract string, error string"
PAGE, TRIES, MOST = 100, 5, 150


def replay(folder: str, first: int, size: int) -> list[dict]:
    """Entries ``first`` on of a listing whose pages lie in ``folder`` (a URI) as ``page-<first>.json``."""
    store, path = fs.FileSystem.from_uri(folder)
    name = f"{path.rstrip('/')}/page-{first}.json"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(name) as f:
        return json.loads(f.read())[:size]


class Page(InputPartition):
    def __init__(self, number: int, first: int, size: int):
        self.number, self.first, self.size = number, first, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.query = options["fetch"], options.get("query", "")
        self.most, self.size, self.tries = (int(options.get(k, d)) for k, d in (("max", MOST), ("page_size", PAGE), ("retries", TRIES)))

    def partitions(self) -> list[Page]:
        return [Page(i, first, min(self.size, self.most - first)) for i, first in enumerate(range(0, self.most, self.size))]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        call, error = getattr(import_module(module), name), None
        for _ in range(self.tries):
            try:
                entries = call(self.query, partition.first, partition.size)
            except Exception as e:  # noqa: BLE001 - whatever failed may work the next time
                error = f"{type(e).__name__}: {e}"
                continue
            for pos, x in enumerate(entries):
                yield (partition.number, partition.first + pos, *(x.get(f) for f in FIELDS), None)
            return
        yield (partition.number, None, *(None for _ in FIELDS), error)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
