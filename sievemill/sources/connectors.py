"""Connector interface: providers land their responses as files; a Python data source reads such landed pages page by page.

Live HTTP is out of scope. The registry holds what a search run needs to know about a source.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class SourceProfile:
    name: str
    target: int
    timeout_s: int
    enabled: bool = True


# Targets and time limits of the sources.
PROFILES = (
    SourceProfile("relevance", 4000, 150), SourceProfile("biomedical", 2000, 150), SourceProfile("open_catalogue", 1500, 150, enabled=False), SourceProfile("european", 2000, 150),
)


class LandedPages(DataSource):
    """format("landed_pages"): JSON pages {"query", "page", "records": [...]} under option ``path``, one partition a page."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "query string, page int, position int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"])


class _PageReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(f"{self.path}/*.json"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value, encoding="utf-8") as f:
            page = json.load(f)
        for i, r in enumerate(page.get("records") or []):
            yield page.get("query"), page.get("page"), i, json.dumps(r, ensure_ascii=False)
