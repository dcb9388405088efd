"""A paged source with a last-seen id, as a Python data source for streams.

``path`` is a folder that driver and executors share, with JSON files named by number,
one a page, each with ``posts`` of (id, text) in ascending ids; it stands in for a
service that is asked for posts since an id. Pages may overlap, as they do where posts
come while a client pages: a post counts on the first page that has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class PagedPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return "id long, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


@dataclass
class _Page(InputPartition):
    number: int


class _Reader(DataSourceStreamReader):
    """The driver holds page numbers only; each page is read by a task of its own."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"page": -1}

    def _numbers(self) -> list[int]:
        return sorted(int(f.stem) for f in Path(self.path).glob("*.json") if f.stem.isdigit())

    def latestOffset(self) -> dict:
        return {"page": max(self._numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(n) for n in self._numbers() if start["page"] < n <= end["page"]]

    def _posts(self, number: int) -> list[tuple[int, str]]:
        page = json.loads((Path(self.path) / f"{number}.json").read_text())
        return [(int(p["id"]), p["text"]) for p in page["posts"]]

    def read(self, partition: _Page) -> Iterator[tuple[int, str]]:
        """The page's posts that the page before hasn't; a page that only repeats it is a loop and ends the query."""
        posts, before = self._posts(partition.number), max((n for n in self._numbers() if n < partition.number), default=None)
        since = max((i for i, _ in self._posts(before)), default=-1) if before is not None else -1
        if posts and before is not None and max(i for i, _ in posts) <= since:
            raise ValueError(f"page {partition.number} does not get past id {since}")
        yield from sorted({p for p in posts if p[0] > since})
