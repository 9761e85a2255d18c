"""A news-feed source on the Python Data Source API: RSS files of a directory, as a batch or a stream."""

from __future__ import annotations

import hashlib
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, title string, content string, source string, date timestamp, url string"


def parse_feed(xml: str, source: str, now: datetime | None = None) -> list[tuple]:
    """Rows of a feed; entries without a link are dropped, content falls back to the title, a date to now; a broken feed has none."""
    now = now or datetime.now(timezone.utc)
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    rows = []
    for item in root.iter("item"):
        get = lambda tag: (item.findtext(tag) or "").strip()  # noqa: B023, E731
        if not (url := get("link")):
            continue
        try:
            date = parsedate_to_datetime(get("pubDate"))
            date = date if date.tzinfo else date.replace(tzinfo=timezone.utc)
        except (TypeError, ValueError):
            date = now
        title = get("title")
        rows.append((hashlib.md5(url.encode()).hexdigest(), title, get("description") or title, source, date, url))
    return rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _read(path: str) -> Iterator[tuple]:
    try:
        with open(path, encoding="utf-8") as f:
            yield from parse_feed(f.read(), os.path.splitext(os.path.basename(path))[0])
    except OSError:
        return


class FeedSource(DataSource):
    """``spark.dataSource.register(FeedSource)``; then ``format("feed").option("path", dir)``."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedStream(self.options["path"])


class FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".xml")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(partition.path)


class FeedStream(SimpleDataSourceStreamReader):
    """The offset is the last file name read; files are taken in the order of their names."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def _names(self, after: str, to: str | None = None) -> list[str]:
        return [n for n in sorted(os.listdir(self.path)) if n.endswith(".xml") and n > after and (to is None or n <= to)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        names = self._names(start["after"])
        rows = [r for n in names for r in _read(os.path.join(self.path, n))]
        return iter(rows), {"after": names[-1] if names else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for n in self._names(start["after"], end["after"]) for r in _read(os.path.join(self.path, n))])
