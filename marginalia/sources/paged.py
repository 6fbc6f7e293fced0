"""Paged JSON listings as a data source: `spark.read.format("paged_json")`, and as a stream of new pages.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("listings", "https://a.org/posts?page={page}\\nhttps://b.org/posts?page={page}").load()

Every listing is a partition, as its pages have to be read in order: one after the other, until a page can't be read, is no list or holds
fewer entries than a full page, or `empty` pages in a row bring no new link, or `pages` pages were read.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from urllib.error import URLError

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "listing string, page int, position int, link string, entry string"
PAGES, FULL, EMPTY = 5, 20, 2
Row = tuple[str, int, int, str, str]


class Listing(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class Settings:
    """The options: listings (addresses with {page}, one a line), pages, full (entries of a full page, 0 where pages aren't filled), empty, field (of an entry's link), timeout (seconds)."""

    def __init__(self, options: dict[str, str]):
        self.listings = [u.strip() for u in options.get("listings", "").splitlines() if u.strip()]
        if not self.listings:
            raise ValueError("option listings: one address a line, with {page} for the page's number")
        self.pages, self.full, self.empty = (int(options.get(k, v)) for k, v in (("pages", PAGES), ("full", FULL), ("empty", EMPTY)))
        self.field, self.timeout = options.get("field", "link"), float(options.get("timeout", 30))

    def page(self, listing: str, number: int) -> list | None:
        """The entries of a page; None if it can't be read or isn't a list."""
        try:
            with urllib.request.urlopen(listing.replace("{page}", str(number)), timeout=self.timeout) as answer:
                found = json.loads(answer.read())
        except (URLError, OSError, ValueError):
            return None
        return found if isinstance(found, list) else None

    def rows(self, listing: str, number: int, entries: list) -> Iterator[Row]:
        """The entries with a web address as their link."""
        for position, entry in enumerate(entries):
            link = entry.get(self.field) if isinstance(entry, dict) else None
            if isinstance(link, str) and link.startswith("http"):
                yield listing, number, position, link, json.dumps(entry, ensure_ascii=False, sort_keys=True)


class PagedReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Listing]:
        return [Listing(u) for u in self.settings.listings]

    def read(self, partition: Listing) -> Iterator[Row]:
        s, dry, seen = self.settings, 0, set()
        for number in range(1, s.pages + 1):
            entries = s.page(partition.url, number)
            if entries is None:
                return
            fresh = 0
            for row in s.rows(partition.url, number, entries):
                if row[3] not in seen:
                    seen.add(row[3])
                    fresh += 1
                    yield row
            dry = 0 if fresh else dry + 1
            if dry >= s.empty or not entries or len(entries) < s.full:
                return


class PagedStream(SimpleDataSourceStreamReader):
    """Each listing's next pages, as they appear: the offset is the next page to read of each. A page is read once it is full (or at once, with full = 0), so that no entry is missed."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {u: 1 for u in self.settings.listings}

    def _next(self, start: dict, end: dict | None) -> tuple[list[Row], dict]:
        s, rows, after = self.settings, [], dict(start)
        for url in s.listings:
            number = start.get(url, 1)
            while number < end.get(url, 1) if end is not None else number < start.get(url, 1) + s.pages:
                entries = s.page(url, number)
                if end is None and (not entries or len(entries) < s.full):
                    break
                rows += s.rows(url, number, entries or [])
                number += 1
            after[url] = number
        return rows, after

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        rows, after = self._next(start, None)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:
        """The same pages again, after a failure."""
        return iter(self._next(start, end)[0])


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(Settings(self.options))

    def simpleStreamReader(self, schema) -> PagedStream:
        return PagedStream(Settings(self.options))
