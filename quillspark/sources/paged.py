"""Pages of a web service as a source: spark.read.format("paged") and spark.readStream.format("paged").

A page is JSON with a list of records under ``data`` and, if it isn't the last, the address of the next one under
``next_page``. With the option ``pages`` (how many there are) and ``{page}`` in ``url`` each page is a
partition and pages are read side by side; else one task follows the addresses. Pages are asked for ``delay``
seconds apart within a task; one that is refused for now (429 or a server's fault) is asked for again, ``retries``
times, after ``backoff`` seconds that double each time.

As a stream, the offset is the number of pages read; a micro-batch takes up to ``most`` new pages, and a page that
is not there yet (404, or no records) ends it. A batch that is run again reads the same pages.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PagedStream(dict(self.options))


class _Pages:
    def __init__(self, options: dict):
        self.url = options["url"]
        self.pages = int(options.get("pages", 0))
        self.retries, self.most = int(options.get("retries", 3)), int(options.get("most", 10))
        self.delay, self.backoff = float(options.get("delay", 0.15)), float(options.get("backoff", 30))
        self.agent = options.get("agent", "quillspark")
        self.asked = False

    def page(self, url: str) -> dict | None:
        """A page, or None if there is none."""
        for turn in range(self.retries + 1):
            if self.asked:
                time.sleep(self.delay)
            self.asked = True
            try:
                with urlopen(Request(url, headers={"User-Agent": self.agent, "Accept": "application/json"})) as found:
                    return json.loads(found.read())
            except HTTPError as fault:
                if fault.code == 404:
                    return None
                if turn == self.retries or fault.code != 429 and fault.code < 500:
                    raise
            except URLError:
                if turn == self.retries:
                    raise
            time.sleep(self.backoff * 2**turn)
        return None

    def numbered(self, page: int) -> dict | None:
        return self.page(self.url.replace("{page}", str(page)))


def _rows(page: int, found: dict | None) -> Iterator[tuple[int, str]]:
    for record in (found or {}).get("data", []):
        yield page, json.dumps(record, sort_keys=True, ensure_ascii=False)


class _PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, self.pages + 1)] if self.pages else [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        if partition.value:
            yield from _rows(partition.value, self.numbered(partition.value))
            return
        url, page = self.url.replace("{page}", "1"), 1
        while url:
            found = self.page(url)
            yield from _rows(page, found)
            url, page = (found or {}).get("next_page"), page + 1


class _PagedStream(_Pages, SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"pages": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        rows, at = [], start["pages"]
        while at < start["pages"] + self.most and (new := list(_rows(at + 1, self.numbered(at + 1)))):
            rows += new
            at += 1
        return iter(rows), {"pages": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        for page in range(start["pages"] + 1, end["pages"] + 1):
            yield from _rows(page, self.numbered(page))
