"""A source of daily bars that come in pages, by symbol: `spark.read.format("paged_bars")`.

Symbols are dealt into batches, a partition each, so that batches are fetched side by side and a lost task fetches
its own batch again. A fetcher is asked for one page after the other until it says that there is none; a page that
fails is asked for again, a bounded number of times with growing waits. Filters on symbols drop symbols before
batches are made, and so whole partitions; filters on days go to the fetcher and are applied to what it returns.

Options: `path` (root of the pages), `symbols` (comma-separated; else those under the root), `batch` (symbols to a
partition), `tries`, `wait` (seconds before the second try), `fetcher` (module:function, called with root, symbol, first
day, last day and page number; returns rows (day, open, high, low, close, volume) and whether more pages follow).
The pages of the default fetcher are JSON lines under `root/symbol=S/page=N/`, as Spark writes them."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import time
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, d date, open double, high double, low double, close double, volume double"
Row = tuple[dt.date, float, float, float, float, float]


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def symbols_under(root: str) -> list[str]:
    """Symbols that have pages."""
    from pyarrow import fs

    system, path = _files(root)
    return sorted(unquote(x.base_name.removeprefix("symbol=")) for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("symbol="))


def json_pages(root: str, symbol: str, first: dt.date | None, last: dt.date | None, page: int) -> tuple[list[Row], bool]:
    """A page from JSON lines; more follow while there is a folder of the next number."""
    from pyarrow import fs

    system, path = _files(root)
    folder = f"{path}/symbol={quote(symbol, safe=' ')}"
    rows = []
    for info in sorted(system.get_file_info(fs.FileSelector(f"{folder}/page={page}", allow_not_found=True)), key=lambda x: x.path):
        if info.base_name.endswith(".json"):
            for line in system.open_input_stream(info.path).read().splitlines():
                x = json.loads(line)
                rows.append((dt.date.fromisoformat(x["d"]), *(x.get(c) for c in ("open", "high", "low", "close", "volume"))))
    more = system.get_file_info(f"{folder}/page={page + 1}").type == fs.FileType.Directory
    return rows, more


class Batch(InputPartition):
    def __init__(self, symbols: list[str]):
        self.symbols = symbols


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.batch = options["path"], int(options.get("batch", 10))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1.0))
        module, name = options.get("fetcher", "quantloom.sources.paged:json_pages").split(":")
        self.fetch = getattr(importlib.import_module(module), name)
        listed = options.get("symbols")
        self.symbols = [x.strip() for x in listed.split(",") if x.strip()] if listed is not None else symbols_under(self.root)
        self.first: dt.date | None = None
        self.last: dt.date | None = None
        if self.batch < 1 or self.tries < 1:
            raise ValueError("batch and tries are 1 at least")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes those on symbol and day; Spark applies the others."""
        day = dt.timedelta(days=1)
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name == "symbol" and isinstance(f, EqualTo):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif name == "symbol" and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in set(f.value)]
            elif name == "d" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)):
                low = f.value + day if isinstance(f, GreaterThan) else f.value
                high = f.value - day if isinstance(f, LessThan) else f.value
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = low if self.first is None else max(self.first, low)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = high if self.last is None else min(self.last, high)
            else:
                yield f

    def partitions(self) -> list[Batch]:
        return [Batch(self.symbols[a : a + self.batch]) for a in range(0, len(self.symbols), self.batch)] or [Batch([])]

    def _page(self, symbol: str, page: int) -> tuple[list[Row], bool]:
        for k in range(self.tries):
            try:
                return self.fetch(self.root, symbol, self.first, self.last, page)
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError

    def read(self, partition: Batch) -> Iterator[tuple]:
        for symbol in partition.symbols:
            page, more = 0, True
            while more:
                rows, more = self._page(symbol, page)
                page += 1
                yield from ((symbol, *r) for r in rows if (self.first is None or r[0] >= self.first) and (self.last is None or r[0] <= self.last))


class PagedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """The format's name in this session. Spark hands filters to Python sources only where it is told to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedBars)
