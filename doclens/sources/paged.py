"""A paginated HTTP row source as a Python data source (S9, S10, S13, R1, R4): one partition a page, rows as JSON strings.

Options: url (with {offset} and {length}), page (100), timeout (30). Pages hold {"rows": [{"row": {...}}, ...]}.

As a batch, `total` says how many rows there are. As a stream, the offset is a row number, kept in the query's checkpoint: a
batch takes the next `pages_per_batch` pages (1), never beyond `limit` rows, and no more than `pages_per_second` allows (any
number, if it is not given). Before a batch its first and last rows are asked for: without the first there is nothing new, now;
without the last the end is sought by halves and the batch ends there, so rows that come later are read later. Only the
driver decides on offsets; a page is read in a task, and again if the task is run again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import URLError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 30))
        self.total, self.page = int(options["total"]), int(options.get("page", 100))

    def partitions(self):
        return [Page(at, min(self.page, self.total - at)) for at in range(0, self.total, self.page)]

    def read(self, partition):
        yield from _page(self.url, partition.offset, partition.length, self.timeout)


def _page(url: str, offset: int, length: int, timeout: float) -> Iterator[tuple[int, str]]:
    with urlopen(url.format(offset=offset, length=length), timeout=timeout) as answer:
        for k, item in enumerate(json.load(answer).get("rows", [])[:length]):
            yield offset + k, json.dumps(item.get("row", item))


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 30))
        self.page, self.pages = int(options.get("page", 100)), int(options.get("pages_per_batch", 1))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.rate = float(options["pages_per_second"]) if "pages_per_second" in options else None
        self.at: int | None = None  # where the last planned batch ended
        self.since, self.taken = time.monotonic(), 0

    def initialOffset(self):
        return {"row": 0}

    def latestOffset(self):
        at = self.at or 0
        pages = self.pages if self.rate is None else min(self.pages, 1 + int((time.monotonic() - self.since) * self.rate) - self.taken)
        end = at + max(0, pages) * self.page
        end = end if self.limit is None else min(end, self.limit)
        if end > at and self._there(at):
            if not self._there(end - 1):  # the rows end within the batch: so does the batch
                there, beyond = at, end - 1
                while beyond - there > 1:
                    middle = (there + beyond) // 2
                    there, beyond = (middle, beyond) if self._there(middle) else (there, middle)
                end = beyond
            self.taken += -(-(end - at) // self.page)
            self.at = end
        return {"row": self.at or 0}

    def _there(self, row: int) -> bool:
        try:
            return next(_page(self.url, row, 1, self.timeout), None) is not None
        except URLError:  # beyond the end, or not to be reached now: asked again with the next trigger
            return False

    def partitions(self, start, end):
        """The pages of a batch. After a restart the last batch of the checkpoint is planned first, which says where to go on."""
        self.at = max(self.at or 0, end["row"])
        return [Page(at, min(self.page, end["row"] - at)) for at in range(start["row"], end["row"], self.page)]

    def read(self, partition):
        yield from _page(self.url, partition.offset, partition.length, self.timeout)


class PagedRows(DataSource):
    @classmethod
    def name(cls):
        return "paged_rows"

    def schema(self):
        return "row_number long, row string"

    def reader(self, schema):
        return PagedReader(self.options)

    def streamReader(self, schema):
        return PagedStreamReader(self.options)
