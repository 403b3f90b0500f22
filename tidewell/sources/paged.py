"""A source for feeds that are read in pages, newest first, up to the last seen id.

    spark.dataSource.register(PagedPosts)
    spark.readStream.format("paged_posts").option("path", folder).load()

Pages are files of JSON lines as a fetcher lands them, in the order of their names, on any file system that Arrow reads
(a path or a URI that driver and executors share). A page whose first id is above all ids before it begins a poll; the
posts of a poll count down to what the poll before had seen, so of each page only ids above that are new. The driver
lists names and reads the first line of new pages; pages are parsed one a partition by the executors. An offset is the
last page and the greatest id so far: a restart continues after them, and pages that repeat old posts add nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id bigint, title string, published_at string, votes map<string,int>"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Page(InputPartition):
    """A page, and the greatest id that was known before its poll."""

    def __init__(self, folder: str, name: str, after: int):
        self.folder, self.name, self.after = folder, name, after


def _first_id(system: fs.FileSystem, path: str) -> int:
    with system.open_input_stream(path) as f:
        head = b""
        while b"\n" not in head.strip() and (more := f.read(1 << 16)):
            head += more
    line = head.strip().split(b"\n", 1)[0]
    return int(json.loads(line)["id"]) if line else -1


def new_pages(folder: str, start: dict) -> tuple[list[Page], dict]:
    """The pages after an offset, and the offset after them."""
    system, base = _open(folder)
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
    pages, after, seen, last = [], start["poll_after"], start["last_id"], start["page"]
    for name in names:
        if name > start["page"]:
            first = _first_id(system, f"{base}/{name}")
            if first > seen:
                after, seen = seen, first
            pages.append(Page(folder, name, after))
            last = name
    return pages, {"page": last, "last_id": seen, "poll_after": after}


def _posts(page: Page) -> Iterator[tuple]:
    system, base = _open(page.folder)
    with system.open_input_stream(f"{base}/{page.name}") as f:
        text = f.read().decode("utf-8")
    for line in text.split("\n"):
        if line.strip():
            p = json.loads(line)
            if p["id"] > page.after:
                yield p["id"], p.get("title"), p.get("published_at"), p.get("votes") or {}


_START = {"page": "", "last_id": -1, "poll_after": -1}


class PagedPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return new_pages(self.path, _START)[0] or [Page(self.path, "", -1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.name:
            yield from _posts(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.at = _START

    def initialOffset(self) -> dict:
        return _START

    def latestOffset(self) -> dict:
        self.at = new_pages(self.path, self.at)[1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for p in new_pages(self.path, start)[0] if p.name <= end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _posts(partition)
