"""Paginated listings as a batch and a streaming source.

A listing is a folder ``scope=<name>`` of pages ``page=<name>``, each a JSON document
{"items": [{"id", "created", "title"}, ...], "after": <name of the next page>} with the newest items
first. Pages are read through Arrow's file systems (local mounts, HDFS, S3 and others by their URI).
"""

from __future__ import annotations

import bisect
import itertools
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Items older than any.
NOTHING = -1


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI (``file:/x`` as Hadoop writes it, too) and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """A file that appears at once."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path + ".part") as out:
        out.write(data)
    fs.move(path + ".part", path)


@dataclass(frozen=True)
class Walk:
    """A way down a listing: the items above the floor, whether all pages came, and whether the budget ended it."""

    items: list[dict]
    ok: bool
    capped: bool

    @property
    def complete(self) -> bool:
        return self.ok and not self.capped


class Listing:
    """The pages of all scopes under a folder. A page that does not come is asked for again ``retries`` times, longer apart each time."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.first = options.get("first", "page0")
        self.retries, self.wait = int(options.get("retries", 2)), float(options.get("retry_seconds", 0.1))
        self.chosen = [s for s in options.get("scopes", "").split(",") if s]

    def scopes(self) -> list[str]:
        if self.chosen:
            return self.chosen
        fs, path = file_system(self.root)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name.removeprefix("scope=") for f in found if f.base_name.startswith("scope="))

    def page(self, scope: str, name: str) -> dict | None:
        for attempt in range(self.retries + 1):
            try:
                fs, path = file_system(f"{self.root}/scope={scope}/page={name}")
                files = [f for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name[0] not in "_."]
                with fs.open_input_stream(files[0].path, compression=None) as f:
                    return json.loads(f.read())
            except (OSError, ValueError, IndexError):
                if attempt < self.retries:
                    time.sleep(self.wait * 2**attempt)
        return None

    def pages(self, scope: str, floor: int, max_pages: int | None, name: str | None = None) -> Iterator[tuple[str, list[dict] | None]]:
        """Each page's name and its items newer than the floor, from a page (the first if unset) down to the floor or to the listing's end.

        A page that does not come gives None, a spent budget an empty name; both end the way.
        """
        name, read = name or self.first, 0
        while name:
            if read == max_pages:
                yield "", None
                return
            page = self.page(scope, name)
            if page is None:
                yield name, None
                return
            read += 1
            got = page.get("items") or []
            yield name, [i for i in got if int(i["created"]) > floor]
            if any(int(i["created"]) <= floor for i in got):
                return
            name = page.get("after")

    def walk(self, scope: str, floor: int, max_pages: int | None) -> Walk:
        """Items newer than the floor, down to it or to the listing's end, over at most ``max_pages`` pages."""
        items = []
        for name, got in self.pages(scope, floor, max_pages):
            if got is None:
                return Walk(items, not name, not name)
            items += got
        return Walk(items, True, False)


class ListingPages(DataSource):
    """``spark.read`` and ``spark.readStream`` format ``listing_pages``.

    Options: path; scopes (names by commas; all folders if unset); first (the first page's name);
    max_pages (a walk's budget); retries, retry_seconds; for batches until (items not newer are
    left out); for streams progress (a file of the stream's own, needed to go on after a restart)
    and max_rows (what one micro-batch admits).

    Columns: scope, id, created, title, complete (the walk came to its floor or the listing's end).
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "scope string, id string, created long, title string, complete boolean"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def _pages(options: dict) -> int | None:
    return int(options["max_pages"]) if "max_pages" in options else None


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in Listing(self.options).scopes()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        walk = Listing(self.options).walk(partition.value, int(self.options.get("until", NOTHING)), _pages(self.options))
        for i in walk.items:
            yield partition.value, i["id"], int(i["created"]), i.get("title"), walk.complete


class _StreamReader(DataSourceStreamReader):
    """The offset is each scope's watermark: the newest item up to which everything was read.

    It moves only over a complete walk; after a lost page or a spent budget a scope stays where it
    was and is walked again, while the others go on. A micro-batch holds the items between two
    offsets, which a listing that only grows gives again after any failure. What a walk found and could
    not admit is remembered by its times (8 bytes an item), so the next walk ends at the newest item seen, and by
    pages, so a micro-batch is read from the page that holds its newest item; a listing that has changed
    otherwise, or a restart, is walked from its first page. The offsets given out
    are kept in ``progress`` before Spark sees them, as Spark does not tell a restarted source
    where it stopped; an offset that Spark never logged is covered by its own older one.
    """

    def __init__(self, options: dict):
        self.options, self.listing = options, Listing(options)
        self.floors: dict[str, int] | None = None
        #: By scope: the times of what waits, oldest first, and from each page of the way down its name and the newest time in it.
        self.waiting: dict[str, np.ndarray] = {}
        self.places: dict[str, list[tuple[str, int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.floors is None:
            self.floors = self._kept()
        with ThreadPoolExecutor(16) as pool:
            walks = dict(zip(names := self.listing.scopes(), pool.map(self._times, names), strict=True))
        left = int(self.options["max_rows"]) if "max_rows" in self.options else None
        now = dict(self.floors)
        # Who is furthest behind comes first where not all can be admitted.
        for scope in sorted(walks, key=lambda s: (self.floors.get(s, NOTHING), s)):
            times = walks[scope]
            if not len(times) or left == 0:
                now.setdefault(scope, NOTHING)
                continue
            if left is not None and len(times) > left:
                times = times[: np.searchsorted(times, times[left - 1], "right")]
            now[scope] = int(times[-1])
            left = None if left is None else max(0, left - len(times))
        if now != self.floors and "progress" in self.options:
            write_whole(self.options["progress"], json.dumps(now).encode())
        self.floors = now
        return now

    def _times(self, scope: str) -> np.ndarray:
        """When the new items of a complete walk were made, oldest first; nothing if it was not complete."""
        floor, old = self.floors.get(scope, NOTHING), self.waiting.get(scope, np.zeros(0, np.int64))
        old = old[np.searchsorted(old, floor, "right") :]
        # Items as new as the newest seen may have come since.
        seen = int(old[-1]) - 1 if len(old) else floor
        found, places = [], []
        for name, items in self.listing.pages(scope, seen, _pages(self.options)):
            if items is None:
                self.waiting.pop(scope, None)
                return np.zeros(0, np.int64)
            if items:
                found.append(np.array([int(i["created"]) for i in items], np.int64))
                places.append((name, int(found[-1].max())))
        times = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        if len(old):
            times = np.concatenate([old[: np.searchsorted(old, seen, "right")], times])
        else:
            self.places[scope] = places
        self.waiting[scope] = times
        return times

    def _kept(self) -> dict[str, int]:
        if "progress" not in self.options:
            return {}
        fs, path = file_system(self.options["progress"])
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _place(self, scope: str, top: int) -> str | None:
        """The last page known whose first item is newer than a time: what is not newer begins there or below, however much came since."""
        names = self.places.get(scope, [])
        k = bisect.bisect_left(names, -top, key=lambda p: -p[1])
        return names[k - 1][0] if k else None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((s, start.get(s, NOTHING), top, self._place(s, top))) for s, top in end.items() if top > start.get(s, NOTHING)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        scope, floor, top, place = partition.value
        way = self.listing.pages(scope, floor, None, place)
        if place:
            name, items = next(way)
            # A page that is not what it was: from the first one.
            newer = items and int(items[0]["created"]) > top
            way = itertools.chain([(name, items)], way) if newer else self.listing.pages(scope, floor, None)
        rows = []
        for _, items in way:
            if items is None:
                raise OSError(f"a page of {scope} that was there is gone; the batch is read again")
            rows += [(scope, i["id"], int(i["created"]), i.get("title"), True) for i in items if int(i["created"]) <= top]
        yield from rows
