"""Files read by ranges where they lie, so that a film of any size costs a task a few pages: local and mounted paths, or stores with a URI."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reelgrid.sources.shared import Watch

PAGE, PAGES = 512, 4096


def opened(path: str):
    """A seekable file. URIs other than file: go to the store's own file system."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


class Ranged:
    """A file as if it were bytes: single bytes and slices are fetched by pages, PAGES of which are kept. ``fetched`` counts bytes read."""

    def __init__(self, file):
        self.file, self.fetched, self.pages = file, 0, OrderedDict()
        self.size = file.seek(0, 2) or file.tell()

    def __len__(self) -> int:
        return self.size

    def _page(self, k: int) -> bytes:
        if (page := self.pages.get(k)) is None:
            self.file.seek(k * PAGE)
            page = self.pages[k] = self.file.read(PAGE)
            self.fetched += len(page)
            if len(self.pages) > PAGES:
                self.pages.popitem(last=False)
        return page

    def __getitem__(self, at: int | slice):
        if isinstance(at, int):
            return self._page(at // PAGE)[at % PAGE]
        begin, end, _ = at.indices(self.size)
        if end - begin > PAGES * PAGE // 4:  # a long run is read at once and not kept
            self.file.seek(begin)
            self.fetched += end - begin
            return self.file.read(end - begin)
        parts = [self._page(k) for k in range(begin // PAGE, -(-end // PAGE))] if end > begin else []
        skip = begin // PAGE * PAGE
        return b"".join(parts)[begin - skip : end - skip]


def rows_of(paths: DataFrame, make: Callable[[str], Iterator[dict]], schema: pa.Schema, kind: str, least: int = 1, held: int = 5000, watch: Watch | None = None) -> DataFrame:
    """Rows made of each path (path) in tasks, ``held`` at a time; paths are dealt evenly over ``least`` tasks or more.

    watch: counts the paths that are done, and is asked before each whether to stop; those that follow have the one row (path, outcome "stopped").
    """
    stop, done = (watch.begun(paths.count()), watch.done) if watch else ((lambda: False), None)

    def asked(path: str) -> Iterator[dict]:
        if stop():
            yield {"path": path, "outcome": "stopped"}
            return
        yield from make(path)
        if done is not None:
            done.add(1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in asked(path):
                    rows.append(row)
                    if len(rows) == held:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = paths.select("path") if least == 1 else paths.select("path").repartition(least)
    return dealt.mapInArrow(read, kind)


def contents(paths: DataFrame, most: int = 32 << 20, watch: Watch | None = None) -> DataFrame:
    """(path, content, outcome) of small files: outcome ok, too-large (over ``most`` bytes), unreadable or stopped."""

    def make(path: str) -> Iterator[dict]:
        try:
            with opened(path) as f:
                raw = f.read(most + 1)
        except OSError:
            yield {"path": path, "content": None, "outcome": "unreadable"}
            return
        yield {"path": path, "content": raw if len(raw) <= most else None, "outcome": "ok" if len(raw) <= most else "too-large"}

    return rows_of(paths, make, pa.schema([("path", pa.string()), ("content", pa.binary()), ("outcome", pa.string())]), "path string, content binary, outcome string", held=16, watch=watch)


def existing(paths: DataFrame) -> DataFrame:
    """(path): those of paths (path) that can be opened."""

    def make(path: str) -> Iterator[dict]:
        try:
            with opened(path):
                yield {"path": path}
        except OSError:
            return

    return rows_of(paths, make, pa.schema([("path", pa.string())]), "path string")
