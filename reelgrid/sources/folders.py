"""A folder tree as a table: a Python data source, since Spark's file sources pass over names that begin with an underscore."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from reelgrid.functions.media import SKIPPED_FOLDERS


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _walkable(name: str) -> bool:
    return not name.startswith(".") and name.lower() not in SKIPPED_FOLDERS


def _encodable(name: str) -> bool:
    """Names that aren't UTF-8 can't be held in a table."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _parts(root: str) -> list[_Folder]:
    """The files of the root and of its folders as tasks of their own, and each folder two levels down as one, so that a large first-level folder is many tasks."""
    found = [_Folder(root, False)]
    for one in _inner(root):
        deeper = _inner(one)
        found += [_Folder(one, False), *(_Folder(p, True) for p in deeper)] if deeper else [_Folder(one, True)]
    return found


def _inner(folder: str) -> list[str]:
    try:
        return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and _walkable(e.name) and _encodable(e.name))
    except OSError:
        return []


def _walk(partition: _Folder) -> Iterator[tuple[str, int | None, int | None, bool, bool]]:
    """(path, size, modified_at, readable, folder) of what lies in a part; what vanishes while it is looked at is passed over."""
    todo = [partition.path]
    while todo:
        at = todo.pop()
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
            yield at, None, os.stat(at).st_mtime_ns // 1_000_000, True, True
        except FileNotFoundError:
            continue
        except OSError:
            yield at, None, None, False, True
            continue
        for e in entries:
            if not _encodable(e.name):
                continue
            if e.is_dir(follow_symlinks=False):
                if partition.deep and _walkable(e.name):
                    todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                yield e.path, s.st_size, s.st_mtime_ns // 1_000_000, True, False


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        return _parts(self.root)

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if partition.path == self.root and not os.path.isdir(self.root):  # a root that isn't there isn't an empty one
            yield self.root, None, None, False
            return
        for path, size, modified, readable, folder in _walk(partition):
            if not folder or not readable:
                yield path, size, modified, readable


class _Span(InputPartition):
    def __init__(self, folder: _Folder, after: int, upto: int):
        self.folder, self.after, self.upto = folder, after, upto


class _Changes(DataSourceStreamReader):
    """Paths changed between two times: files by their own time, and folders by theirs, which a file that came or went has moved."""

    def __init__(self, root: str, since: int | None):
        self.root, self.since = root.rstrip("/"), since

    def initialOffset(self) -> dict:
        return {"at": self.since if self.since is not None else time.time_ns() // 1_000_000}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1_000_000 - 1}  # the millisecond that isn't over belongs to the next batch

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(p, start["at"], end["at"]) for p in _parts(self.root)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for path, _, modified, readable, _ in _walk(partition.folder):
            if readable and partition.after < modified <= partition.upto:
                yield self.root, path, modified


def _listed(partition: _Folder) -> Iterator[tuple[str, str, int | None, int | None, str]]:
    """(folder, path, size, modified_at, kind) of a part: a row "listed" or "closed" for each folder, then its files and folders. A root that isn't there is closed."""
    todo = [partition.path]
    while todo:
        at = todo.pop()
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            yield at, at, None, None, "closed"
            continue
        yield at, at, None, None, "listed"
        for e in entries:
            if not _encodable(e.name):
                continue
            if e.is_dir(follow_symlinks=False):
                if _walkable(e.name):
                    yield at, e.path, None, None, "folder"
                    if partition.deep:
                        todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                yield at, e.path, s.st_size, s.st_mtime_ns // 1_000_000, "file"


class _Snapshots(DataSourceStreamReader):
    """The whole tree at each batch; a batch that is tried again lists it again, which the state that it is compared with doesn't mind."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(p, start["at"], end["at"]) for p in _parts(self.root)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for row in _listed(partition.folder):
            yield (self.root, *row, partition.after == 0)


class SnapshotSource(DataSource):
    """``spark.readStream.format("folder-snapshots").load(root)``: root, folder, path, size_bytes, modified_at, kind, first of all of a tree, for ``changes.changed_paths``.

    kind: listed or closed (a row for each folder), file, folder. first: whether it is the stream's first batch.
    """

    @classmethod
    def name(cls) -> str:
        return "folder-snapshots"

    def schema(self) -> str:
        return "root string, folder string, path string, size_bytes long, modified_at long, kind string, first boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Snapshots(self.options["path"])


class FolderSource(DataSource):
    """``spark.read.format("folder").load(root)``: path, size_bytes, modified_at (ms), readable. Symbolic links aren't followed.

    A folder that can't be read, and a root that isn't there, is a row that isn't readable.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, size_bytes long, modified_at long, readable boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class ChangeSource(DataSource):
    """``spark.readStream.format("folder-changes").load(root)``: folder, path, modified_at of what changes under a root.

    Offsets are times, so a batch that is retried finds the same span. The option ``since`` (ms) begins in the past.
    """

    @classmethod
    def name(cls) -> str:
        return "folder-changes"

    def schema(self) -> str:
        return "folder string, path string, modified_at long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options["path"], int(self.options["since"]) if "since" in self.options else None)


def register(spark) -> None:
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(ChangeSource)
    spark.dataSource.register(SnapshotSource)
