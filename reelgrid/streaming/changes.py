"""File changes as a stream: settled sets of paths, and batches written into the library's tables.

A set of paths for a folder is given out once it has been quiet for QUIET_MS, or PATIENCE_MS after its first path. The
state is the set, its first and its last time; processing time only.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelgrid.sources.shared import written

QUIET_MS, PATIENCE_MS = 300, 30_000


def settled(changes: DataFrame, quiet_ms: int = QUIET_MS, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """(folder, path) of settled sets from a stream (folder, path)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        paths, first = state.get if state.exists else ([], now)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"folder": [key[0]] * len(paths), "path": paths})
            return
        paths = sorted({*paths, *(p for batch in batches for p in batch["path"])})
        if now - first >= patience_ms:
            state.remove()
            yield pd.DataFrame({"folder": [key[0]] * len(paths), "path": paths})
        else:
            state.update((paths, first))
            state.setTimeoutDuration(max(1, min(quiet_ms, first + patience_ms - now)))

    return changes.groupBy("folder").applyInPandasWithState(step, "folder string, path string", "paths array<string>, first long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def changed_paths(snapshots: DataFrame, forget_ms: int = 7 * 86_400_000) -> DataFrame:
    """(root, folder, path, change, modified_at) of a stream of snapshots (``sources.folders.SnapshotSource``): created, changed, deleted, folder-created, folder-deleted.

    The state of a folder is what it held when it was last listed, so a file that went, or was renamed, is known by its path, and a change that
    leaves the time as it was by its size. A closed folder says nothing about what it holds; nor do those below it, as they aren't listed. A
    folder that went is one row, by its parent's listing: it stands for all below it. What the first batch lists is there already, and no change.
    A folder that isn't listed for ``forget_ms`` is forgotten.
    """
    schema = "root string, folder string, path string, change string, modified_at long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        root, folder = key
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        new = not state.exists
        names, sizes, times, folders = ([], [], [], []) if new else state.get
        state.setTimeoutDuration(forget_ms)
        if not (rows["kind"] == "listed").any():  # closed, or only known to be there
            if not new:
                state.update((names, sizes, times, folders))
            return
        before, seen = dict(zip(names, zip(sizes, times, strict=True), strict=True)), {}
        files = rows[rows["kind"] == "file"]
        for path, size, at in zip(files["path"], files["size_bytes"], files["modified_at"], strict=True):
            seen[path] = int(size), int(at)
        below = sorted(set(rows[rows["kind"] == "folder"]["path"]))
        state.update((list(seen), [s for s, _ in seen.values()], [t for _, t in seen.values()], below))
        if new and rows["first"].all():
            return
        found = [(p, "created" if p not in before else "changed", at) for p, (size, at) in seen.items() if before.get(p) != (size, at)]
        found += [(p, "deleted", None) for p in before if p not in seen]
        found += [(p, "folder-created", None) for p in below if p not in set(folders)] + [(p, "folder-deleted", None) for p in folders if p not in set(below)]
        if found:
            out = pd.DataFrame(sorted(found), columns=["path", "change", "modified_at"]).astype({"modified_at": "Int64"})
            yield out.assign(root=root, folder=folder)[["root", "folder", "path", "change", "modified_at"]]

    grouped = snapshots.groupBy("root", "folder")
    return grouped.applyInPandasWithState(step, schema, "names array<string>, sizes array<long>, times array<long>, folders array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _latest(rows: DataFrame, by: str, at: str, mark: str, name: str) -> DataFrame:
    """rows (by, at, b) with the last time up to theirs that is marked: windows over buckets, and what came before a bucket from one row for each."""
    w = Window.partitionBy(by, "b").orderBy(at)
    inner = rows.withColumn("_in", F.max(F.when(F.col(mark), F.col(at))).over(w))
    last = rows.where(mark).groupBy(by, "b").agg(F.max(at).alias("_last"))
    every = rows.select(by, "b").distinct().join(last, [by, "b"], "left")
    before = every.withColumn("_before", F.max("_last").over(Window.partitionBy(by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    return inner.join(before, [by, "b"]).withColumn(name, F.coalesce("_in", "_before")).drop("_in", "_before")


def sessions(changes: DataFrame, by: str, at: str, quiet: int = QUIET_MS, patience: int = PATIENCE_MS) -> DataFrame:
    """The same over a table: (by, first, last, n) of runs broken by ``quiet`` without a change, long runs cut every ``patience`` from their first.

    Equal times are summed first. Times are dealt to buckets as wide as patience with their neighbours' edges, so a long or dense
    series is many tasks. Each time points at the first one patience later in its run. Blocks of time double in width: a link of a level
    leads from where a block can be entered (from the one before it, or as a run's first time) to the first time beyond it, so each level
    has about half the links of the one below. Back down the levels, the times that are entered from the runs' first ones are those
    that begin a session. Twice as many rounds as the logarithm of the buckets, each written to the shared folder. quiet is no
    longer than patience. Rows without a key or a time are left out.
    """
    from reelgrid.operators.series import upto

    if quiet > patience:
        raise ValueError("quiet is longer than patience")
    bucket = F.floor(F.col(at) / patience)
    times = changes.where(F.col(at).isNotNull()).groupBy(by, at).agg(F.count("*").alias("n")).withColumn("b", bucket)
    own = F.array(F.struct(F.lit(0).alias("step"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("step"), F.lit(False).alias("own")))
    dealt = times.select(by, at, "n", "b", F.inline(own)).withColumn("b", F.col("b") + F.col("step")).drop("step")
    lag = F.lag(at).over(Window.partitionBy(by, "b").orderBy(at))
    marked = dealt.withColumn("new", F.coalesce(F.col(at) - lag >= quiet, F.lit(True))).where("own").drop("own")
    runs = written(_latest(marked, by, at, "new", "run"), "runs")
    step = lambda b, t, asks, hit: F.struct(b.alias("b"), t.alias("t"), asks.alias("asks"), hit.alias("hit"))
    here, none = F.struct(F.col(at).alias("next"), F.col("run").alias("run")), F.lit(None)
    kind, target = runs.schema[at].dataType, F.col(at) + patience
    ways = F.array(*(step(F.col("b") - i, F.col(at), none.cast(kind), here) for i in (0, 1)), step(F.floor(target / patience), target, F.col(at), F.when(F.lit(False), here)))
    found = runs.select(by, "run", F.inline(ways)).withColumn("following", F.min("hit").over(upto([by, "b"], "t", True)))
    links = written(found.where("asks IS NOT NULL AND following.run = run").select(by, F.col("asks").alias("t"), F.col("following.next").alias("next")), "links")
    starts = runs.where("new").select(by, F.col(at).alias("t"))
    least = links.agg(F.min("t")).first()[0]
    block = lambda c, level: F.floor((F.col(c) - least) / (patience << level))
    levels = []
    while not links.isEmpty():
        levels.append(links)
        beyond = block("t", len(levels)) != block("next", len(levels))
        entered = links.where(beyond).select(by, F.col("next").alias("t")).unionByName(starts).distinct()
        second = links.select(by, F.col("t").alias("next"), F.col("next").alias("after"))
        one = links.join(entered.hint("merge"), [by, "t"], "left_semi")
        more = one.where(~beyond).join(second.hint("merge"), [by, "next"]).select(by, "t", F.col("after").alias("next"))
        links = written(one.where(beyond).unionByName(more), "links")
    while levels:
        reached = starts.join(levels.pop().hint("merge"), [by, "t"]).select(by, F.col("next").alias("t"))
        starts = written(starts.unionByName(reached).distinct(), "starts")
    opened = starts.select(by, F.col("t").alias(at), F.lit(True).alias("start"))
    cut = _latest(runs.drop("new").join(opened, [by, at], "left").withColumn("start", F.coalesce("start", F.lit(False))), by, at, "start", "first")
    return cut.groupBy(by, "first").agg(F.max(at).alias("last"), F.sum("n").alias("n")).select(by, "first", "last", "n")


def into(stream: DataFrame, write: Callable[[DataFrame, int], Any], checkpoint: str):
    """Starts a query that hands each batch and its number to ``write``; batches that are retried have the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, at: str, width: str, slide: str | None = None, late: str = "10 minutes", *by: str) -> DataFrame:
    """Tumbling or sliding counts with a watermark; an extension of what file changes need."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def refreshed(changes: DataFrame, watched: Callable[[], DataFrame], scan: Callable[[DataFrame, int], Any], checkpoint: str):
    """Scans the watched folders (id, path) that hold a path of a batch (path): scan takes those folders and the batch's number. Batches that touch none scan nothing."""
    from reelgrid.operators.catalogue import touched_folders

    def write(batch: DataFrame, number: int) -> None:
        touched = touched_folders(watched(), batch)
        if not touched.isEmpty():
            scan(touched, number)

    return into(changes, write, checkpoint)


def kept_positions(stream: DataFrame, stored: Callable[[], DataFrame], store: Callable[[DataFrame], Any], checkpoint: str, every: str = "5 seconds"):
    """Positions (film_id, position_ms, duration_ms, finished, updated_at) written every few seconds: the latest of each film, nothing under a second."""
    from reelgrid.operators.mutations import saved_positions

    def write(batch: DataFrame, number: int) -> None:
        new = saved_positions(stored(), batch)
        if not new.where("changed").isEmpty():
            store(new.drop("changed"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class OneAtATime:
    """Runs one job of a kind at a time as a Spark job group; another is refused meanwhile, and cancel() stops its tasks."""

    def __init__(self, spark, group: str):
        self.context, self.group, self.lock = spark.sparkContext, group, threading.Lock()

    def run(self, job: Callable[[], Any]) -> Any:
        if not self.lock.acquire(blocking=False):
            raise RuntimeError(f"{self.group} is running already")
        try:
            self.context.setJobGroup(self.group, self.group, interruptOnCancel=True)
            return job()
        finally:
            self.context._jsc.clearJobGroup()
            self.lock.release()

    @property
    def busy(self) -> bool:
        return self.lock.locked()

    def cancel(self) -> None:
        self.context.cancelJobGroup(self.group)
