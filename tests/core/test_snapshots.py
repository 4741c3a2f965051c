"""Changes of a folder tree told from what each folder held before."""

import time

from reelgrid.sources import folders
from reelgrid.streaming import changes

SCHEMA = "root string, folder string, path string, size_bytes long, modified_at long, kind string, first boolean"


def listing(first, **held):
    """Rows of a snapshot: folder -> None if it is closed, else its files (path: (size, time)) and folders (path: None)."""
    rows = []
    for folder, entries in held.items():
        at = f"/r/{folder}" if folder != "r" else "/r"
        rows.append(("/r", at, at, None, None, "closed" if entries is None else "listed", first))
        for name, entry in (entries or {}).items():
            rows.append(("/r", at, f"{at}/{name}", *(entry or (None, None)), "file" if entry else "folder", first))
    return rows


def told(spark, tmp_path, snapshots):
    """(batch, path, change) of snapshots that come one by one."""
    seen = []
    source = tmp_path / "snapshots"
    for i, rows in enumerate(snapshots):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(source / f"n={i}"))
        time.sleep(0.05)  # files are taken in order of their times
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source / "*"))
    query = changes.into(changes.changed_paths(stream), lambda df, n: seen.extend((n, r.path, r.change) for r in df.collect()), str(tmp_path / "checkpoint"))
    until = time.time() + 120
    while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= len(snapshots)):
        time.sleep(0.2)
    query.stop()
    return sorted(seen)


def test_created_changed_deleted_and_closed(spark, tmp_path):
    got = told(spark, tmp_path, [
        listing(True, r={"a.srt": (1, 10), "d": None, "e": None}, d={"x.mkv": (5, 10), "y.mkv": (6, 10)}, e={"z.mkv": (7, 10)}),
        listing(False, r={"a.srt": (1, 20), "b.srt": (2, 20), "d": None, "e": None}, d={"x.mkv": (5, 10), "y2.mkv": (6, 10)}, e=None),  # changed, created, renamed; e can't be read
        listing(False, r={"b.srt": (3, 20), "e": None}, e={"z.mkv": (7, 10)}),  # deleted; another size at the same time; a folder that went; e is back as it was
        listing(False, r=None),  # the root can't be read
        listing(False, r={"b.srt": (3, 20), "e": None, "f": None}, e={}, f={"new.mkv": (1, 1)}),
    ])
    assert got == [
        (1, "/r/a.srt", "changed"), (1, "/r/b.srt", "created"), (1, "/r/d/y.mkv", "deleted"), (1, "/r/d/y2.mkv", "created"),
        (2, "/r/a.srt", "deleted"), (2, "/r/b.srt", "changed"), (2, "/r/d", "folder-deleted"),
        (4, "/r/e/z.mkv", "deleted"), (4, "/r/f", "folder-created"), (4, "/r/f/new.mkv", "created"),
    ]


def test_a_tree_that_changes(spark, tmp_path):
    root = tmp_path / "films"
    (root / "one" / "two" / "three").mkdir(parents=True)
    (root / "one" / "two" / "three" / "a.mkv").write_bytes(b"a")
    (root / ".hidden").mkdir()
    rows = {(p, k) for part in folders._parts(str(root)) for _, p, _, _, k in folders._listed(part)}
    deep = str(root / "one" / "two" / "three")
    assert (deep + "/a.mkv", "file") in rows and (deep, "listed") in rows and not any(".hidden" in p for p, _ in rows)
    assert [r[4] for part in folders._parts(str(tmp_path / "none")) for r in folders._listed(part)] == ["closed"]
    folders.register(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen = []
    stream = spark.readStream.format("folder-snapshots").load(str(root))
    found = changes.changed_paths(stream).writeStream.foreachBatch(lambda df, n: seen.extend((r.path, r.change) for r in df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    until = time.time() + 120
    while time.time() < until and not (found.lastProgress and found.lastProgress["batchId"] >= 1):
        time.sleep(0.2)
    (root / "one" / "two" / "three" / "a.mkv").rename(root / "b.mkv")
    while time.time() < until and len(seen) < 2:
        time.sleep(0.2)
    found.stop()
    assert sorted(seen) == [(str(root / "b.mkv"), "created"), (deep + "/a.mkv", "deleted")]
