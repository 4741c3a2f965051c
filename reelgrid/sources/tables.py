"""The library's tables as versioned datasets in a shared folder: schemas, commits of several tables, migrations, checks of references, and sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "watched_folder": "id long, path string, added_at long",
    "film": "id long, folder_id long, path string, title string, year int, size_bytes long, modified_at long, duration_ms long, poster_path string, accent string, missing_since long, added_at long, chosen_track_id long, subtitles_off boolean, probed_at long, cover_path string, container string, video_codec string, video_width int, video_height int, bit_depth int, frame_rate double, cover_source string",
    "subtitle_track": "id long, film_id long, path string, origin string, stream_number long, codec string, language string, forced boolean, hearing_impaired boolean, match_kind string, encoding string, cue_count long, size_bytes long, modified_at long, offset_ms int, rate double",
    "cue": "track_id long, ordinal int, start_ms long, end_ms long, position int, text string",
    "audio_stream": "film_id long, stream_number long, codec string, channels int, language string, is_default boolean",
    "playback_position": "film_id long, position_ms long, duration_ms long, finished boolean, updated_at long",
    "preference": "key string, value string",
    "schema_migration": "version int, name string, applied_at long",
}
#: What each table refers to: (table, column, other table, its column).
REFERENCES = (
    ("film", "folder_id", "watched_folder", "id"), ("film", "chosen_track_id", "subtitle_track", "id"), ("subtitle_track", "film_id", "film", "id"),
    ("cue", "track_id", "subtitle_track", "id"), ("audio_stream", "film_id", "film", "id"), ("playback_position", "film_id", "film", "id"),
)
UNIQUE = {"watched_folder": ("path",), "film": ("path",), "subtitle_track": ("path", "stream_number"), "audio_stream": ("film_id", "stream_number"), "playback_position": ("film_id",), "preference": ("key",)}
#: How the rows of a bucket are sorted, where that isn't by the key alone.
CLUSTERED = {"cue": ("track_id", "start_ms", "ordinal")}


class Newer(RuntimeError):
    """Tables of a later schema than this library's."""


class Broken(RuntimeError):
    """References to rows that aren't there."""


class Conflict(RuntimeError):
    """A commit that another writer made first."""


#: Batches that are remembered, so that a commit that is tried again changes nothing.
KEPT_BATCHES = 10_000


#: Migrations: name and what it adds, (table, column, type, default), in their order; each is a version, from 1.
MIGRATIONS: tuple[tuple[str, tuple[tuple[str, str, str, Column | None], ...]], ...] = (
    ("initial", ()),
    ("track_source", (("subtitle_track", "origin", "string", None), ("subtitle_track", "stream_number", "long", None))),
    ("media_details", tuple(("film", c, t, None) for c, t in (("container", "string"), ("video_codec", "string"), ("video_width", "int"), ("video_height", "int"), ("bit_depth", "int"), ("frame_rate", "double")))),
    ("cover_source", (("film", "cover_source", "string", None),)),
)
DEFAULTS = {("subtitle_track", "origin"): "sidecar", ("subtitle_track", "stream_number"): 0, ("film", "cover_source"): "none"}


#: Tables that are dealt to buckets by a key, so that a change of some rows writes their buckets only.
BUCKETED = {"cue": "track_id", "subtitle_track": "id", "film": "id", "playback_position": "film_id"}


class Part(NamedTuple):
    """New rows of some buckets of a table, in place of all that these hold."""

    rows: DataFrame
    buckets: list[int]


class Store:
    """Tables under a root folder.

    ``_commits/N`` says, for each table, which commit wrote what it holds: one number for a whole table, one for each bucket of a BUCKETED
    one. A commit writes its rows under ``TABLE/version=N`` (``bucket=K`` within) by Spark's writer, and then that one
    file, by a rename: all its tables change together or not at all, and one that failed leaves nothing that is read. What the last two commits don't name
    is removed. ``buckets`` is fixed by the first commit: so many that one is a file or a few.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path_of(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- commits ----

    def _names(self, folder: str) -> list[str]:
        path = self._path_of(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.files.listStatus(path)] if self.files.exists(path) else []

    def _commit(self, number: int) -> dict:
        at = self.files.open(self._path_of(f"{self.root}/_commits/{number}"))
        try:
            return json.loads(bytes(at.readAllBytes()))
        finally:
            at.close()

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("_commits") if n.isdigit())

    def current(self) -> tuple[int, dict]:
        """The newest commit's number and what it says. Without any, what folders of whole versions hold that Spark marked as done."""
        numbers = self._numbers()
        if numbers:
            return numbers[-1], self._commit(numbers[-1])
        tables = {}
        for name in SCHEMAS:
            done = [int(v[8:]) for v in self._names(name) if v.startswith("version=") and v[8:].isdigit() and self.files.exists(self._path_of(f"{self.root}/{name}/{v}/_SUCCESS"))]
            if done:
                tables[name] = {"": max(done)}
        return max((v for t in tables.values() for v in t.values()), default=0), {"tables": tables, "buckets": self.buckets, "batches": []}

    def version(self, name: str) -> int:
        """The number of the commit that changed a table last; 0 if there is none."""
        _, said = self.current()
        return said.get("changed", {}).get(name) or max(said["tables"].get(name, {}).values(), default=0)

    def _paths(self, name: str, held: dict, only: list[int] | None = None) -> list[str]:
        return [f"{self.root}/{name}/version={n}" + (f"/bucket={k}" if k else "") for k, n in sorted(held.items()) if only is None or not k or int(k) in only]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as the newest commit has it, or some of its buckets; without one, no rows."""
        paths = self._paths(name, self.current()[1]["tables"].get(name, {}), buckets)
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.current()[1]["buckets"])).cast("int")

    def buckets_of(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of a table that hold keys (one column); at most as many as there are."""
        return sorted(r.b for r in keys.select(self.bucket(F.col(keys.columns[0])).alias("b")).distinct().collect())

    def part(self, name: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> Part:
        """The buckets that hold keys, after make() of their rows; which must leave keys where they are."""
        touched = self.buckets_of(name, keys)
        return Part(make(self.read(name, touched)), touched)

    def commit(self, changes: dict[str, DataFrame | Part], batch: str | None = None) -> int:
        """Writes new rows of whole tables, or Parts of them, as one commit; its number. A batch that was committed before changes nothing.

        Columns come in the schema's order, cast to its types; missing ones are their defaults or null.
        """
        newest, now = self.current()
        if batch is not None and batch in now["batches"]:
            return newest
        number = newest + 1
        now["changed"] = now.get("changed", {}) | dict.fromkeys(changes, number)
        for name, change in changes.items():
            rows = change.rows if isinstance(change, Part) else change
            fields = [f.split(" ") for f in SCHEMAS[name].split(", ")]
            held = rows.select(*((F.col(c) if c in rows.columns else F.lit(DEFAULTS.get((name, c)))).cast(t).alias(c) for c, t in fields))
            folder = f"{self.root}/{name}/version={number}"
            if name not in BUCKETED:
                held.write.mode("overwrite").parquet(folder)
                now["tables"][name] = {"": number}
                continue
            dealt = held.withColumn("bucket", self.bucket(F.col(BUCKETED[name]))).repartition("bucket").sortWithinPartitions("bucket", *CLUSTERED.get(name, (BUCKETED[name],)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
            before = now["tables"].get(name, {})
            kept = {k: n for k, n in before.items() if k and int(k) not in change.buckets} if isinstance(change, Part) else {}
            now["tables"][name] = kept | {n[7:]: number for n in self._names(f"{name}/version={number}") if n.startswith("bucket=")}
        now["batches"] = [*now["batches"], *([batch] if batch is not None else [])][-KEPT_BATCHES:]
        self._publish(number, now)
        self._clean(number)
        return number

    def _publish(self, number: int, said: dict) -> None:
        made, final = self._path_of(f"{self.root}/_commits/.{number}-{uuid.uuid4().hex}"), self._path_of(f"{self.root}/_commits/{number}")
        out = self.files.create(made, False)
        out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(made, final):
            self.files.delete(made, False)
            raise Conflict(f"commit {number} was made by another writer")

    def _clean(self, number: int) -> None:
        """Removes what neither this commit nor the one before it names."""
        last = self._numbers()[-2:]
        named = {(t, str(n), k) for c in last for t, held in self._commit(c)["tables"].items() for k, n in held.items()}
        whole = {(t, n) for t, n, _ in named}
        for name in SCHEMAS:
            for v in self._names(name):
                n = v.removeprefix("version=")
                if not n.isdigit() or int(n) >= number:
                    continue
                if (name, n) not in whole:
                    self.files.delete(self._path_of(f"{self.root}/{name}/{v}"), True)
                elif name in BUCKETED and (name, n, "") not in named:
                    for b in self._names(f"{name}/{v}"):
                        if b.startswith("bucket=") and (name, n, b[7:]) not in named:
                            self.files.delete(self._path_of(f"{self.root}/{name}/{v}/{b}"), True)
        for n in self._numbers()[:-2]:
            self.files.delete(self._path_of(f"{self.root}/_commits/{n}"), False)

    def write(self, name: str, rows: DataFrame) -> int:
        """A commit of one whole table."""
        return self.commit({name: rows})

    def migrate(self, now: int) -> int:
        """Brings the tables to the newest schema, one migration after the other, each recorded; how many were applied.

        Columns that a stored version lacks are added with their defaults. Tables of a later schema are refused, and so are
        references that lead nowhere once all is done.
        """
        done = self.read("schema_migration")
        have = done.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        if have > len(MIGRATIONS):
            raise Newer(f"the tables are of schema {have}, this library's is {len(MIGRATIONS)}")
        for number in range(have + 1, len(MIGRATIONS) + 1):
            name, columns = MIGRATIONS[number - 1]
            for table in sorted({t for t, *_ in columns}):
                if paths := self._paths(table, self.current()[1]["tables"].get(table, {})):
                    stored = self.spark.read.parquet(*paths)
                    missing = [(c, t) for tab, c, t, _ in columns if tab == table and c not in stored.columns]
                    if missing:
                        self.write(table, stored.withColumns({c: F.lit(DEFAULTS.get((table, c))).cast(t) for c, t in missing}))
            done = done.unionByName(self.spark.createDataFrame([(number, name, now)], SCHEMAS["schema_migration"]))
            self.write("schema_migration", done)
            done = self.read("schema_migration")
        if broken := dangling(self.read):
            raise Broken(", ".join(f"{t}.{c}: {n}" for (t, c), n in broken.items()))
        return len(MIGRATIONS) - have


def dangling(table: Callable[[str], DataFrame]) -> dict[tuple[str, str], int]:
    """How many rows of each reference lead nowhere; references that hold are left out."""
    found = {}
    for name, column, other, key in REFERENCES:
        own = table(name).where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
        n = own.join(table(other).select(F.col(key).alias("_k")), "_k", "left_anti").count()
        if n:
            found[name, column] = n
    return found


def repeated(rows: DataFrame, unique: tuple[str, ...]) -> DataFrame:
    """(unique columns, n) of keys that occur more than once."""
    return rows.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as lines of JSON: nulls are written, so every line has every field."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
