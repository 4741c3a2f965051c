"""A library as one object: its tables in a shared folder, scans of watched folders, and what a person does to films and tracks.

Every method is a few plans over the tables and writes of new versions; only single rows and counts come to the driver.
Times are epoch milliseconds given by the caller, so that everything can be repeated.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import labels
from reelgrid.functions.media import SUBTITLE_CODECS, VIDEO_CODECS, _cases, base_name, codec_name, container_name, file_kind
from reelgrid.functions.names import parsed_name
from reelgrid.functions.timing import frame_rate
from reelgrid.operators import alignment, catalogue, covers, decisions, library, mutations, pairing, subtitles, upserts
from reelgrid.sources import audio, folders, matroska, ranged, tables
from reelgrid.sources.shared import Watch, written
from reelgrid.streaming.changes import OneAtATime


class Library:
    """Tables under root; folders are watched where the workers can read them."""

    def __init__(self, spark: SparkSession, root: str, now: int = 0, buckets: int = 64, pack: tuple[int, int] = (mutations.PACK_TRACKS, mutations.PACK_CUES)):
        """buckets: of the tables that are changed in part; pack: tracks and cues of one commit of a scan (larger packs are fewer jobs)."""
        self.spark, self.store, self.pack = spark, tables.Store(spark, root, buckets), pack
        self.aligning, self.scanning = OneAtATime(spark, "alignment"), OneAtATime(spark, "scan")
        self.left_out: DataFrame | None = None
        self.listening: Watch | None = None
        self.reading: Watch | None = None
        folders.register(spark)
        self.store.migrate(now)

    # ---- what there is ----

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def folders(self) -> DataFrame:
        return catalogue.folders(self.table("watched_folder"))

    def library(self, hide_missing: bool = False) -> DataFrame:
        """film_views() in the stored order."""
        f = catalogue.present(self.table("film"), hide_missing)
        return catalogue.listed(library.film_views(f, self.table("watched_folder"), self.table("subtitle_track"), self.table("audio_stream"), self.table("playback_position")))

    def resumable(self, n: int) -> DataFrame:
        return library.resumable(self.table("playback_position"), self.table("film").select(F.col("id").alias("film_id"), "title", "missing_since"), n)

    def cues(self, track_id: int, authored: bool = False) -> DataFrame:
        own = self.table("cue").where(F.col("track_id") == track_id)
        return catalogue.cues(own, self.table("subtitle_track"), authored)

    # ---- folders and scans ----

    def add_folder(self, path: str, now: int) -> int:
        """Watches a folder, unless it is watched already; its id."""
        stored = self.table("watched_folder")
        fresh = self.spark.createDataFrame([(None, path.rstrip("/"), now)], tables.SCHEMAS["watched_folder"])
        self.store.write("watched_folder", written(mutations.added(stored, mutations.numbered_ids(stored, fresh, ["path"]), "path"), "folders"))
        return catalogue.matching(self.table("watched_folder"), path=path.rstrip("/")).first().id

    def remove_folder(self, folder_id: int) -> None:
        """Forgets a folder and all that belongs to its films."""
        gone = self.table("film").where(F.col("folder_id") == folder_id).select(F.col("id").alias("film_id"))
        left = upserts.cascade({n: self.table(n) for n in ("film", "subtitle_track", "cue", "playback_position", "audio_stream")}, written(gone, "gone"))
        self._write({**left, "watched_folder": self.table("watched_folder").where(F.col("id") != folder_id)})

    def _write(self, changed: dict[str, DataFrame | tables.Part], batch: str | None = None) -> None:
        """New rows of tables that were made of each other, as one commit."""
        self.store.commit(changed, batch)

    def folders_for_paths(self, paths: list[str]) -> list[str]:
        """The folders to watch for some dropped paths: folders themselves, those that files lie in, each once and none inside another."""
        given = [(p.rstrip("/") if os.path.isdir(p) else os.path.dirname(p),) for p in paths]
        return sorted(r.path for r in catalogue.outermost(self.spark.createDataFrame(given, "path string")).collect())

    def rescan(self, now: int) -> list[int]:
        """Scans all watched folders; their ids."""
        ids = [r.id for r in self.folders().select("id").collect()]  # watched folders are few
        for i in ids:
            self.scan(i, now)
        return ids

    def scan(self, folder_id: int, now: int) -> DataFrame:
        """_scan(), one at a time; ``scanning.busy`` says whether one runs."""

        def begun() -> DataFrame:
            self.reading = Watch(self.spark)
            return self._scan(folder_id, now)

        return self.scanning.run(begun)

    def scan_progress(self) -> float:
        """The share of files that the scan which runs, in another thread, has read of those that it knows it must."""
        return self.reading.fraction if self.reading else 0.0

    def cancel_scan(self) -> None:
        """Lets the scan that runs end soon: files it hasn't read yet are left out as "stopped", and read by the next one."""
        if self.reading:
            self.reading.stop()

    def _scan(self, folder_id: int, now: int) -> DataFrame:
        """Brings the tables up to what a folder holds; counts of what was found and done, one row.

        Films are upserted and vanished ones marked; subtitle files are paired by name and read where their bytes or pairs
        changed; new and changed films are looked into by ranges; covers are decided anew.
        """
        root = catalogue.matching(self.table("watched_folder"), id=folder_id).first().path
        name = base_name(F.col("path"))
        seen = written(self.spark.read.format("folder").load(root).select("path", "size_bytes", "modified_at", "readable", file_kind(name).alias("kind"), parsed_name(name).alias("n")), "files")
        closed = seen.where("NOT readable").select("path")
        if not closed.where(F.col("path") == root).isEmpty():
            self.left_out = closed.select("path", F.lit("unreadable").alias("outcome"))
            return self._counted(seen.where("readable"), root, 0, 0, 0)
        files = seen.where("readable")
        films, tracks, no_cues = self.table("film"), self.table("subtitle_track"), self.spark.createDataFrame([], tables.SCHEMAS["cue"])
        of = lambda kind: files.where(F.col("kind") == kind)

        # films
        found = mutations.numbered_ids(films, of("film").select(F.lit(None).cast("long").alias("id"), "path", "size_bytes", "modified_at", "n"), ["path"])
        fresh = found.select("id", F.lit(folder_id).cast("long").alias("folder_id"), "path", "n.title", "n.year", "size_bytes", "modified_at", F.lit(now).cast("long").alias("added_at"), F.lit(False).alias("subtitles_off"), F.lit("none").alias("cover_source"), F.lit(None).cast("long").alias("missing_since"))
        jobs = written(upserts.film_jobs(fresh.select("path", "size_bytes", "modified_at"), films.select("path", "size_bytes", "modified_at", "missing_since", "probed_at", "container")), "jobs")
        now_films = upserts.upserted(films, fresh, ["path"], ["title", "year", "size_bytes", "modified_at", "missing_since"]).drop("changed")
        ours = now_films.where(F.col("folder_id") == folder_id)
        known = fresh.select("path").unionByName(catalogue.under(ours.select("path"), closed))  # what can't be looked at isn't gone
        now_films = now_films.where(F.col("folder_id") != folder_id).unionByName(upserts.marked_missing(ours, known, "path", now))
        now_films = written(now_films, "films")

        # subtitle files
        named = found.select(F.col("id").alias("film"), "n.key", F.col("n.key_words").alias("words"), "n.year")
        subs = of("subtitle").select(F.col("path").alias("subtitle"), "n.key", F.col("n.key_words").alias("words"), "n.year")
        pairs = written(pairing.paired(subs, named).select(F.col("subtitle").alias("path"), F.col("film").alias("film_id"), F.col("match").alias("match_kind")), "pairs")
        # tracks of films that are there; those of missing films, and what lies in closed folders, are left alone
        here = now_films.where((F.col("folder_id") == folder_id) & F.col("missing_since").isNull()).select(F.col("id").alias("film_id"))
        beside = tracks.where("origin = 'sidecar'").join(here, "film_id", "left_semi")
        beside = written(beside.join(catalogue.under(beside.select("path"), closed), "path", "left_anti"), "beside")
        hand = tracks.where("origin = 'sidecar' AND match_kind = 'by-hand'").select("path", F.col("film_id").alias("_film"))
        on_disk = of("subtitle").select("path", "size_bytes", "modified_at").join(pairs, "path", "left").join(hand, "path", "left")
        on_disk = on_disk.select("path", "size_bytes", "modified_at", F.coalesce("_film", "film_id").alias("film_id"), F.when(F.col("_film").isNotNull(), "by-hand").otherwise(F.col("match_kind")).alias("match_kind")).where("film_id IS NOT NULL")
        on_disk = written(on_disk, "on_disk")
        elsewhere = written(beside.where("match_kind = 'by-hand'").select("path").join(on_disk, "path", "left_anti"), "elsewhere")
        plan = written(upserts.plan(beside, on_disk, "path", elsewhere.join(ranged.existing(elsewhere), "path", "left_anti")), "plan")
        held = written(ranged.contents(plan.where("action = 'read'").select("path"), watch=self.reading), "contents")
        text = written(subtitles.decoded(held.where("outcome = 'ok'").drop("outcome")), "texts")
        read = text.select("path")
        got, _ = subtitles.parsed(text)
        got = written(got, "cues")
        counts = got.groupBy("path").agg(F.count("*").alias("cue_count"))
        labelled = of("subtitle").select("path", "size_bytes", "modified_at", "n.language", "n.forced", "n.hearing_impaired")
        made = read.join(labelled, "path").join(on_disk.select("path", "film_id", "match_kind"), "path").join(counts, "path", "left").join(text.select("path", "encoding"), "path", "left")
        made = made.select(F.lit(None).cast("long").alias("id"), "film_id", "path", F.lit("sidecar").alias("origin"), F.lit(0).cast("long").alias("stream_number"), F.lit("subrip").alias("codec"), "language", "forced", "hearing_impaired", "match_kind", F.coalesce("encoding", F.lit("")).alias("encoding"), F.coalesce("cue_count", F.lit(0)).alias("cue_count"), "size_bytes", "modified_at", F.lit(0).alias("offset_ms"), F.lit(1.0).alias("rate"))
        made = written(mutations.numbered_ids(tracks, made, ["path", "stream_number"]), "tracks")
        ids = made.select("path", F.col("id").alias("track_id"))
        gone = plan.where("action = 'remove'").select("path")
        removed = written(tracks.where("origin = 'sidecar'").join(gone, "path", "left_semi").select("id"), "removed")
        kept = upserts.repaired(upserts.without(tracks, removed, "id", "id"), pairs.join(plan.where("action = 'repoint'"), "path", "left_semi"))
        new_tracks, made_cues = mutations.written_tracks(kept, no_cues, made, got.join(ids, "path"))

        # films that are new or changed
        whole = jobs.select("path").join(now_films.select("path", F.col("id").alias("film_id")), "path")
        looked = written(matroska.probe(whole, self.reading).join(whole, "path"), "probe")
        probe = looked.where("outcome <> 'stopped'")  # the next scan looks into the others
        streams = probe.select("film_id", "path", F.explode("subtitles").alias("s")).select(
            F.lit(None).cast("long").alias("id"), "film_id", "path", F.lit("stream").alias("origin"), "s.stream_number", F.coalesce(_cases(F.col("s.codec_id"), SUBTITLE_CODECS), F.lit("unknown")).alias("codec"), "s.language", "s.forced", "s.hearing_impaired", F.lit("exact").alias("match_kind"), F.lit("utf-8").alias("encoding"), F.lit(0).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("modified_at"), F.lit(0).alias("offset_ms"), F.lit(1.0).alias("rate"),
        )
        said = written(matroska.dialogue(probe.where("outcome = 'ok'").select("path")), "dialogue")
        streams = streams.join(said.groupBy("path", "stream_number").agg(F.count("*").alias("cue_count")), ["path", "stream_number"], "left").withColumn("cue_count", F.coalesce("cue_count", F.lit(0)))
        stored = new_tracks.drop("changed")
        streams = written(mutations.numbered_ids(stored, streams, ["path", "stream_number"]), "streams")
        stream_cues = said.join(streams.select("path", "stream_number", F.col("id").alias("track_id")), ["path", "stream_number"])
        opened = probe.select("film_id")
        now_tracks, stream_cues, now_films = mutations.with_streams(written(stored, "stored"), no_cues, upserts.nulled(now_films, removed, "chosen_track_id", "id"), streams, stream_cues, opened, now)
        facts = probe.select(F.col("film_id").alias("id"), container_name(base_name(F.col("path"))).alias("container"), codec_name(F.col("video_codec_id"), VIDEO_CODECS).alias("video_codec"), F.col("width").cast("int").alias("video_width"), F.col("height").cast("int").alias("video_height"), F.col("bit_depth").cast("int").alias("bit_depth"), frame_rate(F.col("frame_ns")).alias("frame_rate"), "duration_ms")
        sound = probe.select("film_id", F.explode("audio").alias("a")).select("film_id", "a.stream_number", F.col("a.codec_id").alias("codec"), F.col("a.channels").cast("int").alias("channels"), "a.language", "a.is_default")
        described, now_audio = mutations.described(now_films, self.table("audio_stream"), facts, sound)
        now_films = written(described.drop("changed"), "described")

        # covers
        here = now_films.where((F.col("folder_id") == folder_id) & F.col("missing_since").isNull())
        keyed = found.select(F.col("path").alias("film"), "n.key", "n.year")
        offered = written(covers.candidates(keyed, of("image").select("path"), of("sidecar").select("path")), "offered")
        notes = ranged.contents(offered.where("source = 'sidecar'").select("path").distinct()).where("outcome = 'ok'").select("path", F.decode("content", "UTF-8").alias("text"))
        thumbs = covers.thumbs(notes, of("image").select("path"))
        art = matroska.artwork(probe.where("outcome = 'ok'").select("path")).select("path", F.lit(True).alias("_art"))
        opened_art = probe.select("path").join(art, "path", "left").select("path", F.coalesce("_art", F.lit(False)).alias("opened"))
        known = catalogue.covers(here).join(here.select("id", "path"), "id").join(opened_art, "path", "left").select(F.col("path").alias("film"), F.col("cover").alias("recorded"), "opened")
        decided = covers.chosen(known, offered, thumbs).join(here.select("id", F.col("path").alias("film")), "film").select("id", "cover")
        final = written(mutations.set_covers(now_films, decided).drop("changed"), "final")
        now_tracks = written(now_tracks, "now_tracks")
        gone = written(tracks.select("id").join(now_tracks.select("id"), "id", "left_anti"), "gone")
        # films first, as tracks refer to them, with the choices that still hold; then the tracks that were read, in packs; then what went
        self._write({"film": final, "audio_stream": now_audio}, f"scan-{folder_id}-{now}-films")
        fresh = written(made.select("id").unionByName(streams.select("id")).distinct(), "fresh")
        packs = written(mutations.packed(now_tracks.join(fresh, "id", "left_semi"), *self.pack), "packs")
        read_cues = written(made_cues.unionByName(stream_cues), "read_cues")
        for pack in sorted(r.pack for r in packs.select("pack").distinct().collect()):  # as many as a scan has commits
            own = packs.where(F.col("pack") == pack).drop("pack")
            self._replaced(own, read_cues.join(own.select(F.col("id").alias("track_id")), "track_id", "left_semi"), f"scan-{folder_id}-{now}-{pack}")
        if not gone.isEmpty():
            self._replaced(gone, no_cues, f"scan-{folder_id}-{now}-gone")
        moved = written(now_tracks.join(fresh, "id", "left_anti"), "moved")  # pairs that other films have now
        self._changed("subtitle_track", moved.select("id"), lambda stored: mutations.set_columns(stored, "id", moved, [c for c in moved.columns if c != "id"]))
        self.left_out = closed.select("path", F.lit("unreadable").alias("outcome")).unionByName(held.where("outcome <> 'ok'").select("path", "outcome")).unionByName(looked.where("outcome <> 'ok'").select("path", "outcome"))
        return self._counted(files, root, jobs.count(), read.count(), removed.count())

    def _replaced(self, own: DataFrame, cues: DataFrame, batch: str) -> None:
        """One commit of tracks (id, or whole rows) and their cues in place of what is stored of them; of ids alone, nothing in their place."""
        touched = self.store.buckets_of("cue", own.select("id"))
        stored, said = self.store.read("subtitle_track", touched), self.store.read("cue", touched)
        kept = upserts.without(stored, own, "id", "id")
        self._write({"subtitle_track": tables.Part(kept.unionByName(own.select(stored.columns)) if len(own.columns) > 1 else kept, touched), "cue": tables.Part(upserts.without(said, own, "track_id", "id").unionByName(cues.select(said.columns)), touched)}, batch)

    def _counted(self, files: DataFrame, root: str, opened: int, read: int, removed: int) -> DataFrame:
        """One row: what was found under a root and what was done about it. ``left_out`` has the paths (path, outcome) that couldn't be read."""
        total = catalogue.scan_counts(files.withColumn("folder", F.lit(root)))
        return total.withColumns({"opened": F.lit(opened), "read": F.lit(read), "removed": F.lit(removed), "unreadable": F.lit(self.left_out.count())})

    def scan_containing(self, paths: DataFrame, now: int) -> list[int]:
        """Scans the watched folders that hold one of the paths (path); their ids."""
        ids = sorted(r.id for r in catalogue.touched_folders(self.table("watched_folder"), paths).select("id").collect())  # watched folders are few
        for i in ids:
            self.scan(i, now)
        return ids

    # ---- what a person does ----

    def save_position(self, film_id: int, position_ms: int, duration_ms: int | None, finished: bool, now: int) -> bool:
        fresh = self.spark.createDataFrame([(film_id, position_ms, duration_ms, finished, now)], tables.SCHEMAS["playback_position"])
        return self._changed("playback_position", fresh.select("film_id"), lambda stored: mutations.saved_positions(stored, fresh))

    def set_preference(self, key: str, value: str | None) -> None:
        """Stores a preference; None forgets it."""
        fresh = self.spark.createDataFrame([(key, value)], tables.SCHEMAS["preference"])
        self.store.write("preference", written(mutations.saved_preferences(self.table("preference"), fresh), "preferences"))

    def correct(self, track_id: int, offset_ms: int, rate: float) -> bool:
        fresh = self.spark.createDataFrame([(track_id, offset_ms, rate)], "id long, offset_ms int, rate double")
        return self._changed("subtitle_track", fresh.select("id"), lambda stored: mutations.with_corrections(stored, fresh))

    def choose_track(self, film_id: int, track_id: int | None, off: bool = False) -> bool:
        """A film's track, no subtitles, or no choice. Another film's track is Refused."""
        fresh = self.spark.createDataFrame([(film_id, track_id, off)], "id long, track_id long, off boolean")
        tracks = self.table("subtitle_track").where(F.col("id").eqNullSafe(F.lit(track_id).cast("long")))
        if track_id is not None and not off and tracks.where(F.col("film_id") == film_id).isEmpty():
            raise mutations.Refused(f"track {track_id} isn't film {film_id}'s")
        return self._changed("film", fresh.select("id"), lambda stored: mutations.chosen_tracks(stored, tracks, fresh).drop("refused"))

    def choose_cover(self, film_id: int, path: str | None) -> bool:
        """A picture for a film, which stays until it is cleared by None."""
        fresh = self.spark.createDataFrame([(film_id, (path, "chosen") if path else None)], "id long, cover struct<path: string, source: string>")
        return self._changed("film", fresh.select("id"), lambda stored: mutations.set_covers(stored, fresh))

    def covers_from_folder(self, folder: str) -> bool:
        """Chosen covers for all films that a picture in a folder is named after."""
        files = self.spark.read.format("folder").load(folder).where(F.col("readable") & (file_kind(base_name(F.col("path"))) == "image"))
        films = self.table("film").select("id", F.col("path").alias("film"), parsed_name(base_name(F.col("path"))).alias("n")).select("id", "film", "n.key", "n.year")
        found = covers.from_folder(films, ranged.contents(files.select("path")).where("outcome = 'ok'").select("path", "content"))
        fresh = written(found.join(films.select("id", "film"), "film").select("id", "cover"), "covers")
        return self._changed("film", fresh.select("id"), lambda stored: mutations.set_covers(stored, fresh))

    def cover_image(self, film_id: int) -> bytes | None:
        """The bytes of a film's cover: the picture it is chosen from, or the one inside the film; None without one, or where it can't be read."""
        film = self.table("film").where(F.col("id") == film_id).select("path", "cover_path", "cover_source").first()
        if film is None or film.cover_path is None:
            return None
        if film.cover_source == "in-file":
            row = matroska.artwork(self.spark.createDataFrame([(film.path,)], "path string")).first()
        else:
            row = ranged.contents(self.spark.createDataFrame([(film.cover_path,)], "path string")).first()
        return bytes(row.content) if row and row.content is not None else None

    def posters_wanted(self, directory: str) -> DataFrame:
        """(id, path, cover) of films whose cached picture in a directory is stale or isn't there."""
        cached = self.spark.read.format("folder").load(directory).where("readable").select("path")
        return covers.posters_wanted(self.table("film"), cached, directory)

    def save_poster(self, film_id: int, path: str, accent: str | None) -> bool:
        """A film's cached picture and its two colours, which are Refused if they aren't two."""
        row = self.spark.createDataFrame([(film_id, path, accent)], "id long, poster_path string, accent string")
        if accent is not None and not row.where(labels.colour_pair(F.col("accent")).isNull()).isEmpty():
            raise mutations.Refused("that is not a pair of colours")
        return self._changed("film", row.select("id"), lambda stored: mutations.set_columns(stored, "id", row, ["poster_path"], ["accent"]))

    def attach(self, film_id: int, path: str, now: int) -> None:
        """Gives a subtitle file to a film by hand."""
        text = written(subtitles.decoded(ranged.contents(self.spark.createDataFrame([(path,)], "path string")).where("outcome = 'ok'").drop("outcome")), "text")
        cues = written(subtitles.parsed(text)[0], "cues")
        tracks = self.table("subtitle_track")
        named = text.select("path", "encoding", F.octet_length("text").cast("long").alias("size_bytes"), parsed_name(base_name(F.col("path"))).alias("n"))
        row = named.select(F.lit(None).cast("long").alias("id"), F.lit(film_id).cast("long").alias("film_id"), "path", F.lit("sidecar").alias("origin"), F.lit(0).cast("long").alias("stream_number"), F.lit("subrip").alias("codec"), "n.language", "n.forced", "n.hearing_impaired", F.lit("by-hand").alias("match_kind"), "encoding", F.lit(cues.count()).cast("long").alias("cue_count"), "size_bytes", F.lit(now).cast("long").alias("modified_at"), F.lit(0).alias("offset_ms"), F.lit(1.0).alias("rate"))
        row = written(mutations.numbered_ids(tracks, row, ["path", "stream_number"]), "row")
        touched = self.store.buckets_of("cue", row.select("id"))  # both tables are dealt by the track's id
        new, said = mutations.attached(self.store.read("subtitle_track", touched), self.store.read("cue", touched), self.table("film"), film_id, row, cues.join(row.select("path", F.col("id").alias("track_id")), "path"))
        self._write({"subtitle_track": tables.Part(new, touched), "cue": tables.Part(said, touched)})

    def cancel_alignment(self) -> None:
        """Films that are being listened to, or still to come, have the outcome "stopped"; what was measured before stays."""
        if self.listening:
            self.listening.stop()

    def alignment_progress(self) -> float:
        """The share of the films' sound that was listened to, while align_all() runs in another thread."""
        return self.listening.fraction if self.listening else 0.0

    def align(self, track_id: int) -> str:
        """align_all() of one track; its outcome."""
        asked = self.spark.createDataFrame([(track_id,)], "track_id long")
        return self.align_all(asked).first().outcome

    def align_all(self, wanted: DataFrame | None = None) -> DataFrame:
        """Measures tracks (track_id; all of them if none are given) against another track of their film, else its sound, and corrects those that land better.

        The outcome of each (``decisions.outcomes``). All corrections are one write.
        """
        return self.aligning.run(lambda: self._align(wanted))

    def _align(self, wanted: DataFrame | None) -> DataFrame:
        self.listening = Watch(self.spark)
        decided = written(decisions.outcomes(self.table("subtitle_track"), self.table("cue"), self._listened, wanted), "outcomes")
        fresh = decisions.corrections(decided)
        self._changed("subtitle_track", fresh.select("id"), lambda stored: mutations.with_corrections(stored, fresh))
        return decided

    def _listened(self, films: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(film_id, outcome) and speech (film, from_bin, to_bin, film_bins) of films (film_id), read once each."""
        paths = written(self.table("film").select(F.col("id").alias("film_id"), "path").join(films, "film_id", "left_semi"), "paths")
        energy = written(audio.energy_at(paths.select("path"), watch=self.listening).join(paths.withColumnRenamed("path", "film"), "film"), "energy")
        said = energy.groupBy("film_id").agg(F.coalesce(F.max(F.when(F.col("outcome") != "ok", F.col("outcome"))), F.lit("ok")).alias("outcome"))
        level = written(alignment.levels(energy.where("outcome = 'ok' AND bin IS NOT NULL").withColumn("film", F.col("film_id"))), "levels")
        length = level.groupBy("film").agg((F.max("bin") + 1).alias("film_bins"))
        return said, alignment.speech(level).join(length, "film")

    def _changed(self, name: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Commits the buckets of a table that hold keys, after make(), whose rows say whether they changed; if one did."""
        part = self.store.part(name, keys, make)
        held = written(part.rows, name)
        if held.where("changed").isEmpty():
            return False
        self.store.commit({name: tables.Part(held, part.buckets)})
        return True
