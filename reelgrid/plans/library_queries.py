"""Queries of the library's tables, which are made of the driver's by expressions that Spark and the SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import labels, names, text, timing
from reelgrid.operators import alignment, catalogue, covers, evaluation, library, mutations, series, upserts
from reelgrid.plans.queries import query, read

SOURCES = "CASE c_custkey % 7 WHEN 0 THEN 'chosen' WHEN 1 THEN 'in-file' WHEN 2 THEN 'beside' WHEN 3 THEN 'sidecar' WHEN 4 THEN 'folder-above' WHEN 5 THEN 'none' ELSE 'odd' END"
FILMS = {
    "id": "c_custkey", "folder_id": "CAST(c_nationkey AS BIGINT)", "path": "'/n' || CAST(c_nationkey AS VARCHAR(9)) || '/' || c_mktsegment || '/' || c_name || '.mkv'",
    "title": "CASE c_custkey % 4 WHEN 0 THEN 'The ' || c_mktsegment WHEN 1 THEN 'a ' || c_mktsegment || ' ' || CAST(c_custkey % 30 AS VARCHAR(9)) ELSE c_mktsegment || ' ' || c_name END",
    "year": "CASE WHEN c_custkey % 5 <> 0 THEN CAST(1950 + c_custkey % 70 AS INT) END", "size_bytes": "CAST(floor((c_acctbal + 2000) * 100000) AS BIGINT)", "modified_at": "1700000000000 + c_custkey * 1000",
    "duration_ms": "CASE WHEN c_custkey % 6 <> 0 THEN 3600000 + (c_custkey % 97) * 60000 END", "missing_since": "CASE WHEN c_custkey % 11 = 0 THEN CAST(5 AS BIGINT) END",
    "added_at": "1700000000000 + c_custkey * 3600000", "chosen_track_id": "CASE WHEN c_custkey % 9 = 0 THEN c_custkey * 10 END", "subtitles_off": "c_custkey % 13 = 0",
    "probed_at": "CASE WHEN c_custkey % 3 <> 0 THEN CAST(7 AS BIGINT) END", "cover_path": "CASE WHEN c_custkey % 4 <> 0 THEN '/c/' || CAST(c_custkey AS VARCHAR(9)) END",
    "container": "CASE WHEN c_custkey % 8 <> 0 THEN 'Matroska' END", "video_codec": "CASE WHEN c_custkey % 8 <> 0 THEN 'HEVC' END", "video_width": "CAST(c_custkey % 5 * 640 AS INT)",
    "video_height": "CAST(c_custkey % 5 * 360 AS INT)", "bit_depth": "CAST(CASE c_custkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 10 ELSE 300 END AS INT)",
    "frame_rate": "CASE WHEN c_custkey % 2 = 0 THEN CAST(25 AS DOUBLE) ELSE CAST(23.976 AS DOUBLE) END", "cover_source": SOURCES,
}
TRACKS = {
    "id": "o_orderkey", "film_id": "o_custkey", "path": "'/s/' || CAST(o_orderkey AS VARCHAR(9)) || '.srt'", "origin": "CASE WHEN o_orderkey % 3 = 0 THEN 'stream' ELSE 'sidecar' END",
    "stream_number": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 + 1 ELSE CAST(0 AS BIGINT) END", "codec": "CASE o_orderkey % 5 WHEN 0 THEN 'subrip' WHEN 1 THEN 'ass' WHEN 2 THEN 'webvtt' WHEN 3 THEN 'pgs' ELSE 'odd' END",
    "language": "CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' END", "forced": "o_orderkey % 7 = 0", "hearing_impaired": "o_orderkey % 6 = 0",
    "match_kind": "CASE WHEN o_orderkey % 10 = 0 THEN 'by-hand' ELSE 'exact' END", "encoding": "'utf-8'", "cue_count": "CAST(floor(o_totalprice / 1000) AS BIGINT)", "size_bytes": "CAST(floor(o_totalprice) AS BIGINT)",
    "modified_at": "CAST(1 AS BIGINT)", "offset_ms": "CAST((o_orderkey % 5 - 2) * 500 AS INT)", "rate": "CASE WHEN o_orderkey % 9 = 0 THEN 25.0E0 / 23.976E0 ELSE 1.0E0 END",
}
POSITIONS = {"film_id": "c_custkey", "position_ms": "(c_custkey * 7919) % 3700000", "duration_ms": "CASE WHEN c_custkey % 4 <> 0 THEN CAST(3600000 AS BIGINT) END", "finished": "c_custkey % 5 = 1", "updated_at": "1700000000000 + c_custkey * 77"}
AUDIO = {"film_id": "p_partkey % 700", "stream_number": "CAST(floor(p_partkey / 700) AS BIGINT) + 1", "codec": "CASE WHEN p_size > 25 THEN 'AC-3' ELSE 'DTS' END", "channels": "CASE p_size % 4 WHEN 0 THEN CAST(2 AS INT) WHEN 1 THEN CAST(6 AS INT) WHEN 2 THEN CAST(3 AS INT) END", "language": "CASE WHEN p_size % 3 = 0 THEN 'de' END", "is_default": "p_partkey < 700"}


def made(columns: dict[str, str], source: str, where: str = "TRUE") -> str:
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {where})"


def taken(spark: SparkSession, d: str, columns: dict[str, str], source: str, where: str = "TRUE") -> DataFrame:
    return read(spark, d, source).where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def films(spark, d):
    return taken(spark, d, FILMS, "customer")


def tracks(spark, d):
    return taken(spark, d, TRACKS, "orders")


def positions(spark, d):
    return taken(spark, d, POSITIONS, "customer", "c_custkey % 3 = 1")


def audio(spark, d):
    return taken(spark, d, AUDIO, "part")


F_, T_, P_, A_ = made(FILMS, "customer"), made(TRACKS, "orders"), made(POSITIONS, "customer", "c_custkey % 3 = 1"), made(AUDIO, "part")
CUES = """(SELECT user_id AS track_id, CAST(event_id AS INT) AS ordinal, (epoch_us(ts) // 1000) % 7200000 AS start_ms, (epoch_us(ts) // 1000) % 7200000 + 900 + event_id % 5 * 400 AS end_ms, CAST(event_id % 12 AS INT) AS position, 'line' AS text FROM events)"""


def track_cues(spark, d):
    at = F.unix_millis(F.col("ts").cast("timestamp")) % 7_200_000
    return read(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").cast("int").alias("ordinal"), at.alias("start_ms"), (at + 900 + F.col("event_id") % 5 * 400).alias("end_ms"), (F.col("event_id") % 12).cast("int").alias("position"), F.lit("line").alias("text"))


TODAY = "DATE '2023-12-20'"


def today():
    return F.to_date(F.lit("2023-12-20"))


# ---- reads ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, path, title FROM {F_} WHERE folder_id = 3 AND year IS NULL")
def point_lookup(spark, d):
    return catalogue.matching(films(spark, d), folder_id=3, year=None).select("id", "path", "title")


@query(f"SELECT id, 'unprobed' AS why FROM {F_} WHERE folder_id = 3 AND probed_at IS NULL UNION ALL SELECT id, 'undescribed' FROM {F_} WHERE folder_id = 3 AND container IS NULL")
def films_to_open(spark, d):
    f = films(spark, d)
    return catalogue.unprobed(f, 3).withColumn("why", F.lit("unprobed")).unionByName(catalogue.undescribed(f, 3).withColumn("why", F.lit("undescribed")))


@query(f"SELECT id, path, size_bytes, modified_at, missing_since IS NOT NULL AS missing FROM {F_}")
def film_fingerprints(spark, d):
    return catalogue.fingerprints(films(spark, d))


@query(f"SELECT id, cover_path AS path, CASE WHEN cover_path IS NOT NULL THEN CASE WHEN cover_source = 'odd' THEN 'none' ELSE cover_source END END AS source FROM {F_}")
def cover_projection(spark, d):
    return catalogue.covers(films(spark, d)).select("id", "cover.path", "cover.source")


@query(f"""SELECT id, video_codec AS codec, CASE WHEN video_codec IS NOT NULL AND video_width > 0 THEN CAST(video_width AS BIGINT) ELSE -1 END AS width, CASE WHEN video_codec IS NOT NULL AND bit_depth <= 255 THEN bit_depth ELSE -1 END AS bit_depth,
    CASE WHEN video_codec IS NOT NULL THEN frame_rate END AS frame_rate FROM {F_}""")
def video_projection(spark, d):
    return catalogue.video(films(spark, d)).select("id", "video.codec", "video.width", "video.bit_depth", "video.frame_rate").fillna(-1, ["width", "bit_depth"])


@query(f"""SELECT c.track_id, row_number() OVER (PARTITION BY c.track_id ORDER BY c.start_ms, c.ordinal) AS place, x.start_ms, x.end_ms, CASE WHEN position BETWEEN 1 AND 9 THEN position ELSE -1 END AS position FROM {CUES} c JOIN {T_} t ON t.id = c.track_id,
    LATERAL (SELECT CAST(CASE WHEN t.offset_ms = 0 AND t.rate = 1 THEN c.start_ms ELSE round(greatest(0, c.start_ms * t.rate + t.offset_ms)) END AS BIGINT) AS start_ms, CAST(CASE WHEN t.offset_ms = 0 AND t.rate = 1 THEN c.end_ms ELSE round(greatest(0, c.end_ms * t.rate + t.offset_ms)) END AS BIGINT) AS end_ms) x""")
def corrected_cues(spark, d):
    return catalogue.cues(track_cues(spark, d), tracks(spark, d)).drop("text").fillna(-1, ["position"])


@query(f"SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, ordinal) AS place, start_ms, end_ms FROM {CUES} WHERE track_id IN (SELECT id FROM {T_})")
def authored_cues(spark, d):
    return catalogue.cues(track_cues(spark, d), tracks(spark, d), authored=True).select("track_id", "place", "start_ms", "end_ms")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS place FROM supplier")
def folder_list(spark, d):
    w = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("added_at"), F.col("s_name").alias("path"))
    listed = series.placed(catalogue.folders(w).select("id", "added_at"), [], ["added_at", "id"], 4)
    return listed.select("id", (F.col("place") + 1).alias("place"))


@query(f"SELECT film_id, position_ms, coalesce(duration_ms, -1) AS duration_ms FROM {P_} WHERE film_id = 4")
def position_lookup(spark, d):
    return catalogue.matching(positions(spark, d), film_id=4).select("film_id", "position_ms", "duration_ms").fillna(-1, ["duration_ms"])


@query(f"SELECT id FROM {F_} WHERE folder_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND missing_since IS NULL")
def films_in_folders(spark, d):
    chosen = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return catalogue.present(catalogue.in_folders(films(spark, d), chosen)).select("id")


@query(f"""WITH f AS (SELECT id, folder_id, title, year, row_number() OVER (PARTITION BY folder_id ORDER BY title NULLS FIRST, year NULLS FIRST, id) AS place FROM {F_}) SELECT id, place FROM f""")
def stored_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("folder_id").orderBy(F.asc_nulls_first("title"), F.asc_nulls_first("year"), "id")
    return catalogue.listed(films(spark, d)).select("id", F.row_number().over(w).cast("long").alias("place"))


FILED = "CASE WHEN lower(title) LIKE 'the %' THEN substr(title, 5) WHEN lower(title) LIKE 'a %' THEN substr(title, 3) ELSE title END"
PADDED = f"(SELECT id, lower(regexp_replace({FILED}, '[0-9]+$', '')) || CASE WHEN regexp_matches({FILED}, '[0-9]+$') THEN lpad(regexp_extract({FILED}, '[0-9]+$'), 12, '0') ELSE '' END AS filed FROM {F_})"


def _order_sql(key: str, descending: bool) -> str:
    return f"""WITH p AS {P_}, f AS (SELECT f.*, k.filed, p.position_ms, p.finished, coalesce(p.duration_ms, f.duration_ms) AS watched FROM {F_} f JOIN {PADDED} k USING (id) LEFT JOIN p ON p.film_id = f.id)
        SELECT id, folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY {key} {"DESC" if descending else "ASC"} NULLS LAST, filed, title, id) AS place FROM f"""


def views(spark, d):
    p = positions(spark, d).withColumnRenamed("duration_ms", "watched_ms").withColumnRenamed("film_id", "id").drop("updated_at")
    return films(spark, d).join(p, "id", "left").withColumn("shelf", F.element_at(F.split("path", "/"), 3))


def _ordered(name: str, descending: bool):
    def run(spark, d):
        return catalogue.places(views(spark, d), name, descending)

    run.__name__ = f"order_by_{name}"
    return run


for _name, _key, _down in (
    ("title", "filed", True), ("folder", "lower(split_part(path, '/', 3))", False), ("year", "year", True), ("runtime", "duration_ms", False), ("video", "video_height", True),
    ("size", "CASE WHEN container IS NOT NULL THEN size_bytes END", True), ("added", "added_at", True),
    ("watched", "CASE WHEN position_ms IS NOT NULL THEN CASE WHEN finished THEN 1.0::DOUBLE WHEN watched > 0 THEN least(1.0::DOUBLE, position_ms / watched::DOUBLE) END END", False),
):
    query(_order_sql(_key, _down))(_ordered(_name, _down))


@query(f"""WITH s AS (SELECT split_part(path, '/', 3) AS key, list_sort(list(id)) AS ids, min(id) AS first FROM {F_} GROUP BY 1), r AS (SELECT list(film_id ORDER BY updated_at DESC, film_id) AS ids FROM {P_} WHERE NOT finished),
    b AS (SELECT 'carrying-on' AS key, 'Carry on watching' AS name, 0 AS late, CAST(0 AS BIGINT) AS first, ids FROM r UNION ALL SELECT key, key, 1, first, ids FROM s)
    SELECT key, name, row_number() OVER (ORDER BY late, first) AS place, len(ids) AS n, array_to_string(ids[1:12], ',') AS head FROM b""")
def shelves_with_resume(spark, d):
    f = films(spark, d).withColumn("shelf", F.element_at(F.split("path", "/"), 3)).withColumn("shelf_path", F.col("shelf"))
    got = catalogue.shelves(f, positions(spark, d).where("NOT finished"))
    return got.select("key", "name", "place", "n", F.array_join("film_ids", ",").alias("head"))


@query(f"SELECT id, (row_number() OVER (PARTITION BY folder_id ORDER BY title, id) - 1) // 7 AS line, (row_number() OVER (PARTITION BY folder_id ORDER BY title, id) - 1) % 7 AS at FROM {F_}")
def tile_grid(spark, d):
    return catalogue.grid(films(spark, d), ["folder_id"], ["title", "id"], 7).select("id", "line", "at")


@query("SELECT p_partkey, greatest(1, CAST(floor((p_retailprice + 16) / (180 + 16)) AS BIGINT)) AS across FROM part")
def tile_columns(spark, d):
    return read(spark, d, "part").select("p_partkey", catalogue.columns_for(F.col("p_retailprice"), 180, 16).alias("across"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def command_search(spark, d):
    return catalogue.commands_matching(read(spark, d, "part").select("p_partkey", "p_name"), " RÍng ", "p_name")


@query(f"""SELECT cover_source AS source, CASE cover_source WHEN 'chosen' THEN 0 WHEN 'in-file' THEN 1 WHEN 'beside' THEN 2 WHEN 'sidecar' THEN 3 ELSE 4 END AS place, count(*) AS n, CAST(min_by(cover_path, id) FILTER (cover_path IS NOT NULL) AS VARCHAR) AS example FROM {F_} WHERE cover_source NOT IN ('none', 'odd') GROUP BY 1, 2
    UNION ALL SELECT 'left over', 5, count(*), NULL FROM {F_} WHERE cover_source = 'none'""")
def cover_places(spark, d):
    tally, rest = catalogue.cover_tally(films(spark, d))
    over = rest.agg(F.count("*").alias("n")).select(F.lit("left over").alias("source"), F.lit(5).cast("long").alias("place"), "n", F.lit(None).cast("string").alias("example"))
    return tally.unionByName(over).withColumn("place", F.col("place").cast("int"))


@query(f"SELECT film_id, CAST(sum(cue_count) AS BIGINT) AS lines FROM {T_} GROUP BY 1")
def lines_of_films(spark, d):
    return catalogue.lines_of(tracks(spark, d))


@query("""WITH f AS (SELECT 'f' || (o_orderkey % 20) AS folder, CASE o_orderkey % 6 WHEN 0 THEN 'film' WHEN 1 THEN 'film' WHEN 2 THEN 'subtitle' WHEN 3 THEN 'image' WHEN 4 THEN 'sidecar' END AS kind, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders)
    SELECT folder, count(*) FILTER (kind = 'film') AS films, count(*) FILTER (kind = 'subtitle') AS subtitles, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'sidecar') AS sidecars, count(*) FILTER (kind IS NULL) AS other, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM f GROUP BY 1""")
def scan_counters(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("film", "film", "subtitle", "image", "sidecar", None))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return catalogue.scan_counts(read(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 20).alias("folder"), kind.alias("kind"), F.floor("o_totalprice").alias("size_bytes")))


@query(f"""WITH t AS {T_}, u AS (SELECT * FROM t WHERE codec IN ('subrip', 'ass', 'webvtt') AND cue_count >= 100),
    r AS (SELECT t.id AS track_id, u.id AS reference_id, row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN u.origin = 'stream' THEN 0 ELSE 1 END, u.cue_count DESC, u.id) AS k FROM t LEFT JOIN u ON u.film_id = t.film_id AND u.id <> t.id) SELECT track_id, coalesce(reference_id, -1) AS reference_id FROM r WHERE k = 1""")
def best_reference(spark, d):
    return catalogue.best_reference(tracks(spark, d)).fillna(-1, ["reference_id"])


@query(f"""WITH a AS (SELECT film_id, 0 AS k, stream_number AS n, 'sound-' || CAST(row_number() OVER (PARTITION BY film_id ORDER BY stream_number) AS VARCHAR) AS key, CASE WHEN language = 'de' THEN 'German' END AS language, CASE channels WHEN 2 THEN 'Stereo' WHEN 6 THEN '5.1' WHEN 3 THEN '3 channels' END AS what, CASE WHEN is_default THEN 'Default' END AS state FROM {A_}),
    s AS (SELECT film_id, 1 AS k, id AS n, 'subtitle-' || id AS key, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'xx' THEN 'XX' END AS language,
      concat_ws(' · ', CASE WHEN origin = 'stream' THEN 'Inside the film' ELSE 'Beside the film' END, CASE WHEN cue_count > 0 THEN cue_count || ' lines' END, CASE WHEN forced THEN 'Forced' END, CASE WHEN hearing_impaired THEN 'For the hard of hearing' END) AS what,
      CASE WHEN codec = 'pgs' THEN 'Pictures, not text' WHEN codec = 'odd' THEN 'Not a subtitle format that can be read' WHEN id % 50 = 0 THEN 'Chosen' END AS state FROM {T_})
    SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY k, n) AS place, key, language, what, state FROM (SELECT * FROM a UNION ALL SELECT * FROM s)""")
def track_rows(spark, d):
    active = tracks(spark, d).where("id % 50 = 0").select("film_id", F.col("id").alias("track_id"))
    return catalogue.track_rows(audio(spark, d), tracks(spark, d), active).select("film_id", "place", "key", "language", "what", "state")


# ---- labels --------------------------------------------------------------------------------------------------------------


@query(f"""SELECT id, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'xx' THEN 'XX' ELSE CASE WHEN origin = 'stream' THEN 'Track ' || stream_number ELSE id || '.srt' END END AS name,
    nullif(concat_ws(' · ', CASE WHEN origin = 'stream' THEN 'Inside the film' END, CASE WHEN forced THEN 'Forced' END, CASE WHEN hearing_impaired THEN 'For the hard of hearing' END), '') AS note FROM {T_}""")
def track_labels(spark, d):
    return tracks(spark, d).select("id", labels.track_name(F.col("language"), F.col("origin"), F.col("stream_number"), F.col("path")).alias("name"), labels.track_note(F.col("origin"), F.col("forced"), F.col("hearing_impaired")).alias("note"))


DAY = "CAST(make_timestamp({0} * 1000) AS DATE)"
DATED = "CAST(day({0}) AS VARCHAR) || ' ' || strftime({0}, '%b') || CASE WHEN year({0}) = 2023 THEN '' ELSE ' ' || year({0}) END".format(DAY.format("added_at"))


@query(f"""SELECT id, {DATED} AS added, CASE WHEN date_diff('day', {DAY.format("added_at")}, {TODAY}) <= 0 THEN 'Stopped today' WHEN date_diff('day', {DAY.format("added_at")}, {TODAY}) = 1 THEN 'Stopped yesterday' ELSE 'Stopped on ' || {DATED} END AS stopped FROM {F_}""")
def date_labels(spark, d):
    return films(spark, d).select("id", labels.date_label(F.col("added_at"), today()).alias("added"), labels.stopped_label(F.col("added_at"), today()).alias("stopped"))


SIZED = "CASE WHEN size_bytes >= 1000000000 THEN printf('%.1f GB', size_bytes / 1e9) WHEN size_bytes >= 1000000 THEN CAST(CAST(round(size_bytes / 1e6) AS BIGINT) AS VARCHAR) || ' MB' WHEN size_bytes >= 1000 THEN CAST(CAST(round(size_bytes / 1e3) AS BIGINT) AS VARCHAR) || ' kB' ELSE size_bytes || ' bytes' END"


@query(f"""WITH f AS (SELECT *, CAST(floor(CAST(size_bytes AS DECIMAL(24, 0)) * 8000 / duration_ms) AS BIGINT) AS bits FROM {F_}),
    r AS (SELECT id, unnest([struct_pack(label := 'Container', value := container), struct_pack(label := 'Video', value := video_codec), struct_pack(label := 'Resolution', value := video_width || ' × ' || video_height), struct_pack(label := 'Bit depth', value := bit_depth || '-bit'),
      struct_pack(label := 'Frame rate', value := CASE WHEN frame_rate = 25 THEN '25 fps' ELSE '23.976 fps' END), struct_pack(label := 'Average bitrate', value := CASE WHEN bits >= 1000000 THEN printf('%.1f Mb/s', bits / 1e6) WHEN bits > 0 THEN CAST(round(bits / 1e3) AS BIGINT) || ' kb/s' END),
      struct_pack(label := 'Size', value := CASE WHEN container IS NOT NULL THEN {SIZED} END), struct_pack(label := 'Added', value := {DATED}), struct_pack(label := 'Path', value := path)]) AS x FROM f) SELECT id, x.label, x.value FROM r WHERE x.value IS NOT NULL AND x.value <> ''""")
def fact_rows(spark, d):
    f = films(spark, d).withColumn("bitrate", timing.bitrate(F.col("size_bytes"), F.col("duration_ms")))
    held = {c: F.col(c) for c in ("container", "video_codec", "video_width", "video_height", "bit_depth", "frame_rate", "bitrate", "size_bytes", "added_at", "path")}
    return f.select("id", F.inline(labels.facts(held, today())))


@query(f"""SELECT id, CASE WHEN cover_path IS NULL THEN 'composed' WHEN cover_source <> 'none' THEN 'artwork' WHEN subtitles_off THEN 'frame' ELSE 'composed' END AS picture,
    CASE cover_source WHEN 'chosen' THEN 'Your choice' WHEN 'in-file' THEN 'Inside the film' WHEN 'beside' THEN 'Beside the film' WHEN 'sidecar' THEN 'From a media manager' WHEN 'folder-above' THEN 'From the folder above' WHEN 'none' THEN 'From the film itself' END AS cover FROM {F_}""")
def picture_labels(spark, d):
    return films(spark, d).select("id", labels.picture_kind(F.col("cover_path"), F.col("cover_source"), F.col("subtitles_off")).alias("picture"), labels.cover_name(F.col("cover_source")).alias("cover"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'aborted' WHEN 2 THEN 'the file went away' WHEN 3 THEN 'decoding failed; suspect ' || k WHEN 4 THEN 'not supported; suspect ' || k ELSE 'unknown error' END AS why
    FROM (SELECT o_orderkey, ['HEVC or DTS', 'an old codec', 'HEVC', 'a damaged copy', 'an unknown format'][o_orderkey % 5 + 1] AS k FROM orders)""")
def unplayable_sentences(spark, d):
    e = F.element_at(F.array(*(F.lit(x) for x in ("a.MKV", "b.avi", "c.mov", "d.webm", "e.ogv"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", labels.unplayable_sentence(F.col("o_orderkey") % 6, e).alias("why"))


@query("""WITH o AS (SELECT o_orderkey AS k, ['aligned', 'no-better', 'too-few-cues', 'no-audio', 'uncertain', 'breaks', 'stopped'][o_orderkey % 7 + 1] AS said, (o_orderkey % 41 - 20) * 250 AS ms, o_orderkey % 90 AS n, o_orderkey % 3 AS examined, (o_orderkey % 100) / 100.0 AS b FROM orders),
    m AS (SELECT *, CASE WHEN ms < 0 THEN '−' WHEN ms > 0 THEN '+' ELSE '' END || printf('%.2f s', abs(ms) / 1000.0) AS moved, CASE WHEN examined > 0 THEN 'on time as written: ' || CAST(round(b * 100) AS BIGINT) || ' %' END AS share FROM o)
    SELECT k, CASE said WHEN 'aligned' THEN 'Lined up' WHEN 'no-better' THEN 'No better than it is' WHEN 'too-few-cues' THEN 'Not enough to go on' WHEN 'no-audio' THEN 'Nothing to listen to' WHEN 'uncertain' THEN 'Not sure enough to say' WHEN 'breaks' THEN 'This film has breaks in it' ELSE 'Stopped' END AS title,
    CASE said WHEN 'aligned' THEN concat_ws('; ', 'moved by ' || moved, 'on time if moved: 90 %', share) WHEN 'no-better' THEN concat_ws('; ', CASE WHEN examined > 0 THEN 'on time if moved: 90 %' ELSE 'no speech near any line' END, share)
      WHEN 'too-few-cues' THEN n || ' lines of the 100 that are needed' WHEN 'no-audio' THEN 'the film is silent' WHEN 'uncertain' THEN concat_ws('; ', 'no shift fits', share)
      WHEN 'breaks' THEN concat_ws('; ', 'fits up to ' || (n // 60) || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || ', a constant step after', share) ELSE 'stopped before the end' END AS sentence FROM m""")
def outcome_sentences(spark, d):
    said = F.element_at(F.array(*(F.lit(x) for x in ("aligned", "no-better", "too-few-cues", "no-audio", "uncertain", "breaks", "stopped"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), said.alias("outcome"), ((F.col("o_orderkey") % 41 - 20) * 250).alias("offset_ms"), (F.col("o_orderkey") % 90).alias("n_cues"), (F.col("o_orderkey") % 3).alias("examined"), (F.col("o_orderkey") % 100 / 100.0).alias("before"))
    given = {c: F.col(c) for c in o.columns} | {"rate": F.lit(1.0), "after": F.lit(0.9), "at_ms": F.col("n_cues") * 1000, "codec": F.lit(None), "message": F.lit(None).cast("string"), "agreed": F.lit(0), "across": F.lit(0), "spread_ms": F.lit(0), "against": F.lit(None).cast("string")}
    return o.select("k", labels.outcome_title(F.col("outcome")).alias("title"), labels.outcome_sentence(given).alias("sentence"))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_size * 40 AS DOUBLE) AS w, CAST(p_partkey % 50 * 30 AS DOUBLE) AS h FROM part), c AS (SELECT *, least(w, h * (2.0::DOUBLE / 3)) AS x FROM p)
    SELECT k, CASE WHEN w > 0 AND h > 0 THEN CAST(floor((w - x) / 2 + 0.5) AS BIGINT) ELSE 0 END AS x, CASE WHEN w > 0 AND h > 0 THEN CAST(floor(x + 0.5) AS BIGINT) ELSE 0 END AS width,
    CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN floor(320 * h / w + 0.5) <= 480 THEN 320 ELSE greatest(1, CAST(floor(480 * w / h + 0.5) AS BIGINT)) END AS fit_width, CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN floor(320 * h / w + 0.5) <= 480 THEN greatest(1, CAST(floor(320 * h / w + 0.5) AS BIGINT)) ELSE 480 END AS fit_height FROM c""")
def picture_rectangles(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 40).cast("double").alias("w"), (F.col("p_partkey") % 50 * 30).cast("double").alias("h"))
    crop, fit = labels.centred_crop(F.col("w"), F.col("h"), F.lit(2.0 / 3)), labels.fitted_size(F.col("w"), F.col("h"), 320, 480)
    return p.select("k", crop.alias("c"), fit.alias("f")).select("k", "c.x", "c.width", F.col("f.width").alias("fit_width"), F.col("f.height").alias("fit_height"))


@query("""SELECT event_id, CAST(greatest(0, least(4294967295, (epoch_us(ts) // 1000) % 5000000000 - 3000000000)) AS BIGINT) AS held, CASE WHEN event_id % 4 = 0 THEN 90.0::DOUBLE ELSE round((event_id % 4) * 1000 * 0.2::DOUBLE, 6) END AS moment FROM events""")
def saturated_times(spark, d):
    e = read(spark, d, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) % 5_000_000_000 - 3_000_000_000).alias("t"))
    return e.select("event_id", catalogue.saturating(F.col("t")).alias("held"), F.round(labels.frame_moment(((F.col("event_id") % 4) * 1000).cast("double")), 6).alias("moment"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '#00ff' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS "primary", CASE WHEN p_partkey % 3 = 0 THEN '#ABCDEF' END AS pair FROM part""")
def colour_pairs(spark, d):
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    stored = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#00ff"), size, F.lit(" #ABCDEF"))).when(F.col("p_partkey") % 3 == 1, "#00ff00").otherwise("#00ff0g #ABCDEF")
    return read(spark, d, "part").select("p_partkey", labels.colour_pair(stored).alias("c")).select("p_partkey", "c.primary", "c.pair")


@query()
def picture_accents(spark, d):
    """Pixels made of line items, a picture for each supplier; tested against plain sums."""
    channel = lambda c, k: (F.col(c) * k % 256).cast("int")
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("film"), channel("l_partkey", 37).alias("red"), channel("l_orderkey", 11).alias("green"), (F.col("l_linenumber") * 40 % 256).alias("blue"), F.when(F.col("l_partkey") % 9 == 0, 20).otherwise(255).alias("alpha"))
    return labels.accents(p, "film")


# ---- mutations -----------------------------------------------------------------------------------------------------------


@query(f"""WITH f AS {F_} SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 6 = 0 THEN NULL ELSE '/c/' || (id % 100) END ELSE cover_path END AS cover_path, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 6 = 0 THEN 'none' ELSE 'beside' END ELSE cover_source END AS cover_source,
    id % 2 = 0 AND (CASE WHEN id % 6 = 0 THEN NULL ELSE '/c/' || (id % 100) END IS DISTINCT FROM cover_path OR CASE WHEN id % 6 = 0 THEN 'none' ELSE 'beside' END IS DISTINCT FROM cover_source) AS changed FROM f""")
def cover_updates(spark, d):
    f = films(spark, d)
    new = f.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 != 0, F.struct(F.concat(F.lit("/c/"), F.col("id") % 100).alias("path"), F.lit("beside").alias("source"))).alias("cover"))
    return mutations.set_covers(f, new).select("id", "cover_path", "cover_source", "changed")


@query(f"""SELECT id, CASE WHEN id % 4 = 0 THEN film_id + id % 2 ELSE film_id END AS film_id, CASE WHEN id % 4 = 0 THEN 'by-hand' ELSE match_kind END AS match_kind, CASE WHEN id % 8 = 0 THEN offset_ms WHEN id % 4 = 0 THEN offset_ms ELSE offset_ms END AS offset_ms FROM {T_} WHERE id % 4 <> 0
    UNION ALL SELECT id, film_id + id // 4 % 2, 'by-hand', CASE WHEN id // 4 % 2 = 1 THEN 0 ELSE offset_ms END FROM {T_} WHERE id % 4 = 0""")
def hand_pairs(spark, d):
    t = tracks(spark, d)
    pairs = t.where("id % 4 = 0").select("id", (F.col("film_id") + F.floor(F.col("id") / 4) % 2).alias("film_id"))
    return mutations.pointed(t, pairs).select("id", "film_id", "match_kind", "offset_ms")


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN CAST(greatest(-600000, least(600000, id * 1000 - 5000000)) AS INT) ELSE offset_ms END AS offset_ms, CASE WHEN id % 3 = 0 THEN 2.0::DOUBLE ELSE rate END AS rate, id % 3 = 0 AND (greatest(-600000, least(600000, id * 1000 - 5000000)) <> offset_ms OR rate <> 2.0) AS changed FROM {T_}""")
def correction_updates(spark, d):
    t = tracks(spark, d)
    return mutations.with_corrections(t, t.where("id % 3 = 0").select("id", (F.col("id") * 1000 - 5_000_000).alias("offset_ms"), F.lit(7.5).alias("rate"))).select("id", "offset_ms", "rate", "changed")


@query(f"""WITH f AS {F_}, t AS {T_}, c AS (SELECT f.id, t.id AS track_id, t.film_id <> f.id AS refused FROM f JOIN t ON t.id = f.id * 3)
    SELECT f.id, coalesce(CASE WHEN c.refused = FALSE THEN c.track_id ELSE f.chosen_track_id END, -1) AS chosen_track_id, CASE WHEN c.refused = FALSE THEN FALSE ELSE f.subtitles_off END AS subtitles_off, coalesce(c.refused, FALSE) AS refused FROM f LEFT JOIN c USING (id)""")
def track_choices(spark, d):
    f, t = films(spark, d), tracks(spark, d)
    asked = f.select("id", (F.col("id") * 3).alias("track_id"), F.lit(False).alias("off")).join(t.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    return mutations.chosen_tracks(f, t, asked).select("id", "chosen_track_id", "subtitles_off", "refused").fillna(-1, ["chosen_track_id"])


@query("SELECT min(s_suppkey) AS id, '/f/' || s_nationkey AS path FROM supplier GROUP BY s_nationkey")
def insert_or_ignore(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/f/"), F.col("s_nationkey")).alias("path"))
    return mutations.added(s.where("id < 10").groupBy("path").agg(F.min("id").alias("id")).select("id", "path"), s.where("id >= 10"), "path")


@query(f"""WITH f AS {F_} SELECT id, CASE WHEN id % 2 = 0 THEN 'WebM' ELSE container END AS container, coalesce(CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 1000 + id ELSE duration_ms END, -1) AS duration_ms, id % 2 = 0 AS opened FROM f""")
def media_facts(spark, d):
    f = films(spark, d)
    facts = f.where("id % 2 = 0").select("id", F.lit("WebM").alias("container"), F.when(F.col("id") % 4 != 0, 1000 + F.col("id")).alias("duration_ms"))
    new, _ = mutations.described(f, audio(spark, d), facts, audio(spark, d))
    return new.select("id", "container", "duration_ms", (F.col("id") % 2 == 0).alias("opened")).fillna(-1, ["duration_ms"])


@query(f"""WITH f AS {F_}, a AS {A_} SELECT film_id, stream_number, codec FROM a WHERE film_id NOT IN (SELECT id FROM f WHERE id % 2 = 0) UNION ALL SELECT id, CAST(9 AS BIGINT), 'Opus' FROM f WHERE id % 4 = 0""")
def replaced_audio(spark, d):
    f = films(spark, d)
    streams = f.where("id % 4 = 0").select(F.col("id").alias("film_id"), F.lit(9).cast("long").alias("stream_number"), F.lit("Opus").alias("codec"), F.lit(2).alias("channels"), F.lit("en").alias("language"), F.lit(True).alias("is_default"))
    facts = f.where("id % 2 = 0").select("id", F.lit("WebM").alias("container"), F.lit(None).cast("long").alias("duration_ms"))
    return mutations.described(f, audio(spark, d), facts, streams)[1].select("film_id", "stream_number", "codec")


@query(f"""WITH t AS {T_} SELECT id, film_id, origin, cue_count FROM t WHERE NOT (origin = 'stream' AND film_id % 2 = 0 AND id % 2 = 0) AND NOT (film_id % 2 = 0 AND origin = 'stream') UNION ALL SELECT id, film_id, origin, cue_count + 1 FROM t WHERE origin = 'stream' AND film_id % 2 = 0 AND id % 2 = 1""")
def stream_sink(spark, d):
    t, f = tracks(spark, d), films(spark, d)
    opened = f.where("id % 2 = 0").select(F.col("id").alias("film_id"))
    found = t.where("origin = 'stream' AND film_id % 2 = 0 AND id % 2 = 1").withColumn("cue_count", F.col("cue_count") + 1)
    none = track_cues(spark, d)
    return mutations.with_streams(t, none, f, found, none.limit(0), opened, 99)[0].select("id", "film_id", "origin", "cue_count")


@query(f"""WITH p AS {P_}, n AS (SELECT * FROM (SELECT o_custkey AS film_id, CAST(floor(o_totalprice / 50) AS BIGINT) AS position_ms, o_orderkey AS updated_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE floor(o_totalprice / 50) >= 1000) WHERE k = 1)
    SELECT coalesce(p.film_id, n.film_id) AS film_id, coalesce(n.position_ms, p.position_ms) AS position_ms, coalesce(p.duration_ms, -1) AS duration_ms, coalesce(n.updated_at, p.updated_at) AS updated_at FROM p FULL JOIN n ON p.film_id = n.film_id""")
def saved_positions(spark, d):
    fresh = read(spark, d, "orders").select(F.col("o_custkey").alias("film_id"), F.floor(F.col("o_totalprice") / 50).alias("position_ms"), F.lit(None).cast("long").alias("duration_ms"), F.lit(False).alias("finished"), F.col("o_orderkey").alias("updated_at"))
    return mutations.saved_positions(positions(spark, d), fresh).select("film_id", "position_ms", "duration_ms", "updated_at").fillna(-1, ["duration_ms"])


@query("""WITH s AS (SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey < 800), n AS (SELECT c_name AS key, CASE WHEN c_custkey % 3 <> 0 THEN 'new' END AS value FROM customer WHERE c_custkey >= 600)
    SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, value FROM n WHERE value IS NOT NULL""")
def saved_preferences(spark, d):
    c = read(spark, d, "customer")
    stored, fresh = c.where("c_custkey < 800").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")), c.where("c_custkey >= 600").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 3 != 0, "new").alias("value"))
    return catalogue.preferences(mutations.saved_preferences(stored, fresh)).select("key", "value")


@query(f"""WITH c AS (SELECT track_id, ordinal FROM {CUES}), off AS (SELECT id FROM {F_} WHERE id % 3 = 0), gone AS (SELECT id FROM {T_} WHERE film_id IN (SELECT id FROM off))
    SELECT 'cue' AS tab, count(*) AS n FROM c WHERE track_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'track', count(*) FROM {T_} WHERE film_id NOT IN (SELECT id FROM off) UNION ALL SELECT 'position', count(*) FROM {P_} WHERE film_id NOT IN (SELECT id FROM off)
    UNION ALL SELECT 'audio', count(*) FROM {A_} WHERE film_id NOT IN (SELECT id FROM off) UNION ALL SELECT 'chosen', count(*) FROM {F_} WHERE id % 3 <> 0 AND chosen_track_id IS NOT NULL AND chosen_track_id NOT IN (SELECT id FROM gone)""")
def cascade_all_tables(spark, d):
    tables = {"film": films(spark, d), "subtitle_track": tracks(spark, d), "cue": track_cues(spark, d), "playback_position": positions(spark, d), "audio_stream": audio(spark, d)}
    left = upserts.cascade(tables, films(spark, d).where("id % 3 = 0").select(F.col("id").alias("film_id")))
    n = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
    return n(left["cue"], "cue").unionByName(n(left["subtitle_track"], "track")).unionByName(n(left["playback_position"], "position")).unionByName(n(left["audio_stream"], "audio")).unionByName(n(left["film"].where("chosen_track_id IS NOT NULL"), "chosen"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def vanished_films(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return upserts.without(c, o, "c_custkey", "o_custkey")


# ---- covers, scans, evaluation -------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT path AS film, id, CASE WHEN cover_path IS NOT NULL AND cover_source <> 'odd' THEN cover_source END AS was, cover_path, CASE WHEN id % 3 = 0 THEN id % 2 = 0 END AS opened, id % 5 IN (0, 1) AS beside, id % 5 IN (1, 2) AS sidecar, id % 5 IN (2, 3) AS above FROM {F_})
    SELECT film, CASE WHEN was = 'chosen' THEN cover_path WHEN coalesce(opened, was = 'in-file', FALSE) THEN film WHEN beside THEN '/b/' || id WHEN was = 'sidecar' THEN cover_path WHEN sidecar THEN '/p/' || id WHEN above THEN '/a/' || id END AS path,
    CASE WHEN was = 'chosen' THEN was WHEN coalesce(opened, was = 'in-file', FALSE) THEN 'in-file' WHEN beside THEN 'beside' WHEN was = 'sidecar' OR sidecar THEN 'sidecar' WHEN above THEN 'folder-above' END AS source FROM f""")
def cover_decisions(spark, d):
    f = films(spark, d)
    known = F.when(F.col("cover_path").isNotNull() & (F.col("cover_source") != "odd"), F.struct(F.col("cover_path").alias("path"), F.col("cover_source").alias("source")))
    rows = f.select(F.col("path").alias("film"), known.alias("recorded"), F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0).alias("opened"))
    offer = lambda where, source, prefix: f.where(where).select(F.col("path").alias("film"), F.lit(source).alias("source"), F.concat(F.lit(prefix), F.col("id")).alias("path"))
    found = offer("id % 5 IN (0, 1)", "beside", "/b/").unionByName(offer("id % 5 IN (1, 2)", "sidecar", "/n/")).unionByName(offer("id % 5 IN (2, 3)", "folder-above", "/a/"))
    named = f.where("id % 5 IN (1, 2)").select(F.concat(F.lit("/n/"), F.col("id")).alias("path"), F.concat(F.lit("/p/"), F.col("id")).alias("picture"))
    return covers.chosen(rows, found, named).select("film", "cover.path", "cover.source")


@query("""WITH w AS (SELECT s_suppkey AS id, '/d' || (s_suppkey % 25) || '/s' || s_suppkey AS path FROM supplier), p AS (SELECT DISTINCT '/d' || (o_custkey % 25) || '/s' || (o_custkey % 100) || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '/x/y.srt' ELSE 'x/y.srt' END AS path FROM orders)
    SELECT id, path FROM w WHERE EXISTS (SELECT 1 FROM p WHERE p.path = w.path OR starts_with(p.path, w.path || '/'))""")
def touched_folders(spark, d):
    w = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/d"), F.col("s_suppkey") % 25, F.lit("/s"), F.col("s_suppkey")).alias("path"))
    o = read(spark, d, "orders")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "/x/y.srt").otherwise("x/y.srt")
    return catalogue.touched_folders(w, o.select(F.concat(F.lit("/d"), F.col("o_custkey") % 25, F.lit("/s"), F.col("o_custkey") % 100, tail).alias("path")))


@query("""WITH p AS (SELECT DISTINCT '/r' || o_custkey || CASE WHEN o_orderkey % 30 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '/a' || (o_orderkey % 7) ELSE '/a' || (o_orderkey % 7) || '/b' END AS path FROM orders),
    s AS (SELECT path, '/' || split_part(path, '/', 2) AS one, '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS two FROM p)
    SELECT path FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.path = s.one AND p.path <> s.path) AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = s.two AND p.path <> s.path)""")
def outermost_folders(spark, d):
    inner = F.concat(F.lit("/a"), F.col("o_orderkey") % 7)
    tail = F.when(F.col("o_orderkey") % 30 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, inner).otherwise(F.concat(inner, F.lit("/b")))
    return catalogue.outermost(read(spark, d, "orders").select(F.concat(F.lit("/r"), F.col("o_custkey"), tail).alias("path")))


TRUTH = f"(SELECT track_id AS film, ordinal, start_ms, end_ms, text FROM {CUES})"
WAYS = ", ".join(f"({w}, '{f}', {o!r}::DOUBLE, {r!r}::DOUBLE, {'NULL' if s is None else s})" for w, f, o, r, s in evaluation.ways())


def _put_sql(t: str) -> str:
    return f"CAST(CASE family WHEN 'splice' THEN CASE WHEN {t} < cut THEN {t} ELSE {t} - 90000 END WHEN 'recut' THEN CASE WHEN {t} < gap THEN {t} ELSE {t} - 240000 END ELSE round(({t} - shift) / ratio) END AS BIGINT)"


CASES = f"""c AS (SELECT t.*, v.*, CAST(floor(l.last * 0.4) AS BIGINT) AS cut, CAST(floor(l.last * 0.6) AS BIGINT) AS gap, l.last FROM {TRUTH} t JOIN (SELECT film, max(end_ms) AS last FROM {TRUTH} GROUP BY film) l USING (film), (VALUES {WAYS}) v(way, family, shift, ratio, slack)),
    k AS (SELECT film, way, family, slack, start_ms AS belongs_ms, {_put_sql("start_ms")} AS a, {_put_sql("end_ms")} AS b FROM c WHERE CASE family WHEN 'splice' THEN cut > 90000 WHEN 'recut' THEN last >= gap + 480000 AND NOT (start_ms >= gap AND start_ms < gap + 240000) ELSE TRUE END)"""


def truth(spark, d):
    return track_cues(spark, d).select(F.col("track_id").alias("film"), "ordinal", "start_ms", "end_ms", "text")


@query(f"""WITH t AS (SELECT id, cue_count, row_number() OVER (ORDER BY id) - 1 AS tracks, coalesce(sum(cue_count) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cues FROM {T_})
    SELECT id, tracks // 64 + CAST(cues AS BIGINT) // 20000 AS pack FROM t""")
def track_packs(spark, d):
    """Commits of tracks: 64 tracks or 20,000 cues each."""
    return mutations.packed(tracks(spark, d)).select("id", "pack")


@query(f"""SELECT film_id, tracks_before, cues_before FROM (SELECT id, film_id, row_number() OVER (PARTITION BY film_id ORDER BY id) - 1 AS tracks_before, CAST(coalesce(sum(cue_count) OVER (PARTITION BY film_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cues_before FROM {T_})""")
def running_sums(spark, d):
    """Sums over what comes before, in chunks of each series."""
    return series.running(tracks(spark, d), ["film_id"], ["id"], 1000, {"tracks_before": F.lit(1), "cues_before": F.col("cue_count")}).select("film_id", "tracks_before", "cues_before")


@query(f"""WITH {CASES} SELECT film, way, family, CAST(count(*) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS starts, CAST(sum(greatest(a, b)) AS BIGINT) AS ends FROM k WHERE a >= 0 AND b >= 0 GROUP BY ALL""")
def spoilt_cases(spark, d):
    return evaluation.cases(truth(spark, d)).groupBy("film", "way", "family").agg(F.count("*").alias("n"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"))


@query(f"""WITH {CASES} SELECT film, way, max(abs(CASE WHEN way % 2 = 0 THEN a ELSE CAST(round(greatest(0, a + 500)) AS BIGINT) END - belongs_ms)) AS worst_ms FROM k WHERE a >= 0 AND b >= 0 GROUP BY ALL""")
def worst_errors(spark, d):
    made_ = evaluation.cases(truth(spark, d))
    said = made_.select("film", "way").distinct().withColumns({"offset_ms": F.when(F.col("way") % 2 == 0, 0).otherwise(500), "rate": F.lit(1.0)})
    return evaluation.worst_errors(made_, said)


@query(f"""WITH t AS (SELECT doc_id, doc_id % 10 / 10.0 AS score, CASE WHEN doc_id % 7 = 0 THEN 'breaks' END AS misfit, doc_id % 13 AS examined, 0.5 AS before, doc_id % 11 / 10.0 AS after, CASE WHEN quality = 1 THEN 50 END AS slack, doc_id % 120 AS worst FROM labels), b AS (SELECT unnest({list(evaluation.THRESHOLDS)}) AS threshold),
    o AS (SELECT *, CASE WHEN score < threshold THEN 'uncertain' WHEN misfit IS NOT NULL THEN misfit WHEN examined = 0 OR after < before OR after < 0.58 THEN 'no-better' ELSE 'accepted' END AS said FROM t, b),
    v AS (SELECT threshold, CASE WHEN said = 'accepted' THEN CASE WHEN slack IS NOT NULL AND worst <= slack THEN 'right' ELSE 'wrong' END WHEN slack IS NOT NULL THEN 'missed' ELSE 'right' END AS v FROM o)
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (v = 'right') AS right_n, count(*) FILTER (v = 'wrong') AS wrong_n, count(*) FILTER (v = 'missed') AS missed_n FROM v GROUP BY 1""")
def evaluation_sweep(spark, d):
    t = read(spark, d, "labels").select((F.col("doc_id") % 10 / 10.0).alias("score"), F.when(F.col("doc_id") % 7 == 0, "breaks").alias("misfit"), (F.col("doc_id") % 13).alias("examined"), F.lit(0.5).alias("before"), (F.col("doc_id") % 11 / 10.0).alias("after"), F.when(F.col("quality") == 1, 50).alias("slack"), (F.col("doc_id") % 120).alias("worst_ms"))
    return evaluation.sweep(t, alignment.LANDING_BAR)


@query(f"""WITH t AS {TRUTH}, f AS (SELECT film, row_number() OVER (ORDER BY substr(md5(CAST(film AS VARCHAR)), 1, 15), film) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT film FROM t)),
    p AS (SELECT DISTINCT a.film AS of_film, b.film, j FROM f a, (VALUES (1), (2)) v(j), f b WHERE b.place = (a.place + j) % a.n AND b.film <> a.film)
    SELECT p.film, of_film, 17 + j AS way, 'mismatched' AS family, count(*) AS n, CAST(sum(start_ms) AS BIGINT) AS starts FROM p JOIN t ON t.film = p.of_film GROUP BY ALL""")
def mismatched_cases(spark, d):
    made_ = evaluation.mismatched(truth(spark, d), 2)
    return made_.groupBy("film", "of_film", F.col("way").cast("int").alias("way"), "family").agg(F.count("*").alias("n"), F.sum("start_ms").alias("starts"))


@query(f"""WITH t AS {T_}, l AS (SELECT id AS track_id, id % 100 / 100.0 AS fraction FROM t) SELECT film_id AS film, max_by(id, struct_pack(c := cue_count, b := -id)) AS track_id FROM t JOIN l ON l.track_id = t.id WHERE cue_count >= 100 AND fraction >= 0.5 GROUP BY film_id""")
def true_tracks(spark, d):
    t = tracks(spark, d)
    return evaluation.true_tracks(t, t.select(F.col("id").alias("track_id"), (F.col("id") % 100 / 100.0).alias("fraction")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 4 = 0 THEN 1.0::DOUBLE ELSE round(least(1, (o_orderkey % 7 + o_orderkey % 3) / (o_orderkey % 10 + o_orderkey % 4 + 5)::DOUBLE), 9) END AS done FROM orders""")
def scan_progress(spark, d):
    k = F.col("o_orderkey")
    none = (k % 10 == 0) & (k % 4 == 0)
    wanted = F.when(none, 0).otherwise(k % 10 + 5), F.when(none, 0).otherwise(k % 4)
    return read(spark, d, "orders").select("o_orderkey", F.round(catalogue.fraction_read(k % 7, k % 3, *wanted), 9).alias("done"))


# ---- names ---------------------------------------------------------------------------------------------------------------

CAPITALS = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS way, p_name, {CAPITALS} AS c, 1950 + p_size AS y FROM part)
    SELECT k, CASE way WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN 'Big ' || p_name || ' 1931' WHEN 3 THEN c WHEN 4 THEN 'Big-' || p_name ELSE c END AS title, CASE WHEN way IN (1, 2, 5) THEN y ELSE -1 END AS year,
    CASE WHEN way = 3 THEN 'fr' WHEN way = 5 THEN 'en' END AS language, way = 3 AS forced, way = 5 AS hearing_impaired, CASE WHEN way = 2 THEN 'big' || replace(p_name, ' ', '') || '1931' WHEN way = 4 THEN 'big' || replace(p_name, ' ', '') ELSE replace(p_name, ' ', '') END AS key FROM p""")
def name_rules(spark, d):
    """Names without capitals, with brackets, two years, a suffix of several words, a hyphen and weak words, and of a subtitle for the hard of hearing."""
    y, dotted = (1950 + F.col("p_size")).cast("string"), F.replace("p_name", F.lit(" "), F.lit("."))
    ways = F.array(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".mkv")), F.concat("p_name", F.lit(" ("), y, F.lit(") [1080p].avi")), F.concat(F.lit("Big "), "p_name", F.lit(" 1931 "), y, F.lit(" remux.mkv")),
        F.concat(dotted, F.lit(".french.forced.srt")), F.concat(F.lit("Big-"), "p_name", F.lit(" uncut 720p web rip.mkv")), F.concat(dotted, F.lit("."), y, F.lit(".x264.en.sdh.srt")),
    )
    got = read(spark, d, "part").select(F.col("p_partkey").alias("k"), names.parsed_name(F.element_at(ways, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("n"))
    return got.select("k", "n.title", "n.year", "n.language", "n.forced", "n.hearing_impaired", "n.key").fillna(-1, ["year"])


@query("SELECT p_partkey, 'part ' || lpad(CAST(p_size AS VARCHAR), 12, '0') || ' of ' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || ' e' AS key FROM part")
def natural_keys(spark, d):
    name = F.concat(F.lit("Part "), F.col("p_size"), F.lit(" OF "), F.col("p_partkey"), F.lit(" \u00e9"))
    return read(spark, d, "part").select("p_partkey", text.natural_key(name).alias("key"))
