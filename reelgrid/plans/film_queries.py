"""Queries of films, tracks and covers beyond the catalogue's reads: functions of time and names, views, plans, candidates, stepping through lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import media, text, timing
from reelgrid.operators import alignment, catalogue, covers, library, mutations, pairing, series, upserts
from reelgrid.plans.library_queries import A_, CUES, F_, P_, T_, audio, films, positions, track_cues, tracks
from reelgrid.plans.queries import DAY, EVENTS, events, query, read

MINUTES = "CAST(round((duration_ms - position_ms) / 60000.0) AS BIGINT)"


@query(f"""WITH p AS (SELECT film_id, position_ms, duration_ms, finished FROM {P_})
    SELECT film_id, coalesce(CASE WHEN duration_ms > 0 THEN round(greatest(0, least(1, position_ms / duration_ms::DOUBLE)), 9) END, -1) AS progress, coalesce(position_ms >= duration_ms * 0.97, FALSE) AS at_end,
      CASE WHEN finished THEN 0 ELSE greatest(0, position_ms - 5000) END AS resume_at,
      CASE WHEN duration_ms IS NULL THEN 'Carry on' WHEN duration_ms - position_ms < 60000 THEN 'Nearly finished' WHEN {MINUTES} < 60 THEN {MINUTES} || ' min left' WHEN {MINUTES} % 60 = 0 THEN ({MINUTES} // 60) || ' hr left' ELSE ({MINUTES} // 60) || ' hr ' || ({MINUTES} % 60) || ' min left' END AS time_left FROM p""")
def watching_figures(spark, d):
    """How far each film was watched, where to go on, what is left."""
    p = positions(spark, d)
    at, lasts = F.col("position_ms"), F.col("duration_ms")
    return p.select("film_id", F.coalesce(F.round(timing.progress(at, lasts), 9), F.lit(-1.0)).alias("progress"), timing.is_finished(at, lasts).alias("at_end"), timing.resume_from(at, F.col("finished")).alias("resume_at"), timing.time_left_label(at, lasts).alias("time_left"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_partkey % 7 > 0 THEN round(1e9 / (l_partkey % 7 * 10000000), 6) END, -1) AS fps, CAST(least(4294967295, floor(CAST(l_suppkey AS HUGEINT) * l_partkey * 1000000 / 1000000)) AS BIGINT) AS ms,
    greatest(1, CAST(ceil(length(l_comment) / 38.0) AS BIGINT)) * 22 + 16 AS height FROM (SELECT *, l_linestatus || repeat(l_returnflag, CAST(l_quantity AS INT)) AS l_comment FROM lineitem)""")
def container_figures(spark, d):
    """Frames a second, times in a container's units, and heights of lines in a list."""
    i = read(spark, d, "lineitem")
    said = F.concat("l_linestatus", F.expr("repeat(l_returnflag, CAST(l_quantity AS INT))"))
    return i.select("l_orderkey", "l_linenumber", F.coalesce(F.round(timing.frame_rate(F.col("l_partkey") % 7 * 10_000_000), 6), F.lit(-1.0)).alias("fps"), timing.units_ms(F.col("l_suppkey") * F.col("l_partkey"), F.lit(1_000_000)).alias("ms"), text.row_height(said).alias("height"))


@query(f"""WITH f AS {F_} SELECT id, 'Customer#' || lpad(CAST(id AS VARCHAR), 9, '0') || '.mkv' AS name, 'mkv' AS kind, 'Matroska' AS container, split_part(path, '/', 3) AS shelf, '/n' || folder_id || '/' || split_part(path, '/', 3) AS folder,
    CASE WHEN video_width >= 2500 THEN '1440p' WHEN video_width >= 1900 THEN '1080p' WHEN video_width >= 1250 THEN '720p' ELSE video_height || 'p' END AS class FROM f""")
def path_figures(spark, d):
    """Base names, extensions, containers, shelves and classes of resolution."""
    f = films(spark, d)
    root = F.concat(F.lit("/n"), F.col("folder_id"))
    name = media.base_name(F.col("path"))
    return f.select("id", name.alias("name"), media.extension(name).alias("kind"), media.container_name(name).alias("container"), media.shelf(F.col("path"), root).alias("shelf"), media.folder_of(F.col("path")).alias("folder"), media.resolution(F.col("video_width"), F.col("video_height")).alias("class"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'subrip' WHEN 1 THEN 'ass' WHEN 2 THEN 'webvtt' ELSE 'unknown' END AS codec, 'en' AS language, CASE WHEN o_orderkey % 2 = 0 THEN 'Said, ' || o_custkey ELSE 'short' END AS said FROM orders""")
def container_codes(spark, d):
    """Codec ids of subtitles, base subtags of languages, and the text of SSA records."""
    k = F.col("o_orderkey")
    codec = F.element_at(F.array(*(F.lit(x) for x in ("S_TEXT/UTF8", "S_TEXT/ASS", "S_TEXT/WEBVTT", "S_OTHER"))), (k % 4 + 1).cast("int"))
    record = F.when(k % 2 == 0, F.concat(F.lit("1,0,Default,,0,0,0,,Said, "), F.col("o_custkey"))).otherwise("1,0,short")
    return read(spark, d, "orders").select("o_orderkey", media.subtitle_codec(codec).alias("codec"), media.shortest_code(F.element_at(F.array(F.lit("EN-gb"), F.lit("en_US")), (k % 2 + 1).cast("int"))).alias("language"), media.ass_text(record).alias("said"))


READABLE = f"(SELECT * FROM {T_} WHERE codec IN ('subrip', 'ass', 'webvtt') AND cue_count > 0)"


@query(f"""WITH r AS {READABLE}, s AS (SELECT film_id, id, row_number() OVER (PARTITION BY film_id ORDER BY CASE WHEN language = 'en' THEN 4 ELSE 0 END + CASE WHEN forced THEN 0 ELSE 2 END + CASE WHEN hearing_impaired THEN 0 ELSE 1 END DESC, id) AS k FROM r)
    SELECT f.id AS film_id, coalesce(CASE WHEN f.subtitles_off THEN NULL ELSE coalesce(c.id, s.id) END, -1) AS track_id FROM {F_} f LEFT JOIN s ON s.film_id = f.id AND k = 1 LEFT JOIN r c ON c.film_id = f.id AND c.id = f.chosen_track_id""")
def active_tracks(spark, d):
    """The track that each film shows: none, the chosen one, or the default one of those that can be read."""
    return library.active_track(films(spark, d), tracks(spark, d), "en").fillna(-1, ["track_id"])


@query(f"""WITH f AS {F_}, t AS {T_}, a AS {A_}, p AS {P_}, w AS (SELECT s_nationkey AS id, '/n' || s_nationkey AS path FROM supplier GROUP BY s_nationkey),
    n AS (SELECT film_id, count(*) AS n, arg_min(id, {{'unknown': language IS NULL, 'language': coalesce(language, ''), 'forced': forced, 'path': path}}) AS first FROM t GROUP BY film_id), m AS (SELECT film_id, count(*) AS n FROM a GROUP BY film_id)
    SELECT f.id, coalesce(w.path, '') AS folder, coalesce(n.n, -1) AS n_tracks, coalesce(n.first, -1) AS first_track, coalesce(m.n, -1) AS n_audio, coalesce(p.position_ms, -1) AS position_ms FROM f LEFT JOIN w ON w.id = f.folder_id LEFT JOIN n ON n.film_id = f.id LEFT JOIN m ON m.film_id = f.id LEFT JOIN p ON p.film_id = f.id""")
def film_view_rows(spark, d):
    """Films with their folder, tracks, audio and position nested, and what the nests hold."""
    w = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.concat(F.lit("/n"), F.col("s_nationkey")).alias("path")).distinct()
    v = library.film_views(films(spark, d), w, tracks(spark, d), audio(spark, d), positions(spark, d))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(-1).cast("long")
    return v.select("id", F.coalesce("folder", F.lit("")).alias("folder"), count("tracks").alias("n_tracks"), F.coalesce(F.get("tracks", F.lit(0))["id"], F.lit(-1)).alias("first_track"), count("audio").alias("n_audio"), F.coalesce("position.position_ms", F.lit(-1)).alias("position_ms"))


# ---- plans of a scan -----------------------------------------------------------------------------------------------------


@query(f"""WITH t AS {T_}, n AS (SELECT *, id % 3 = 0 AND match_kind <> 'by-hand' AS hit, film_id + id % 2 AS new_film FROM t)
    SELECT id, CASE WHEN hit THEN new_film ELSE film_id END AS film_id, CASE WHEN hit THEN 'approximate' ELSE match_kind END AS match_kind, CASE WHEN hit AND new_film <> film_id THEN 0 ELSE offset_ms END AS offset_ms, CASE WHEN hit AND new_film <> film_id THEN 1.0::DOUBLE ELSE rate END AS rate FROM n""")
def repaired_pairs(spark, d):
    """A third of the tracks paired anew: those paired by hand stay, those that go to another film forget their correction."""
    t = tracks(spark, d)
    pairs = t.where("id % 3 = 0").select("path", (F.col("film_id") + F.col("id") % 2).alias("film_id"), F.lit("approximate").alias("match_kind"))
    return upserts.repaired(t, pairs).select("id", "film_id", "match_kind", "offset_ms", "rate")


@query(f"""WITH f AS {F_}, n AS (SELECT path, size_bytes + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS size_bytes, modified_at FROM f WHERE id % 5 <> 0 UNION ALL SELECT path || '.new', size_bytes, modified_at FROM f WHERE id % 50 = 1)
    SELECT n.path, CASE WHEN f.path IS NULL OR f.size_bytes <> n.size_bytes OR f.modified_at <> n.modified_at OR f.missing_since IS NOT NULL OR f.probed_at IS NULL THEN 'whole' ELSE 'header' END AS job FROM n LEFT JOIN f ON f.path = n.path
    WHERE f.path IS NULL OR f.size_bytes <> n.size_bytes OR f.modified_at <> n.modified_at OR f.missing_since IS NOT NULL OR f.probed_at IS NULL OR f.container IS NULL""")
def films_to_read(spark, d):
    """What an incremental scan reads of each film that it found: all of it, its header, or nothing."""
    f = films(spark, d)
    found = f.where("id % 5 <> 0").select("path", (F.col("size_bytes") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("size_bytes"), "modified_at")
    found = found.unionByName(f.where("id % 50 = 1").select(F.concat("path", F.lit(".new")).alias("path"), "size_bytes", "modified_at"))
    return upserts.film_jobs(found, f.select("path", "size_bytes", "modified_at", "missing_since", "probed_at", "container"))


@query("""WITH f AS (SELECT p_partkey AS film, replace(p_name, ' ', '') AS key FROM part WHERE p_partkey % 3 = 0), s AS (SELECT p_partkey AS subtitle, replace(p_name, ' ', '') AS key FROM part), k AS (SELECT key, count(*) AS n FROM f GROUP BY key)
    SELECT subtitle FROM s LEFT JOIN k USING (key) WHERE k.n IS NULL OR k.n > 1""")
def unpaired_subtitles(spark, d):
    """Subtitles that no film has the key of, or several."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("key"))
    keyed = lambda rows, name: rows.select(F.col("id").alias(name), "key", F.array("key").alias("words"), F.lit(None).cast("int").alias("year"))
    subs = keyed(p, "subtitle")
    return pairing.unpaired(subs, pairing.paired(subs, keyed(p.where("id % 3 = 0"), "film"))).select("subtitle")


@query("""WITH s AS (SELECT 'k' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_nationkey END AS value FROM supplier), k AS (SELECT key, 'd' AS def FROM s WHERE key <> 'k7' UNION ALL SELECT 'other', 'o')
    SELECT k.key, coalesce(s.value, k.def) AS value, CASE WHEN s.value IS NULL THEN 'default' ELSE 'stored' END AS source FROM k LEFT JOIN s ON s.key = k.key AND s.key <> 'k6'""")
def typed_settings(spark, d):
    """Known settings with what is stored; keys that are no more are passed over."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey")).alias("key"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("v"), F.col("s_nationkey"))).alias("value"))
    known = s.where("key <> 'k7'").select("key", F.lit("d").alias("default")).unionByName(spark.createDataFrame([("other", "o")], "key string, default string"))
    return mutations.known_settings(s, known, ["k6"])


# ---- covers --------------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT p_partkey AS k, '/d' || (p_partkey // 3) AS folder, replace(p_name, ' ', '') AS key, p_name FROM part), n AS (SELECT folder, count(*) AS n FROM f GROUP BY folder),
    i AS (SELECT folder || '/' || CASE WHEN k % 4 = 0 THEN 'poster' ELSE p_name || CASE WHEN k % 2 = 0 THEN '-poster' ELSE '' END END || '.jpg' AS path, folder, k % 4 = 0 AS fixed, key FROM f WHERE k % 3 = 1),
    c AS (SELECT f.k, 0 AS rank, i.path FROM f JOIN i USING (folder, key) WHERE NOT fixed UNION ALL SELECT f.k, 1, i.path FROM f JOIN n USING (folder) JOIN i USING (folder) WHERE fixed AND n = 1)
    SELECT k AS film, 'beside' AS source, min(path) AS path FROM c WHERE (k, rank) IN (SELECT k, min(rank) FROM c GROUP BY k) GROUP BY k""")
def cover_candidates(spark, d):
    """Pictures beside films: by the film's name with or without a suffix, or the folder's own where the film is alone in it."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("/d"), F.floor(F.col("p_partkey") / 3)).alias("folder"), "p_name")
    f = p.select(F.concat("folder", F.lit("/"), F.col("k"), F.lit(".mkv")).alias("film"), F.replace("p_name", F.lit(" "), F.lit("")).alias("key"), F.lit(None).cast("int").alias("year"))
    name = F.when(F.col("k") % 4 == 0, F.lit("poster")).otherwise(F.concat("p_name", F.when(F.col("k") % 2 == 0, "-poster").otherwise("")))
    images = p.where("k % 3 = 1").select(F.concat("folder", F.lit("/"), name, F.lit(".jpg")).alias("path"))
    found = covers.candidates(f, images, images.limit(0)).where("source = 'beside'")
    return covers.decided(found).select(F.regexp_extract("film", r"(\d+)\.mkv$", 1).cast("long").alias("film"), "source", "path")


# ---- lines and references ------------------------------------------------------------------------------------------------


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, ms AS s, ms + 900000 AS e FROM e WHERE event_type = 'click'), p AS (SELECT event_id, user_id, ms AS t FROM e WHERE event_type = 'purchase'),
    b AS (SELECT p.event_id, t, p.user_id, max({{'s': s, 'e': e}}) FILTER (s <= t) AS b, min({{'s': s, 'e': e}}) FILTER (s > t) AS a, min(s) FILTER (s > t) AS next_ms, max(s) FILTER (s <= t - 400) AS previous_ms FROM p LEFT JOIN l ON l.user_id = p.user_id GROUP BY ALL),
    d AS (SELECT *, CASE WHEN b IS NOT NULL THEN greatest(0, t - b.e) END AS away_b, a.s - t AS away_a FROM b)
    SELECT event_id, CASE WHEN away_b <= {DAY} AND (away_a IS NULL OR away_b <= away_a) THEN b.s WHEN away_a <= {DAY} THEN a.s WHEN away_b <= {DAY} THEN b.s ELSE -1 END AS line_ms, coalesce(next_ms, -1) AS next_ms, coalesce(previous_ms, -1) AS previous_ms FROM d""")
def lines_at_stops(spark, d):
    """The line that is on, or the nearest within a day, where each purchase stops; and the starts to step to."""
    e = events(spark, d, "event_id", "user_id", "event_type")
    lines = e.where("event_type = 'click'").select("user_id", F.col("ms").alias("s"), (F.col("ms") + 900_000).alias("e"))
    stops = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ms").alias("t"))
    stepped = catalogue.stepped(stops, lines, ["user_id"], "t", "s")
    return catalogue.nearest_within(stepped, lines, ["user_id"], "t", "s", "e", DAY).select("event_id", "line_ms", "next_ms", "previous_ms").fillna(-1)


@query(f"""WITH {EVENTS}, g AS (SELECT user_id AS film, ms // {DAY} AS bin, sum(value * value) AS s, count(value) AS n FROM e GROUP BY ALL) SELECT film, bin, round(10 * log10(s / n + 1e-12), 6) AS level FROM g WHERE n > 0""")
def daily_levels(spark, d):
    """Mean power in decibels from partial sums."""
    e = events(spark, d, "user_id", "value").select(F.col("user_id").alias("film"), F.floor(F.col("ms") / DAY).alias("bin"), (F.col("value") * F.col("value")).alias("sum_sq"), F.col("value").isNotNull().cast("int").alias("n"))
    return alignment.levels(e.where("n > 0")).select("film", "bin", F.round("level", 6).alias("level"))


@query(f"""WITH t AS (SELECT * FROM {T_}), u AS (SELECT * FROM t WHERE codec IN ('subrip', 'ass', 'webvtt') AND cue_count >= 100),
    r AS (SELECT t.id AS film, u.id AS reference_id, row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN u.origin = 'stream' THEN 0 ELSE 1 END, u.cue_count DESC, u.id) AS k FROM t JOIN u ON u.film_id = t.film_id AND u.id <> t.id),
    c AS (SELECT r.film, CAST(CASE WHEN t.offset_ms = 0 AND t.rate = 1 THEN c.start_ms ELSE round(greatest(0, c.start_ms * t.rate + t.offset_ms)) END AS BIGINT) // 10 AS a, CAST(CASE WHEN t.offset_ms = 0 AND t.rate = 1 THEN c.end_ms ELSE round(greatest(0, c.end_ms * t.rate + t.offset_ms)) END AS BIGINT) AS e
      FROM r JOIN t ON t.id = r.reference_id JOIN {CUES} c ON c.track_id = t.id WHERE k = 1),
    n AS (SELECT film, max(e) // 10 + 1 AS film_bins FROM c GROUP BY film), m AS (SELECT film, a, e // 10 AS b, CASE WHEN a <= max(e // 10) OVER (PARTITION BY film ORDER BY a, e // 10 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c WHERE e // 10 > a)
    SELECT film, CAST(sum(new) AS BIGINT) AS runs, any_value(film_bins) AS film_bins FROM m JOIN n USING (film) GROUP BY film""")
def reference_runs(spark, d):
    """What each track is measured against: runs of its reference's corrected lines."""
    _, runs = catalogue.against_references(track_cues(spark, d), tracks(spark, d))
    return runs.groupBy("film").agg(F.count("*").alias("runs"), F.max("film_bins").alias("film_bins"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE event_id IS NOT NULL""")
def places_in_series(spark, d):
    """Each event's place among its user's, in chunks."""
    return series.placed(read(spark, d, "events").where("event_id IS NOT NULL").select("event_id", "user_id"), ["user_id"], ["event_id"], 1 << 12)
