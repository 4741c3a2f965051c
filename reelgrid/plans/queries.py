"""Queries over the driver's tables: each shows one operator of the library at work, beside the SQL that says the same.

The library's own tables (films, tracks, cues) aren't among the driver's, so each operator runs on the nearest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.functions import media, names, text, timing
from reelgrid.operators import alignment, covers, decisions, intervals, library, pairing, series, subtitles, upserts
from reelgrid.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000, 86_400_000
SLOT = 2 * HOUR


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), *columns)


EVENTS = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


# ---- intervals and events --------------------------------------------------------------------------------------------


@query(f"""WITH {EVENTS} SELECT ms, n FROM (SELECT ms, count(*) OVER (ORDER BY ms RANGE BETWEEN CURRENT ROW AND {HOUR - 1} FOLLOWING) AS n FROM e)
    ORDER BY n DESC, ms LIMIT 1""")
def busiest_window(spark, d):
    return intervals.busiest(events(spark, d), "ms", HOUR)


@query(f"""WITH {EVENTS} SELECT a.event_id, a.ms, min(abs(a.ms - b.ms)) AS away FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type = 'click'
    WHERE a.event_type = 'purchase' GROUP BY ALL""")
def nearest_event(spark, d):
    e = events(spark, d, "event_id", "user_id", "event_type")
    left, right = e.where("event_type = 'purchase'").select("event_id", "ms", "user_id"), e.where("event_type = 'click'").select("user_id", F.col("ms").alias("hit_ms"))
    near = intervals.nearest(left, right, ["user_id"], "ms", "hit_ms")
    return near.select("event_id", "ms", intervals.nearest_distance(F.col("ms"), F.col("previous"), F.col("following")).alias("away"))


@query(f"""WITH {EVENTS}, p AS (SELECT a.event_id, a.user_id, min(CASE WHEN b.ms <= a.ms THEN a.ms - b.ms END) AS before, min(CASE WHEN b.ms >= a.ms THEN b.ms - a.ms END) AS after
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'click' WHERE a.event_type = 'view' GROUP BY ALL),
    s AS (SELECT *, least(before, after) AS away, coalesce(after <= {DAY}, FALSE) OR coalesce(before <= {DAY // 3}, FALSE) AS hit FROM p WHERE least(before, after) <= {4 * DAY})
    SELECT user_id, count(*) AS examined, count(*) FILTER (hit) AS landed, list_sort(list(away))[CAST(count(*) // 2 AS BIGINT) + 1] AS median_ms,
      count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS fraction FROM s GROUP BY user_id""")
def landing_rate(spark, d):
    e = events(spark, d, "user_id", "event_type")
    lines, starts = e.where("event_type = 'view'").select("user_id", "ms"), e.where("event_type = 'click'").select("user_id", F.col("ms").alias("start_ms"))
    return alignment.landing(lines, starts, ["user_id"], "ms", "start_ms", DAY, DAY // 3, 4 * DAY)


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER w <= {2 * DAY} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
    r AS (SELECT user_id, ms, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(ms) AS island_start, max(ms) AS island_end, count(*) AS n FROM r GROUP BY user_id, island HAVING max(ms) - min(ms) >= {HOUR}""")
def activity_islands(spark, d):
    return intervals.islands(events(spark, d, "user_id"), ["user_id"], "ms", 2 * DAY, HOUR)


@query(f"""WITH {EVENTS}, b AS (SELECT DISTINCT event_type, ms // {HOUR} AS bin FROM e),
    l AS (SELECT event_type, bin, lag(bin) OVER (PARTITION BY event_type ORDER BY bin) AS before FROM b)
    SELECT event_type, count(*) AS edges FROM l WHERE before IS NULL OR before < bin - 1 GROUP BY event_type""")
def rising_edges(spark, d):
    bins = events(spark, d, "event_type").select("event_type", F.floor(F.col("ms") / HOUR).alias("bin")).distinct().withColumn("active", F.lit(True))
    return intervals.rising_edges(bins, ["event_type"], "bin", "active").groupBy("event_type").agg(F.count("*").alias("edges"))


SPANS = f"{EVENTS}, s AS (SELECT event_id, event_type, user_id, ms - (SELECT min(ms) FROM e) AS a, ms - (SELECT min(ms) FROM e) + 1 + CAST(floor(value * 1000) AS BIGINT) AS b FROM e)"


def spans(spark, d):
    e = events(spark, d, "event_id", "event_type", "user_id", "value")
    first = e.agg(F.min("ms").alias("first"))  # one row
    start = F.col("ms") - F.col("first")
    return e.crossJoin(F.broadcast(first)).select("event_id", "event_type", "user_id", start.alias("a"), (start + 1 + F.floor(F.col("value") * 1000)).alias("b"))


@query(f"""WITH {SPANS}, p AS (SELECT *, 2700000000.0 / 320 AS w FROM s WHERE b > a AND a < 2700000000),
    x AS (SELECT event_type, a, b, w, unnest(range(CAST(floor(a / w) AS BIGINT), CAST(least(319, floor(b / w)) AS BIGINT) + 1)) AS bucket FROM p),
    o AS (SELECT event_type, bucket, sum(greatest(0, least(CAST(b AS DOUBLE), (bucket + 1) * w) - greatest(CAST(a AS DOUBLE), bucket * w))) AS o FROM x GROUP BY ALL)
    SELECT event_type, bucket, round(o, 3) AS overlap, round(CASE WHEN max(o) OVER (PARTITION BY event_type) > 0 THEN o / max(o) OVER (PARTITION BY event_type) END, 6) AS share FROM o""")
def activity_profile(spark, d):
    got = intervals.activity_profile(spans(spark, d).withColumn("duration", F.lit(2_700_000_000.0)), ["event_type"], "a", "b", "duration")
    return got.select("event_type", "bucket", F.round("overlap", 3).alias("overlap"), F.round("share", 6).alias("share"))


@query(f"""WITH {SPANS} SELECT event_id, user_id, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS latest_end FROM s""")
def running_end(spark, d):
    return intervals.running_end(spans(spark, d), ["user_id"], "a", "b").select("event_id", "user_id", "latest_end")


@query(f"""WITH {SPANS}, t AS (SELECT event_type, unnest(range(0, 2600000000, 9000000)) AS t FROM (SELECT DISTINCT event_type FROM s)),
    h AS (SELECT t.event_type, t.t, s.a, s.b, row_number() OVER (PARTITION BY t.event_type, t.t ORDER BY s.a DESC, s.b DESC) AS k FROM t LEFT JOIN s ON s.event_type = t.event_type AND s.a <= t.t AND t.t < s.b)
    SELECT event_type, t, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM h WHERE k = 1""")
def active_interval(spark, d):
    s = spans(spark, d)
    points = s.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2_599_999_999).cast("long"), F.lit(9_000_000).cast("long"))).alias("t"))
    return intervals.active_at(points, s, ["event_type"], "t", "a", "b", 600_000).fillna(-1, ["a", "b"])


@query(f"""WITH {EVENTS}, h AS (SELECT DISTINCT user_id, event_type, ms // {HOUR} AS bin FROM e WHERE event_type IN ('view', 'click'))
    SELECT b.bin - a.bin AS lag, count(*) AS n FROM h a JOIN h b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND b.event_type = 'click' GROUP BY ALL""")
def cross_correlation(spark, d):
    h = events(spark, d, "user_id", "event_type").select("user_id", "event_type", F.floor(F.col("ms") / HOUR).alias("bin")).distinct()
    return alignment.lag_products(h.where("event_type = 'view'"), h.where("event_type = 'click'"), ["user_id"], "bin", groups=[])


@query("""WITH t AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS x, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS y FROM orders GROUP BY ALL),
    s AS (SELECT a.series, quantile_disc((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM t a JOIN t b ON a.series = b.series AND a.x < b.x GROUP BY ALL)
    SELECT t.series, round(s.slope, 3) AS slope, round(quantile_disc(t.y - s.slope * t.x, 0.5), 3) AS intercept FROM t JOIN s USING (series) GROUP BY t.series, s.slope""")
def theil_sen_slope(spark, d):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x")
    totals = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), month).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("y"))
    return alignment.theil_sen(totals, ["series"], "x", "y").select("series", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(f"""WITH {EVENTS}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) - 1 AS bin FROM e),
    t AS (SELECT event_type, bin // 100 AS tile, list_sort(list(value)) AS v, (min(bin) + max(bin) + 1) / 2.0 AS mid FROM r GROUP BY ALL),
    m AS (SELECT event_type, tile, v[CAST(floor((len(v) - 1) * 0.15) AS BIGINT) + 1] AS low, mid FROM t),
    n AS (SELECT *, lag(low) OVER w AS lb, lag(mid) OVER w AS mb, lead(low) OVER w AS la, lead(mid) OVER w AS ma FROM m WINDOW w AS (PARTITION BY event_type ORDER BY tile))
    SELECT r.event_type, r.bin, round(CASE WHEN r.bin + 0.5 < mid THEN coalesce(lb + (low - lb) * (r.bin + 0.5 - mb) / (mid - mb), low) ELSE coalesce(low + (la - low) * (r.bin + 0.5 - mid) / (ma - mid), low) END, 6) AS floor
    FROM r JOIN n ON r.event_type = n.event_type AND r.bin // 100 = n.tile""")
def rolling_floor(spark, d):
    e = series.placed(events(spark, d, "event_id", "event_type", "value"), ["event_type"], ["ms", "event_id"], DAY, "bin")
    return alignment.rolling_floor(e, ["event_type"], "bin", "value", 100).select("event_type", "bin", F.round("floor", 6).alias("floor"))


@query("""WITH a AS (SELECT event_id, event_type, value - avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS x FROM events),
    b AS (SELECT event_id, event_type, abs(avg(x) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS x FROM a)
    SELECT event_id, round(avg(x) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 4) AS swing FROM b""")
def moving_swing(spark, d):
    e = series.placed(read(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], ["event_id"], 4096)
    return alignment.swing(e, ["event_type"], "place", "value").select("event_id", F.round("swing", 4).alias("swing"))


@query(f"""WITH {SPANS}, c AS (SELECT event_id, user_id, a, b, lag(b) OVER w AS pb, lead(a) OVER w AS na FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b))
    SELECT event_id, greatest(a + 100 - 400, least(coalesce(pb + 100, 0), a + 100), 0) AS shown_from, greatest(b + 100, least(a + 100 + 1500, coalesce(na + 100, a + 100 + 1500))) AS shown_to FROM c""")
def comfort_shift(spark, d):
    return intervals.comfortable(spans(spark, d), ["user_id"], "a", "b", 100, 400, 1500).select("event_id", "shown_from", "shown_to")


@query(f"""WITH {SPANS}, m AS (SELECT user_id, a, b, CASE WHEN a - max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {DAY} THEN 0 ELSE 1 END AS new FROM s),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(a) AS a, max(b) AS b FROM r GROUP BY user_id, k HAVING max(b) - min(a) >= {HOUR}""")
def merged_runs(spark, d):
    return intervals.merged_runs(spans(spark, d), ["user_id"], "a", "b", DAY, HOUR)


@query(f"""WITH RECURSIVE {EVENTS}, d AS (SELECT event_type, ms, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < {HOUR // 2} THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ms)),
    r AS (SELECT *, max(CASE WHEN new = 1 THEN ms END) OVER (PARTITION BY event_type ORDER BY ms) AS run FROM m),
    x AS (SELECT a.event_type, a.run, a.ms, min(b.ms) AS nxt FROM r a JOIN r b ON a.event_type = b.event_type AND a.run = b.run AND b.ms >= a.ms + {4 * HOUR} AND b.ms < a.ms + {4 * HOUR + HOUR // 2} GROUP BY ALL),
    c AS (SELECT event_type, run, run AS s FROM r WHERE new = 1 UNION ALL SELECT c.event_type, c.run, x.nxt FROM c JOIN x ON x.event_type = c.event_type AND x.run = c.run AND x.ms = c.s),
    k AS (SELECT r.event_type, r.ms, r.n, c.s FROM r ASOF JOIN c ON r.event_type = c.event_type AND r.ms >= c.s) SELECT event_type, s AS first, max(ms) AS last, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY event_type, s""")
def debounce_sessions(spark, d):
    return changes.sessions(events(spark, d, "event_type"), "event_type", "ms", HOUR // 2, 4 * HOUR)


# ---- time and labels ---------------------------------------------------------------------------------------------------


@query(f"""WITH {EVENTS}, t AS (SELECT event_id, ms % 7200000 AS t FROM e)
    SELECT event_id, CAST(round(least(4294967295, greatest(0, t * (25.0::DOUBLE / 23.976::DOUBLE) - 2500))) AS BIGINT) AS moved FROM t""")
def affine_correction(spark, d):
    e = events(spark, d, "event_id")
    return e.select("event_id", timing.corrected(F.col("ms") % 7_200_000, F.lit(-2500), F.lit(25.0 / 23.976)).alias("moved"))


@query(f"""WITH m AS (SELECT event_id, 0.95 + (event_id % 1000) / 10000.0::DOUBLE AS r FROM events),
    x AS (SELECT event_id, q, k, abs(r - q) AS away FROM m, (SELECT * FROM (VALUES {", ".join(f"({i}, {r!r}::DOUBLE)" for i, r in enumerate(timing.RATES))}) v(k, q)) v WHERE abs(r - q) <= 0.0005 AND abs(r - q) * 720000 <= 500)
    SELECT m.event_id, round(min_by(q, struct_pack(away := away, k := k)), 9) AS rate FROM m LEFT JOIN x USING (event_id) GROUP BY m.event_id""")
def rate_snap(spark, d):
    measured = F.lit(0.95) + (F.col("event_id") % 1000) / F.lit(10000.0)
    return read(spark, d, "events").select("event_id", F.round(timing.snapped_rate(measured, F.lit(720_000.0)), 9).alias("rate"))


@query(f"""WITH {EVENTS}, t AS (SELECT event_id, ms % 40000000 AS t FROM e)
    SELECT event_id, printf('%02d:%02d:%02d,%03d', t // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000) AS clock, t AS ms FROM t""")
def clock_round_trip(spark, d):
    t = events(spark, d, "event_id").select("event_id", (F.col("ms") % 40_000_000).alias("t")).withColumn("clock", timing.format_clock(F.col("t")))
    return t.select("event_id", "clock", timing.parse_clock(F.col("clock")).alias("ms"))


@query("""SELECT o_orderkey, CASE WHEN p >= 1000000 THEN CAST(CAST(round(p / 1e6) AS BIGINT) AS VARCHAR) || ' MB' WHEN p >= 1000 THEN CAST(CAST(round(p / 1e3) AS BIGINT) AS VARCHAR) || ' kB' ELSE CAST(p AS VARCHAR) || ' bytes' END AS size,
    CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min' WHEN m % 60 = 0 THEN CAST(m // 60 AS VARCHAR) || ' hr' ELSE CAST(m // 60 AS VARCHAR) || ' hr ' || CAST(m % 60 AS VARCHAR) || ' min' END AS runtime,
    CASE WHEN m % 3 > 0 THEN '+' || printf('%.2f s', m * 10 / 1000.0) ELSE printf('%.2f s', 0.0) END AS shift
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 37 ) AS BIGINT) AS p, 1 + o_orderkey % 300 AS m FROM orders)""")
def media_labels(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 37).alias("p"), (1 + F.col("o_orderkey") % 300).alias("m"))
    shift = F.when(F.col("m") % 3 > 0, F.col("m") * 10).otherwise(0)
    return o.select("o_orderkey", timing.size_label(F.col("p")).alias("size"), timing.runtime_label(F.col("m") * 60_000).alias("runtime"), timing.offset_label(shift).alias("shift"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 100000 AS BIGINT) AS a, CAST(l_quantity * 200000 AS BIGINT) AS z, 4000000 + l_partkey * 10 AS size FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN a < size AND least(z, size - 1, a + 4194303) >= a THEN a ELSE -1 END AS first, CASE WHEN a < size AND least(z, size - 1, a + 4194303) >= a THEN least(z, size - 1, a + 4194303) ELSE -1 END AS last FROM r""")
def range_clamp(spark, d):
    l = read(spark, d, "lineitem")
    first, last = timing.byte_range((F.col("l_quantity") * 100_000).cast("long"), (F.col("l_quantity") * 200_000).cast("long"), F.lit(None).cast("long"), 4_000_000 + F.col("l_partkey") * 10)
    return l.select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last")).fillna(-1, ["first", "last"])


@query("""WITH f AS (SELECT o_orderkey, 'film' || o_orderkey || '.' || CASE o_orderkey % 7 WHEN 0 THEN 'MKV' WHEN 1 THEN 'mp4' WHEN 2 THEN 'srt' WHEN 3 THEN 'png' WHEN 4 THEN 'nfo' WHEN 5 THEN 'txt' ELSE 'webm' END AS name FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'film' WHEN 1 THEN 'film' WHEN 6 THEN 'film' WHEN 2 THEN 'subtitle' WHEN 3 THEN 'image' WHEN 4 THEN 'sidecar' END AS kind,
      CASE o_orderkey % 7 WHEN 0 THEN 'Matroska' WHEN 1 THEN 'MP4' WHEN 6 THEN 'WebM' END AS container FROM f""")
def file_kinds(spark, d):
    k = F.array(*(F.lit(x) for x in ("MKV", "mp4", "srt", "png", "nfo", "txt", "webm")))
    name = F.concat(F.lit("film"), F.col("o_orderkey"), F.lit("."), F.element_at(k, (F.col("o_orderkey") % 7 + 1).cast("int")))
    return read(spark, d, "orders").select("o_orderkey", media.file_kind(name).alias("kind"), media.container_name(name).alias("container"))


@query("""SELECT p_partkey, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(lower(p_name), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 360000 AS DOUBLE) / 1000.0 AS hue FROM part""")
def fallback_hue(spark, d):
    return read(spark, d, "part").select("p_partkey", media.fallback_hue(F.col("p_name")).alias("hue"))


# ---- pairing -------------------------------------------------------------------------------------------------------------

NAMES = """n AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, CASE WHEN p_size > 10 THEN p_size END AS year FROM part)"""


@query(f"""WITH {NAMES}, m AS (SELECT a.id AS subtitle, count(*) AS n_films, min(b.id) AS film FROM n a JOIN n b ON a.key = b.key AND b.key <> '' AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year) GROUP BY a.id)
    SELECT subtitle, n_films, CASE WHEN n_films = 1 THEN film ELSE -1 END AS film FROM m""")
def exact_or_nothing_join(spark, d):
    n = read(spark, d, "part").select("p_partkey", names.comparable(F.col("p_name")).alias("key"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("year"))
    return pairing.exact(n.withColumnRenamed("p_partkey", "subtitle"), n.withColumnRenamed("p_partkey", "film")).fillna(-1, ["film"])


@query("""WITH w AS (SELECT p_partkey AS id, p_size AS year, string_split(lower(p_name || ' ' || p_type), ' ') AS w, string_split(lower(p_name), ' ') AS f FROM part),
    m AS (SELECT a.id AS subtitle, b.id AS film, least(len(a.w), len(b.f)) AS shared FROM w a JOIN w b ON a.year = b.year AND a.w[1] = b.f[1] AND a.w[1:least(len(a.w), len(b.f))] = b.f[1:least(len(a.w), len(b.f))]
      WHERE least(len(a.w), len(b.f)) > 1 OR octet_length(encode(a.w[1])) >= 4),
    b AS (SELECT subtitle, max(shared) AS shared FROM m GROUP BY ALL), t AS (SELECT m.subtitle, m.shared, min(film) AS film, count(DISTINCT film) AS n FROM m JOIN b ON m.subtitle = b.subtitle AND m.shared = b.shared GROUP BY ALL)
    SELECT subtitle, film, shared FROM t WHERE n = 1""")
def prefix_join_best(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("year"), F.lower("p_name").alias("name"), F.lower("p_type").alias("type"))
    subs = p.select(F.col("p_partkey").alias("subtitle"), F.split(F.concat_ws(" ", "name", "type"), " ").alias("words"), "year")
    return pairing.by_beginning(subs, p.select(F.col("p_partkey").alias("film"), F.split("name", " ").alias("words"), "year"))


@query("""SELECT p_partkey, 'Film Of ' || p_brand || '' AS title, 1950 + p_size AS year, 'en' AS language, p_partkey % 3 = 0 AS forced FROM
    (SELECT p_partkey, p_size, regexp_replace(p_brand, '[^A-Za-z0-9]', ' ', 'g') AS p_brand FROM part)""")
def name_parse(spark, d):
    p = read(spark, d, "part")
    name = F.concat(F.lit("Film.Of."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "."), F.lit("."), (1950 + F.col("p_size")).cast("string"), F.lit(".1080p.BluRay.x264-GRP.English"), F.when(F.col("p_partkey") % 3 == 0, ".forced").otherwise(""), F.lit(".srt"))
    got = p.select("p_partkey", names.parsed_name(name).alias("n"))
    return got.select("p_partkey", "n.title", "n.year", "n.language", "n.forced")


# ---- upserts and plans -----------------------------------------------------------------------------------------------------

DELTA = """f AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 2000
    UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal, NULL FROM customer WHERE c_nationkey < 3)"""


def delta(c: DataFrame) -> DataFrame:
    kept = c.where("c_acctbal > 2000").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return kept.unionByName(c.where("c_nationkey < 3").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", "c_acctbal", F.lit(None).cast("string").alias("c_mktsegment")))


@query(f"""WITH {DELTA} SELECT coalesce(s.c_custkey, f.c_custkey) AS c_custkey, CASE WHEN f.c_custkey IS NULL THEN s.c_acctbal ELSE f.c_acctbal END AS c_acctbal, coalesce(f.c_mktsegment, s.c_mktsegment) AS c_mktsegment,
    s.c_custkey IS NULL OR (f.c_custkey IS NOT NULL AND (s.c_acctbal IS DISTINCT FROM f.c_acctbal OR coalesce(f.c_mktsegment, s.c_mktsegment) IS DISTINCT FROM s.c_mktsegment)) AS changed FROM customer s FULL JOIN f ON s.c_custkey = f.c_custkey""")
def upsert_changed(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return upserts.upserted(c.drop("c_nationkey"), delta(c), ["c_custkey"], ["c_acctbal"], ["c_mktsegment"]).drop("c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def vanished_anti(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_custkey")
    return upserts.without(c, o, "c_custkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def present_semi(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 7 WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 99 ELSE 0 END AS missing_since FROM customer""")
def soft_delete(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, 7).alias("missing_since"))
    return upserts.marked_missing(c, read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 99).fillna(0, ["missing_since"])


@query("""WITH s AS (SELECT p_partkey, p_size FROM part WHERE p_size > 10), f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_partkey % 7 AS film FROM part WHERE p_brand <> 'Brand#1')
    SELECT CAST(coalesce(s.p_partkey, f.p_partkey) AS VARCHAR) AS path, CASE WHEN s.p_partkey IS NULL THEN 'read' WHEN f.p_partkey IS NULL THEN CASE WHEN s.p_partkey % 6 = 0 THEN 'keep' ELSE 'remove' END
      WHEN s.p_size <> f.p_size THEN 'read' WHEN s.p_partkey % 6 <> 0 AND f.film = 0 THEN 'repoint' ELSE 'keep' END AS action FROM s FULL JOIN f ON s.p_partkey = f.p_partkey""")
def removed_plan(spark, d):
    p = read(spark, d, "part")
    by_hand = F.when(F.col("p_partkey") % 6 == 0, "by-hand").otherwise("exact")
    stored = p.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("size_bytes"), F.lit(1).alias("modified_at"), F.lit(1).alias("film_id"), by_hand.alias("match_kind"))
    found = p.where("p_brand <> 'Brand#1'").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size_bytes"), F.lit(1).alias("modified_at"), F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1).alias("film_id"), F.lit("exact").alias("match_kind"))
    return upserts.plan(stored, found)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')""")
def cascade_delete(spark, d):
    gone = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = read(spark, d, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return upserts.without(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, CAST(1 AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'""")
def replaced_partition(spark, d):
    fresh = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return upserts.replaced(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), fresh, "l_orderkey")


# ---- library views ------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS film_id, c_name AS title, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS updated_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY updated_at DESC, film_id LIMIT 12""")
def resume_topk(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("film_id"), "o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), (F.col("o_orderstatus") != "O").alias("finished"))
    films = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("film_id"), F.col("c_name").alias("title"))
    return library.resumable(o, films, 12).select("film_id", "title", "updated_at")


@query("""WITH t AS (SELECT c_custkey, c_name, c_nationkey, max(o_totalprice) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY k DESC NULLS LAST, c_name) AS down, row_number() OVER (PARTITION BY c_nationkey ORDER BY k ASC NULLS LAST, c_name) AS up FROM t""")
def library_sort_nulls_last(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("k"))
    t = read(spark, d, "customer").join(o, "c_custkey", "left")
    down = library.numbered_by(t, ["c_nationkey"], F.col("k"), True, ["c_name"], "down")
    return library.numbered_by(down, ["c_nationkey"], F.col("k"), False, ["c_name"], "up").select("c_custkey", "down", "up")


@query("""SELECT regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS shelf, min(page_id) AS first_id, count(*) AS n FROM pages GROUP BY 1""")
def shelf_grouping(spark, d):
    root = F.regexp_extract("url", "^(.*://[^/]*)", 1)
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("shelf"))
    return library.shelves(pages, "shelf", "page_id")


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS film_id, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 2 END + CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS score FROM supplier)
    SELECT film_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY score DESC, id) AS k FROM s) WHERE k = 1""")
def default_track_rank(spark, d):
    t = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("film_id"), F.when(F.col("s_suppkey") % 3 == 0, "en").otherwise("fr").alias("language"), (F.col("s_suppkey") % 4 == 0).alias("forced"), (F.col("s_suppkey") % 5 == 0).alias("hearing_impaired"))
    return library.default_track(t, "film_id", "en", "id").select("film_id", "id", "score")


RANKED = """f AS (SELECT o_custkey AS film, CASE left(o_orderpriority, 1) WHEN '1' THEN 'chosen' WHEN '2' THEN 'beside' WHEN '3' THEN 'sidecar' WHEN '4' THEN 'folder-above' ELSE 'none' END AS source, CAST(o_orderkey AS VARCHAR) AS path FROM orders)"""


def ranked(spark, d):
    p = F.left("o_orderpriority", F.lit(1))
    source = F.when(p == "1", "chosen").when(p == "2", "beside").when(p == "3", "sidecar").when(p == "4", "folder-above").otherwise("none")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("film"), source.alias("source"), F.col("o_orderkey").cast("string").alias("path"), "o_orderkey")


@query(f"""WITH {RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY film ORDER BY CASE source WHEN 'chosen' THEN 0 WHEN 'beside' THEN 2 WHEN 'sidecar' THEN 3 WHEN 'folder-above' THEN 4 ELSE 5 END, path) AS k FROM f) SELECT film, source, path FROM r WHERE k = 1""")
def cover_min_rank(spark, d):
    return covers.decided(ranked(spark, d))


@query(f"""WITH {RANKED} SELECT source, count(*) AS n, CAST(min(CAST(path AS BIGINT)) AS VARCHAR) AS example FROM f WHERE source <> 'none' GROUP BY source""")
def cover_tally(spark, d):
    return library.cover_tally(ranked(spark, d), "source", "path", "o_orderkey")


@query("""WITH m AS (SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'eche')) SELECT doc_id, (SELECT count(*) FROM m) AS found FROM m ORDER BY doc_id LIMIT 40""")
def palette_search(spark, d):
    return library.search(read(spark, d, "documents"), "text", " Èche ", "doc_id")


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[0-9]+', '', 'g') || lpad(regexp_extract(c_name, '[0-9]+'), 12, '0') AS key FROM customer")
def natural_sort_key(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.natural_key(F.col("c_name")).alias("key"))


@query("""SELECT CASE WHEN count(*) FILTER (c_acctbal IS NULL) = 0 AND count(*) > 0 THEN CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) END AS total FROM customer""")
def library_total(spark, d):
    return library.total_or_null(read(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")), "cents")


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, event_type, ms, event_id FROM e)
    SELECT user_id, event_type AS kind, min_by(event_id, struct_pack(ms := ms, id := event_id)) AS first_line, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY min(struct_pack(ms := ms, id := event_id)), event_type) AS rank FROM w GROUP BY user_id, event_type""")
def warning_fold(spark, d):
    e = events(spark, d, "user_id", "event_id", F.col("event_type").alias("kind"))
    return subtitles.folded_warnings(e.select("user_id", "kind", F.col("event_id").alias("line"), F.struct("ms", "event_id").alias("at")), "user_id", "at")


@query("""WITH t AS (SELECT labels.doc_id, quality, toxic, doc_id % 10 / 10.0 AS score FROM labels), b AS (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6]) AS bar)
    SELECT CAST(bar AS DOUBLE) AS bar, count(*) FILTER (score >= bar AND quality = 1) AS right_n, count(*) FILTER (score >= bar AND quality = 0) AS wrong_n, count(*) FILTER (score < bar AND quality = 1) AS missed_n FROM t, b GROUP BY bar""")
def verdict_sweep(spark, d):
    bars = F.array(*(F.lit(x) for x in (0.02, 0.05, 0.10, 0.20, 0.30, 0.45, 0.60)))
    t = read(spark, d, "labels").select("quality", (F.col("doc_id") % 10 / 10.0).alias("score"), F.explode(bars).alias("bar"))
    hit, good = F.col("score") >= F.col("bar"), F.col("quality") == 1
    return t.groupBy("bar").agg(F.count_if(hit & good).alias("right_n"), F.count_if(hit & (F.col("quality") == 0)).alias("wrong_n"), F.count_if(~hit & good).alias("missed_n"))


# ---- subtitles and alignment --------------------------------------------------------------------------------------------------


def rendered(spark, d, end: str = "\n") -> DataFrame:
    """Conversations as SRT files (path, text): a turn every 4 s, every fifth starting with markup, the number left out of every seventh. Whole texts."""
    c = read(spark, d, "conversations").withColumn("said", F.trim(F.regexp_replace("text", r"[^A-Za-z ]+", " ")))
    clock = lambda ms: timing.format_clock(ms)
    start = F.col("turn") * 4000
    line = F.concat(
        F.when(F.col("turn") % 7 == 6, "").otherwise(F.concat((F.col("turn") + 1).cast("string"), F.lit(end))), clock(start), F.lit(" --> "), clock(start + 3000), F.lit(end),
        F.when(F.col("turn") % 5 == 0, "{\\an8}<i>").otherwise(""), F.lit("said "), F.col("said"), F.when(F.col("turn") % 5 == 0, "</i>").otherwise(""), F.lit(end * 2),
    )
    return c.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("text"))


PARSED = """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' ') AS said FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, turn * 4000 AS start_ms, turn * 4000 + 3000 AS end_ms, CASE WHEN turn % 5 = 0 THEN 8 ELSE 0 END AS position, trim('said ' || said, ' ') AS text FROM c"""


@query(PARSED)
def srt_parse(spark, d):
    return subtitles.parsed(rendered(spark, d))[0].fillna(0, ["position"])


@query(PARSED)
def srt_parse_whole(spark, d):
    """The same with the line ends of another system."""
    return subtitles.parsed(rendered(spark, d, "\r\n"))[0].fillna(0, ["position"])


@query("""SELECT CAST(conv_id AS VARCHAR) AS path, 'MissingIndex' AS kind, count(*) AS n FROM conversations WHERE turn % 7 = 6 GROUP BY ALL""")
def srt_warnings(spark, d):
    return subtitles.parsed(rendered(spark, d))[1].select("path", "kind", "n")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS ordinal FROM conversations""")
def cue_numbering(spark, d):
    return intervals.numbered(read(spark, d, "conversations"), ["conv_id"], ["turn", "role"]).select("conv_id", "turn", "ordinal")


@query()
def tag_strip(spark, d):
    return read(spark, d, "pages").select("page_id", text.cleaned(F.col("html")).alias("c")).select("page_id", "c.text", "c.position")


@query("""WITH c AS (SELECT conv_id, turn, conv_id % 7 AS way, regexp_matches(text, '[A-Za-z0-9]') AS said FROM conversations)
    SELECT conv_id, turn, CASE WHEN way IN (1, 2, 4) THEN FALSE WHEN way = 5 THEN TRUE ELSE said END AS spoken FROM c""")
def spoken_lines(spark, d):
    """Every line, as it is, in brackets over two lines, sung, with a speaker's label, as a lyric, as an aside before a word, and as an aside inside one."""
    plain = F.regexp_replace("text", "[^A-Za-z0-9 ]+", " ")
    ways = F.array(
        plain, F.concat(F.lit("[ah\n"), plain, F.lit("]")), F.concat(F.lit("\u266a "), plain), F.concat(F.lit("MAN: "), plain), F.concat(F.lit(" # "), plain),
        F.concat(F.lit("("), plain, F.lit(") Yes")), F.concat(F.lit("(so [to] say) "), plain),
    )
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", text.spoken(F.element_at(ways, (F.col("conv_id") % 7 + 1).cast("int"))).alias("spoken"))


@query()
def align_recovery(spark, d):
    """A film for each two hours of the events, its speech made of them, and four tracks of lines moved from it by known corrections: what is found undoes them.

    track_id is four times the film's place from 1970 on, in slots of two hours, and the track's own 0 to 3.
    """
    e = events(spark, d, "event_id").where("ms IS NOT NULL")
    slot = F.floor(F.col("ms") / SLOT).cast("long")
    base = e.select(slot.alias("film"), (F.col("ms") - slot * SLOT).alias("t"), (F.coalesce(F.col("event_id") % 5, F.lit(0)) * 400 + 900).alias("lasts")).withColumn("text", F.lit("line"))
    runs = alignment.cue_runs(base.select("film", F.col("t").alias("start_ms"), (F.col("t") + F.col("lasts")).alias("end_ms"), "text"), ["film"]).withColumn("film_bins", F.lit(SLOT // 10).cast("long"))
    shifts = F.array(*(F.struct(F.lit(i).cast("long").alias("track"), F.lit(s).alias("shift")) for i, s in enumerate((0, 2000, -4500, 30_000))))
    tracks = base.select("*", F.inline(shifts)).select((F.col("film") * 4 + F.col("track")).alias("track_id"), "film", F.greatest(F.lit(0), F.col("t") - F.col("shift")).alias("start_ms"), F.greatest(F.lit(0), F.col("t") + F.col("lasts") - F.col("shift")).alias("end_ms"), "text")
    return alignment.aligned(tracks, runs)


LINES = "SELECT event_id // 400 AS film, event_id AS line, (ms * 7919 + event_id * 104729) % 7200000 // 10 * 10 AS t, 900 + event_id % 5 * 400 AS lasts FROM e WHERE event_id IS NOT NULL AND ms IS NOT NULL"


@query(f"""WITH {EVENTS}, l AS ({LINES}), n AS (SELECT film, count(*) AS n FROM l GROUP BY film), t AS (SELECT film, unnest([0, 1, 2, 3]) AS k FROM n),
    c AS (SELECT t.film, k, CASE k WHEN 2 THEN least(n.n, 50) WHEN 3 THEN coalesce(m.n, 0) ELSE n.n END AS cues, coalesce(m.n, 0) AS other, n.n AS own FROM t JOIN n USING (film) LEFT JOIN n m ON m.film = t.film + 1),
    o AS (SELECT *, CASE WHEN cues < 100 THEN 'too-few-cues' WHEN k < 2 THEN 'aligned' WHEN film % 3 = 0 THEN 'no-audio' ELSE 'uncertain' END AS outcome FROM c)
    SELECT film * 4 + k AS track_id, outcome, CASE outcome WHEN 'aligned' THEN 'track' WHEN 'uncertain' THEN 'sound' END AS against, CASE WHEN outcome = 'aligned' THEN CASE k WHEN 0 THEN -2000 ELSE 2000 END ELSE 0 END AS offset_ms FROM o""")
def track_outcomes(spark, d):
    """A film of each 400 events, its speech made of them but for each third, and four tracks: the lines, the lines 2 s early, 50 of them, and the next film's."""
    e = events(spark, d, "event_id").where("event_id IS NOT NULL AND ms IS NOT NULL")
    at = F.floor((F.col("ms") * 7919 + F.col("event_id") * 104729) % 7_200_000 / 10) * 10
    lines = e.select(F.floor(F.col("event_id") / 400).alias("film"), F.col("event_id").alias("line"), at.alias("t"), (900 + F.col("event_id") % 5 * 400).alias("lasts"))
    early = F.greatest(F.lit(0), F.col("t") - 2000)
    ways = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), film.alias("film_id"), start.alias("start_ms")) for k, film, start in ((0, F.col("film"), F.col("t")), (1, F.col("film"), early), (2, F.col("film"), F.col("t")), (3, F.col("film") - 1, F.col("t")))))
    place = F.row_number().over(Window.partitionBy("film").orderBy("line"))  # 400 rows
    dealt = lines.withColumn("place", place).select("*", F.inline(ways)).where("(k <> 2 OR place <= 50) AND film_id >= 0")
    cues = dealt.select((F.col("film_id") * 4 + F.col("k")).alias("track_id"), F.col("place").alias("ordinal"), "start_ms", (F.col("start_ms") + F.col("lasts")).alias("end_ms"), F.lit(None).cast("int").alias("position"), F.lit("line").alias("text"))
    films = lines.select("film").distinct()
    counts = cues.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("cue_count"))
    tracks = films.select(F.col("film").alias("film_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select((F.col("film_id") * 4 + F.col("k")).alias("id"), "film_id", "k").join(counts, "id", "left").select(
        "id", "film_id", F.when(F.col("k") == 0, "stream").otherwise("sidecar").alias("origin"), F.when(F.col("k") == 3, "odd").otherwise("subrip").alias("codec"), F.coalesce("cue_count", F.lit(0)).alias("cue_count"), F.lit(0).alias("offset_ms"), F.lit(1.0).alias("rate"),
    )
    listened = films.where("film % 3 <> 0").select(F.col("film").alias("film_id"), F.lit("ok").alias("outcome"))
    speech = alignment.cue_runs(lines.where("film % 3 <> 0").select("film", F.col("t").alias("start_ms"), (F.col("t") + F.col("lasts")).alias("end_ms"), F.lit("line").alias("text")), ["film"]).withColumn("film_bins", F.lit(SLOT // 10).cast("long"))
    decided = decisions.outcomes(tracks, cues, lambda wanted: (listened.join(wanted, "film_id", "left_semi"), speech.join(wanted.select(F.col("film_id").alias("film")), "film", "left_semi")))
    return decided.select("track_id", "outcome", "against", F.when(F.col("outcome") == "aligned", F.round(F.col("offset_ms") / 100) * 100).otherwise(0).cast("long").alias("offset_ms"))
