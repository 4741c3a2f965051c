"""SRT files as cues: lines are classified by windows over each file, so that the block structure is relational.

A line with an arrow is a timing. Each timing opens a cue, whose text is the lines after it up to a blank one, the next
timing, or a number line right before the next timing. What stands outside cues gives warnings. Files are
parted by path; a file is read by one task, files by many.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions import charsets
from reelgrid.functions.text import cleaned
from reelgrid.functions.timing import parse_clock


def decode_bytes(raw: bytes | None) -> tuple[str, str, bool]:
    """(text, encoding, whether bytes were replaced): by byte-order mark, then the shape of UTF-16, strict UTF-8, and a guess."""
    raw = raw or b""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            text = raw[len(mark) :].decode(name, "replace")
            return text, name, "�" in text
    head = raw[:1024]
    if len(head) >= 4:
        for name, at in (("utf-16-be", 0), ("utf-16-le", 1)):
            if head[at::2].count(0) > len(head) / 4:
                text = raw.decode(name, "replace")
                return text, name, "�" in text
    try:
        return raw.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    name, codec = charsets.guessed(raw)
    text = raw.decode(codec, "replace")
    return text, name, "�" in text


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with ``text``, ``encoding`` and ``replaced`` in place of their bytes."""

    @F.pandas_udf("text string, encoding string, replaced boolean")
    def decode(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(b) for b in raw], columns=["text", "encoding", "replaced"])

    return files.withColumn("_d", decode(F.col(content))).select(*(c for c in files.columns if c != content), "_d.*")


def _lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line, t) and what each line is, with its neighbours."""
    split = F.split(F.col(text), "\r\n|\n|\r")
    n = F.size(split)
    split = F.when(F.element_at(split, -1) == "", F.slice(split, 1, n - 1)).otherwise(split)
    rows = files.select(F.col(path).alias("path"), F.posexplode(split).alias("line", "t")).withColumn("line", F.col("line") + 1)
    bare = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    rows = rows.withColumns({"blank": bare == "", "timing": F.col("t").contains("-->"), "number": bare.rlike("^[0-9]+$")})
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumns({"next_timing": F.coalesce(F.lead("timing").over(w), F.lit(False)), "last": F.lead("line").over(w).isNull(), "block": F.sum(F.col("timing").cast("int")).over(w)})
    # within a block, lines count as text until a blank one or the number of the next block
    ends = F.col("blank") | (F.col("number") & F.col("next_timing"))
    b = Window.partitionBy("path", "block").orderBy("line")
    return rows.withColumn("stopped", F.coalesce(F.max(F.when(~F.col("timing"), ends)).over(b), F.lit(False)) | (F.col("block") == 0))


def parsed(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cues, warnings) of files: cues (path, ordinal, start_ms, end_ms, position, text), warnings (path, kind, first_line, n, rank).

    Cues are in file order unless a start goes back, and then by (start, end). Warnings are folded by kind; rank is the
    order of their first occurrence.
    """
    lines = _lines(files, path, text)
    w = Window.partitionBy("path").orderBy("line")
    # a timing's own line is what opens its block, unless the line before it belongs to no cue or is a number
    before_text = F.lag(~F.col("stopped") | F.col("timing")).over(w)
    before = F.struct(F.lag("line").over(w).alias("line"), F.lag("number").over(w).alias("number"), F.lag("blank").over(w).alias("blank"), F.lag("timing").over(w).alias("timing"), F.coalesce(before_text, F.lit(False)).alias("text"))
    timings = lines.withColumn("before", before).where("timing")
    lonely = F.col("before.line").isNull() | F.col("before.blank") | F.col("before.timing") | (F.col("before.text") & ~F.col("before.number"))
    lone = timings.where(lonely).select("path", F.col("line").alias("at"), "line", F.lit("MissingIndex").alias("kind"))
    odd = timings.where(~lonely & ~F.col("before.number")).select("path", F.col("before.line").alias("at"), F.col("before.line").alias("line"), F.lit("MalformedIndex").alias("kind"))
    stray = lines.where(F.col("stopped") & ~F.col("blank") & ~F.col("timing") & ~F.col("next_timing"))
    stray = stray.select("path", F.col("line").alias("at"), "line", F.when(F.col("number") & F.col("last"), "TruncatedCue").otherwise("UnexpectedLine").alias("kind"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("timing") & ~F.col("stopped"), F.struct("line", "t")))), lambda x: x["t"]), "\n")
    clock = F.max(F.when(F.col("timing"), F.col("t")))
    blocks = lines.where("block > 0").groupBy("path", "block").agg(F.min("line").alias("line"), clock.alias("clock"), body.alias("body"))
    left, right = F.split_part("clock", F.lit("-->"), F.lit(1)), F.regexp_extract("clock", "-->(.*)$", 1)
    blocks = blocks.withColumns({"start_ms": parse_clock(F.regexp_extract(left, r"(\S+)\s*$", 1)), "end_ms": parse_clock(F.regexp_extract(right, r"^\s*(\S+)", 1)), "clean": cleaned(F.col("body"))})
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    kind = F.when(~timed, "MalformedTiming").when(F.col("clean.text") == "", "EmptyCue").when(F.col("end_ms") < F.col("start_ms"), "NegativeDuration")
    wrong = blocks.where(kind.isNotNull()).select("path", (F.col("line") + 0.5).alias("at"), "line", kind.alias("kind"))
    cues = blocks.where(timed & (F.col("clean.text") != "")).select("path", "line", "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), "clean.position", "clean.text")
    by_line = Window.partitionBy("path").orderBy("line")
    back = cues.withColumn("back", F.col("start_ms") < F.lag("start_ms").over(by_line))
    back = back.withColumn("back", F.coalesce(F.max("back").over(Window.partitionBy("path")), F.lit(False)))
    final = Window.partitionBy("path").orderBy(F.when(F.col("back"), F.col("start_ms")), F.when(F.col("back"), F.col("end_ms")), "line")
    cues = back.withColumns({"ordinal": F.row_number().over(final).cast("long"), "overlaps": F.col("start_ms") < F.lag("end_ms").over(final)})
    whole = cues.groupBy("path").agg(F.max("back").alias("back"), F.max(F.coalesce("overlaps", F.lit(False))).alias("overlaps"))
    after = lambda flag, kind, place: whole.where(flag).select("path", F.lit(place).alias("at"), F.lit(0).alias("line"), F.lit(kind).alias("kind"))
    noted = [odd, stray, wrong, after("back", "OutOfOrder", 1e9), after("overlaps", "OverlappingCues", 1e9 + 1)]
    if "replaced" in files.columns:
        noted.append(files.where("replaced").select(F.col(path).alias("path"), F.lit(-1).alias("at"), F.lit(0).alias("line"), F.lit("UndecodableBytes").alias("kind")))
    warnings = lone
    for more in noted:
        warnings = warnings.unionByName(more)
    return cues.select("path", "ordinal", "start_ms", "end_ms", "position", "text"), folded_warnings(warnings, "path", "at")


def folded_warnings(warnings: DataFrame, by: str, order: str) -> DataFrame:
    """(by, kind, first_line, n, rank): each kind once, with the line of its first occurrence and how often it occurs."""
    first = warnings.groupBy(by, "kind").agg(F.min_by("line", order).alias("first_line"), F.count("*").alias("n"), F.min(order).alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_at", "kind")).cast("long")).drop("_at")


def warning_message(kind: Column, n: Column, first_line: Column) -> Column:
    times = F.when(n > 1, F.format_string(" (%d times)", n)).otherwise("")
    return F.concat(kind, times, F.when(first_line > 0, F.format_string(", first on line %d", first_line)).otherwise(""))
