"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each, linked to it.

Record ids are derived from what a record says, so a second run makes the same ones; repeated rows have equal ids.
Null URLs and bodies are empty. All of it is column expressions: a map without a shuffle, whatever the sizes.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: The records of a derivative carry the time of their response; responses made from a table have this one.
EPOCH = "2024-01-01T00:00:00Z"
#: Named entities that text has most, in the order of decoding; the ampersand comes last, so nothing is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: (pattern, replacement): what isn't text goes, block ends break lines, other tags vanish. Java and RE2 read them alike.
HTML_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(script|style|noscript|template)\b.*?</(script|style|noscript|template)\s*>", ""),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|body|head|html|blockquote|pre)\b[^>]*>", "\n"),
    (r"<[/!?]?[A-Za-z][^>]*>", ""),
)
SPACE_STEPS = ((r"[\x20\x09\x0B-\x0D]+", " "), (r"\x20?\n[\x20\n]*", "\n"))


def plain_text(html: Column) -> Column:
    """The text that a page shows; a line for each block."""
    text = F.coalesce(html, F.lit(""))
    for pattern, to in HTML_STEPS:
        text = F.regexp_replace(text, pattern, to)
    for entity, to in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(to))
    for pattern, to in SPACE_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^[\x20\n]+|[\x20\n]+$", "")


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def record_id(*parts: Column) -> Column:
    """urn:uuid from an MD5 of the parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Response records of a table of pages: key, record_id, target_uri, date, http_headers, payload, payload_digest."""
    payload, uri = F.coalesce(F.col(body), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col(key).alias("key"), record_id(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), uri, F.sha2(payload, 256)).alias("record_id"),
        uri.alias("target_uri"), F.lit(EPOCH).alias("date"), http.alias("http_headers"), payload.alias("payload"), digest(payload).alias("payload_digest"),
    )


def derive(found: DataFrame) -> DataFrame:
    """Two rows for each response: record_type metadata and conversion, with refers_to, source headers, digests and block.

    The metadata block lists the source's HTTP headers and payload digest, the title and the declared language; the
    conversion block is the plain text. concurrent_to links the two.
    """
    first = lambda pattern: F.regexp_extract("payload", pattern, 1)
    meta = F.concat_ws(
        CRLF, F.concat(F.lit("source-http-status: "), F.regexp_extract("http_headers", r"^HTTP/\S+ (\d+)", 1)),
        F.concat(F.lit("source-content-type: "), F.regexp_extract("http_headers", r"(?i)\nContent-Type:[ \t]*([^\r\n]*)", 1)),
        F.concat(F.lit("source-content-length: "), F.octet_length("payload").cast("string")), F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
        F.concat(F.lit("title: "), F.regexp_replace(first(r"(?is)<title[^>]*>(.*?)</title"), r"[\x20\x09-\x0D]+", " ")),
        F.concat(F.lit("language: "), first(r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)")), F.lit(""),
    )
    ids = {k: record_id(F.lit(k), F.col("record_id")) for k in ("metadata", "conversion")}
    made = lambda kind, other, mime, block: F.struct(F.lit(kind).alias("record_type"), ids[kind].alias("record_id"), ids[other].alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(made("metadata", "conversion", "application/warc-fields", meta), made("conversion", "metadata", "text/plain", plain_text(F.col("payload"))))
    rows = found.select("key", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", "payload_digest", F.inline(both))
    return rows.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": digest(F.col("block"))})


def serialised(records: DataFrame) -> DataFrame:
    """Records as WARC/1.0 text without the two line ends that close one; null header values are left out."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string")))
    has = lambda c: F.col(c) if c in records.columns else F.lit(None)
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.0"), line("WARC-Type", has("record_type")), line("WARC-Record-ID", has("record_id")), line("WARC-Date", has("date")),
        line("WARC-Target-URI", has("target_uri")), line("WARC-Refers-To", has("refers_to")), line("WARC-Concurrent-To", has("concurrent_to")),
        line("WARC-Block-Digest", has("block_digest")), line("WARC-Payload-Digest", has("payload_digest")), line("Content-Type", has("content_type")),
        line("X-Source-Key", has("key")), line("Content-Length", F.octet_length("block")),
    )
    return records.select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("value"))


def response_records(found: DataFrame) -> DataFrame:
    """Responses in the columns of serialised(): the block is the HTTP message."""
    block = F.concat("http_headers", F.lit(CRLF * 2), "payload")
    return found.withColumns({"record_type": F.lit("response"), "content_type": F.lit("application/http; msgtype=response"), "block": block}).withColumn("block_digest", digest(F.col("block")))


def write_warc(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Writes records as WARC files of per_file records at most: Spark's text writer, with a record's end as the line end."""
    serialised(records).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(path)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, by their Content-Length."""
    at = 0
    while (begin := data.find(b"WARC/1.", at)) >= 0 and (end := data.find(b"\r\n\r\n", begin)) >= 0:
        head = dict(x.split(": ", 1) for x in data[begin:end].decode("utf-8", "replace").split(CRLF)[1:] if ": " in x)
        n = int(length) if re.fullmatch("[0-9]{1,15}", length := head.get("Content-Length", "").strip()) else 0  # damaged: the next record is looked for after the header
        block, at = data[end + 4 : end + 4 + n], end + 4 + n
        yield {"record_type": head.get("WARC-Type"), "record_id": head.get("WARC-Record-ID"), "refers_to": head.get("WARC-Refers-To"), "concurrent_to": head.get("WARC-Concurrent-To"), "target_uri": head.get("WARC-Target-URI"), "date": head.get("WARC-Date"), "block_digest": head.get("WARC-Block-Digest"), "payload_digest": head.get("WARC-Payload-Digest"), "content_type": head.get("Content-Type"), "source_key": head.get("X-Source-Key"), "block": block.decode("utf-8", "replace")}


RECORD = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, block_digest string, payload_digest string, content_type string, source_key string, block string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path, a file at a time in a task; files are as large as their writer made them."""

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = parsed(content.as_py())
                while some := list(itertools.islice(rows, 256)):
                    yield pa.RecordBatch.from_pylist(some, schema=arrow)

    arrow = pa.schema([(c.split()[0], pa.string()) for c in RECORD.split(", ")])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses among the records under a path, in the columns that derive() takes; the key is what response records carry in the field X-Source-Key."""
    found = read_warc(spark, path).where("record_type = 'response'")
    cut = F.instr("block", CRLF * 2)
    return found.select(
        F.col("source_key").alias("key"), "record_id", "target_uri", "date", F.when(cut > 0, F.substring("block", F.lit(1), cut - 1)).otherwise("").alias("http_headers"),
        F.when(cut > 0, F.substring(F.col("block"), cut + 4, F.length("block"))).otherwise(F.col("block")).alias("payload"), "payload_digest",
    )


def oracle_sql() -> str:
    """op3's rows for DuckDB."""
    text = "coalesce(html, '')"
    for pattern, to in HTML_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    for entity, to in ENTITIES:
        text = f"replace({text}, '{entity}', '{to.replace(chr(39), chr(39) * 2)}')"
    for pattern, to in SPACE_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    text = f"regexp_replace({text}, '^[\\x20\\n]+|[\\x20\\n]+$', '', 'g')"
    uid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
    nl = "chr(13) || chr(10)"
    meta = f"""'source-http-status: 200' || {nl} || 'source-content-type: text/html; charset=utf-8' || {nl} || 'source-content-length: ' || octet_length(encode(payload))
        || {nl} || 'source-payload-digest: ' || payload_digest || {nl} || 'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '[\\x20\\x09-\\x0D]+', ' ', 'g')
        || {nl} || 'language: ' || regexp_extract(payload, '(?i)<html[^>]*\\blang=["'']?([A-Za-z-]+)', 1) || {nl}"""
    row = lambda kind, other, block: f"SELECT page_id, '{kind}' AS record_type, {uid(f'md5({chr(39)}{kind}{chr(39)} || chr(10) || refers_to)')} AS record_id, refers_to, {uid(f'md5({chr(39)}{other}{chr(39)} || chr(10) || refers_to)')} AS concurrent_to, target_uri, payload_digest, {block} AS block FROM r"
    return f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest, {text} AS plain FROM pages),
    r AS (SELECT *, {uid("md5('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || target_uri || chr(10) || substr(payload_digest, 8))")} AS refers_to FROM p),
    d AS ({row("metadata", "conversion", meta)} UNION ALL {row("conversion", "metadata", "plain")})
    SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, payload_digest, octet_length(encode(block)) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM d"""
