"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of anything but the six ASCII white-space characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


#: The same for str.translate and bytes.translate.
LOWER_TABLE = str.maketrans(UPPER, LOWER)
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows of an Arrow batch that a UDF takes at a time.
ROWS = 500


def space_words(text: str | bytes | None) -> list[bytes]:
    """The words SPACE_WORD of a text, A-Z lower-cased, in UTF-8: bytes are split at the same six characters."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(LOWER_BYTES).split()


def mapped(values: pa.Array, make: Callable, kind: pa.DataType) -> pa.Array:
    """An array of make(value) for each value; Python objects are held for ROWS of them only."""
    done = [pa.array([make(x.as_py()) for x in values[i : i + ROWS]], kind) for i in range(0, len(values), ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hot_join sets apart, whatever the table: so many rows are broadcast at most.
HOTTEST = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key at most; how: inner or left.

    The HOTTEST keys of left, by their counts, meet their rows of right by a broadcast of these rows alone, so a key with a
    large share of left's rows isn't dealt to one task. All other rows are joined as usual. left is read twice: a table.
    """
    hot = staged(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(HOTTEST).select(key), "hot")
    theirs = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    one = left.join(F.broadcast(hot), key, "left_semi").join(theirs, key, how)
    return one.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def whole_rows(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as one struct column ``row`` beside columns of our own, so that no name of theirs can clash."""
    return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="reelgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_sql(text: str) -> str:
    """crc32 of an expression of ASCII text for DuckDB, which has no such function: a step for each byte, eight within it."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _ : xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s : CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b : {step}), 4294967295)"
