"""Windows over long series in chunks: positions, halos and carried values, so that one series is as many tasks as it is long.

A chunk is a stretch of a series. What a window needs from beyond its chunk comes as a halo of rows (a bounded window), or
as one row for each earlier or later chunk (a running or as-of value), which is a window over chunks, not over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def upto(by: Sequence[str], at: str, back: bool = False) -> WindowSpec:
    """All up to each moment, or with ``back`` all from it on: read from the end, as Spark computes a frame with an open end anew for each row."""
    return Window.partitionBy(*by).orderBy(F.col(at).desc() if back else F.col(at).asc()).rangeBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, by: Sequence[str], chunk: str, values: dict[str, Column], backward: Sequence[str] = ()) -> DataFrame:
    """(by, chunk, names): for each chunk of each series what the aggregates say over all chunks before it, or after it for names of ``backward``.

    Aggregates that merge by themselves: F.max, F.min, F.sum or F.count of rows; counts and sums are added up.
    """
    own = rows.groupBy(*by, chunk).agg(*(v.alias(name) for name, v in values.items()))
    before, after = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(chunk).asc(), F.col(chunk).desc()))
    merged = {name: (F.min if name in backward else F.max)(name).over(after if name in backward else before) for name in values}
    return own.select(*by, chunk, *(c.alias(name) for name, c in merged.items()))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], width: int, sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of whole numbers over all rows before them in their series.

    The first order column is a number, dealt to chunks of ``width``; a chunk's rows are summed in one task, the chunks' sums over one row for each.
    """
    dealt = rows.withColumn("_chunk", F.floor(F.col(order[0]) / width)).withColumns({f"_{name}": v.cast("long") for name, v in sums.items()})
    inner = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("_chunk").alias("_of_chunk")).agg(*(F.sum(f"_{name}").alias(f"_sum_{name}") for name in sums))
    outer = Window.partitionBy(*(f"_of_{b}" for b in by)).orderBy("_of_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(f"_of_{b}" for b in by), "_of_chunk", *(F.coalesce(F.sum(f"_sum_{name}").over(outer), F.lit(0)).alias(f"_before_{name}") for name in sums))
    met = dealt.withColumns({f"_in_{name}": F.coalesce(F.sum(f"_{name}").over(inner), F.lit(0)) for name in sums})
    met = met.join(before, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by] + [F.col("_chunk").eqNullSafe(F.col("_of_chunk"))])
    return met.select(*rows.columns, *((F.col(f"_before_{name}") + F.col(f"_in_{name}")).cast("long").alias(name) for name in sums))


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[str], width: int, name: str = "place") -> DataFrame:
    """rows with their place in each series from 0, as running() sums them; order columns tell all rows of a series apart."""
    return running(rows, by, order, width, {name: F.lit(1)})


def with_halo(rows: DataFrame, place: str, halo: int, size: int | None = None) -> DataFrame:
    """rows with ``chunk`` and ``own``: each in its chunk of ``size`` places, and again (own false) in the chunk beside it if it is within ``halo`` places of it."""
    size = max(size or 0, 8 * halo, 4096)
    at, within = F.floor(F.col(place) / size), F.pmod(F.col(place), F.lit(size))
    beside = F.array(
        F.struct(at.alias("chunk"), F.lit(True).alias("own")), F.when((within < halo) & (at > 0), F.struct((at - 1).alias("chunk"), F.lit(False).alias("own"))),
        F.when(within >= size - halo, F.struct((at + 1).alias("chunk"), F.lit(False).alias("own"))),
    )
    return rows.select("*", F.inline(F.array_compact(beside)))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, width: int, hit: Column | None = None) -> DataFrame:
    """left with ``previous`` (the last right_at <= at) and ``following`` (the first right_at >= at), null where there is none.

    hit: what is wanted of right in place of right_at, in the same order: a struct that begins with it.

    An as-of join both ways in chunks of ``width``: one shuffle of the union by series and chunk; what lies beyond a chunk comes from one row for each
    chunk of the series. No row is paired with another's. Rows without a time have neither.
    """
    row = F.struct(*left.columns)
    r = right.select(*by, F.col(right_at).alias("t"), (F.col(right_at) if hit is None else hit).alias("hit"))
    l = left.select(row.alias("row"), *by, F.col(at).alias("t"), F.lit(None).cast(r.schema["hit"].dataType).alias("hit"))
    r = r.select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), *by, "t", "hit")
    both = l.unionByName(r).withColumn("chunk", F.floor(F.col("t") / width))
    inner = both.withColumns({"_back": F.max("hit").over(upto([*by, "chunk"], "t")), "_ahead": F.min("hit").over(upto([*by, "chunk"], "t", True))}).where("row IS NOT NULL")
    # a row for each chunk that has any: hits, or left rows that ask for those of other chunks
    edges = carried(both, by, "chunk", {"_before": F.max("hit"), "_after": F.min("hit")}, ["_after"])
    edges = edges.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("chunk").alias("_of_chunk"), "_before", "_after")
    met = inner.join(edges, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by] + [F.col("chunk").eqNullSafe(F.col("_of_chunk"))])
    known = F.col("t").isNotNull()
    return met.select("row.*", F.when(known, F.coalesce("_back", "_before")).alias("previous"), F.when(known, F.coalesce("_ahead", "_after")).alias("following"))
