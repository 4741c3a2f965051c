"""Periodic runs of words: the divide and conquer of Main and Lorentz on interned word ids.

A run is a stretch of consecutive words with smallest period q and a length of LEAST words and POWER periods at least that no
neighbouring word extends. A block of words is cut in halves; Z-functions at the midpoint give, for every period, how far
words equal those a period away to its right and to its left, so every repetition that crosses the midpoint is found with
its whole extent; the halves follow. Intervals found with several periods keep the smallest. What a block's edge cuts
off isn't taken: the block above, whose midpoint is that edge or lies beyond it, has it whole.

Only stretches where each GRAM words occur twice in the text are searched. That loses nothing: with a length of 24 and of three
periods, each nine consecutive words of a run occur again a period later or earlier within it. Equal hashes of unequal words
only add stretches. So ordinary prose costs one sort, and a text of one repeated passage n log n steps.

Null and empty texts have no words and no runs. Texts are taken whole, however long; a text is one row's work. Repeated
rows have equal results, columns of the caller's aren't read but for the two named. Order of runs: by start, then period.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import ROWS, SPACE_WORD, crc32_sql

LEAST, POWER = 24, 3
#: 2 * period + GRAM - 1 words must fit into max(LEAST, POWER * period) for every period; 9 is the largest that does.
GRAM = 9
_WORD = re.compile(SPACE_WORD.encode())
_MIX = np.random.default_rng(1).integers(1, 2**63, GRAM, np.uint64) | np.uint64(1)


def own_prefixes(x: list, top: int) -> list[int]:
    """For each i up to top: how many items x[i:] begins with that x begins with (the Z-function)."""
    n = len(x)
    z = [0] * (top + 1)
    z[0] = n
    left = right = 0
    for i in range(1, min(top + 1, n)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def prefixes_in(x: list, z: list[int], text: list, begin: int, end: int) -> list[int]:
    """For each j from begin to end: how many items text[j:] begins with that x begins with; z is x's own_prefixes."""
    n, m, out = len(x), len(text), []
    left = right = begin
    for j in range(begin, end):
        k = 0
        if left < j < right:
            k = z[j - left]
            if k < right - j:
                out.append(k)
                continue
            k = right - j
        while k < n and j + k < m and x[k] == text[j + k]:
            k += 1
        out.append(k)
        left, right = j, j + k
    return out


def repeated_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of LEAST words or more in which each GRAM words occur twice."""
    n = len(ids) - GRAM + 1
    if n < LEAST - GRAM + 1:
        return []
    wide, hashed = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashed += (wide[k : k + n] * _MIX[k]) ^ (wide[k : k + n] << np.uint64(k * 5))
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = again[order[:-1][same] + 1] = 1
    edges = np.flatnonzero(np.diff(again)).reshape(-1, 2)
    return [(int(a), int(b) + GRAM - 1) for a, b in edges if b - a + GRAM - 1 >= LEAST]


def _crossing(x: list, low: int, high: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the repetitions within x[low:high] that cross its midpoint: (start, end) -> period, the smallest."""
    mid = (low + high) // 2
    block, right, before = x[low:high], x[mid:high], x[low:mid][::-1]
    back, n_left, n_right, most = block[::-1], mid - low, high - mid, (high - low) // POWER
    zr, zl = own_prefixes(right, most), own_prefixes(before, most)
    top_r, top_l = min(n_right, most), min(n_left, most)
    # one period right of the midpoint, then one left of it; steps beyond it and steps before it
    later = zip(range(1, top_r + 1), zr[1:], reversed(prefixes_in(before, zl, back, n_right - top_r, n_right)))
    earlier = zip(range(1, top_l + 1), reversed(prefixes_in(right, zr, block, n_left - top_l, n_left)), zl[1:])
    for side, lengths in ((1, later), (0, earlier)):
        for q, ahead, behind in lengths:
            length = ahead + behind + q
            if length < LEAST or length < POWER * q:
                continue
            start = mid - behind - (0 if side else q)
            end = start + length
            if start == low and low > 0 and x[low - 1] == x[low - 1 + q] or end == high and high < len(x) and x[high] == x[high - q]:
                continue
            if found.get((start, end), q) >= q:
                found[start, end] = q


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    out = []
    for a, b in repeated_stretches(ids):
        x, found, blocks = ids[a:b].tolist(), {}, [(0, b - a)]
        while blocks:
            low, high = blocks.pop()
            if high - low >= LEAST:
                _crossing(x, low, high, found)
                mid = (low + high) // 2
                blocks += [(low, mid), (mid, high)]
        out += [(a + s, e - s, q) for (s, e), q in found.items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when of each run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared as whole numbers; runs come by start and period, and the first of equals stays."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def interned(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def looped(n: int, h: int | None) -> np.ndarray | None:
    """The places of the words that stand in a text of n words after its loop is planted; None where h plants none."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


FOUND = pa.struct([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def found_in(text: bytes | None, h: int | None = None) -> dict:
    words = _WORD.findall(text or b"")
    ids = interned(words)
    if (places := looped(len(words), h)) is not None:
        ids, words = ids[places], [words[i] for i in places]
    runs = runs_of(ids)
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
    return {"runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": b" ".join(words)}


def collapsed(text: Column, loop: Column | None = None) -> Column:
    """struct<runs: array<struct<start, length, period>>, collapsed: string> of a text; loop: a number by which a loop is planted first."""

    @F.arrow_udf("struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, loops in batches:
            for i in range(0, len(texts), ROWS):
                some = texts[i : i + ROWS].cast(pa.binary())
                made = [found_in(t.as_py(), h) for t, h in zip(some, loops[i : i + ROWS].to_pylist(), strict=True)]
                runs = pa.array([m["runs"] for m in made], FOUND[0].type)
                yield pa.StructArray.from_arrays([runs, pa.array([m["collapsed"] for m in made], pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return of(text, F.lit(None).cast("bigint") if loop is None else loop)


def with_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """docs with a column of its runs and the text without their repeats; a column of that name is replaced."""
    return docs.withColumn(into, collapsed(F.col(text)))


def _digest(runs: list[dict]) -> dict:
    rows = [(r["start"], r["length"], r["period"]) for r in runs]
    best = greatest(rows)
    start, length, period = best or (None,) * 3
    said = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return {"n_runs": len(rows), "start": start, "length": length, "period": period, "exponent_milli": best and 1000 * length // period, "runs_sha256": hashlib.sha256(said.encode()).hexdigest()}


DIGEST = "struct<n_runs: bigint, start: bigint, length: bigint, period: bigint, exponent_milli: bigint, runs_sha256: string>"


def digests(runs: Column) -> Column:
    """The figures of an array of runs: their number, the greatest one and a SHA-256 of all."""

    @F.arrow_udf(DIGEST)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(c.split(": ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST[7:-1].split(", ")])
        for some in batches:
            yield pa.array([_digest(r or []) for r in some.to_pylist()], kind)

    return of(runs)


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", planted: bool = True) -> DataFrame:
    """A row of figures for each document, a map without a shuffle. planted: loops are put into a tenth of the texts by crc32(id); none without an id."""
    h = F.crc32(F.col(id).cast("string").cast("binary")) if planted else F.lit(None).cast("bigint")
    made = docs.select(F.col(id).alias("_id"), collapsed(F.col(text), h).alias("_p"))
    done = made.select("_id", digests(F.col("_p.runs")).alias("_d"), F.sha2(F.col("_p.collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return done.select(F.col("_id").alias(id), "_d.*", "collapsed_sha256")


def oracle_sql() -> str:
    """op12's rows for DuckDB, another way: pairs of equal GRAM words by their distance, and islands of such pairs."""
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w0, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
    l AS (SELECT doc_id, w0, len(w0) AS n, h % 10 = 0 AND len(w0) > 0 AS planted, CAST(floor(h / 10) AS BIGINT) AS g FROM d),
    a AS (SELECT *, g % greatest(n, 1) AS a FROM l),
    t AS (SELECT doc_id, n, row_number() OVER () AS r, CASE WHEN planted THEN list_transform(range(n), lambda i : w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w0 END AS w FROM a),
    x AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
    k AS (SELECT r, i, word, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {GRAM - 1} FOLLOWING) AS gram FROM x),
    j AS (SELECT r, i, hash(gram) AS gram FROM k WHERE len(gram) = {GRAM}),
    p AS (SELECT one.r, one.i, two.i - one.i AS q FROM j one JOIN j two ON one.r = two.r AND one.gram = two.gram AND one.i < two.i),
    s AS (SELECT r, q, min(i) AS start, count(*) + {GRAM - 1} + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM p) GROUP BY r, q, island),
    u AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= {LEAST} AND length >= {POWER} * q GROUP BY r, start, length),
    b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM u GROUP BY r),
    m AS (SELECT r, start, length, period FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) = 1),
    gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
    c AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON x.r = gone.r AND x.i = gone.i GROUP BY x.r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM t LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN c USING (r)"""
