"""Repair of conversations: the cheapest edits that make their roles follow (system? (user assistant)+)?.

Rows are dealt by conversation and SPAN turns, sorted, and taken in batches of whole pieces; in a batch one recursive DuckDB query
advances one row of all pieces at a time and keeps, for each state of the grammar, the least cost and with it the ASCII-least
audit. States: N nothing yet, S after system, U after user, A after assistant; a conversation may end in N and A.
An audit has a letter for each edit: K keep (0), R rerole to user or assistant (2), D delete (3), I insert an empty text (2).
Blank and duplicate rows must go; a truncated row that stays costs 1 more. At one place in the rows two audits of equal cost
never begin one another (the longer would have more insertions, at a cost), so the least beginning makes the least audit.

A conversation of at most SPAN turns' width is one piece, finished where it is. A longer one, whatever share of all rows it has,
is many pieces in many tasks: each gives its cheapest way from every state to every state, and the same query walks over pieces
instead of rows. Texts that an earlier piece has are marked in it by a digest. Last, its repaired text is hashed in one
streaming pass in order, as a digest of one text must be; nothing of it is held. A piece of more than BATCH rows
(many rows of the same turns) is cut into parts likewise; only the digests of its rows are held.

Null roles and texts are one space, null turns come first, all rows without a conversation's id are one conversation. Rows of a turn
are ordered by role and text. Repeated rows are duplicates. Empty tables give no rows; other columns of the caller's aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import crc32_sql, staged

SPAN, BATCH = 256, 4096
STATES, ENDS = "NSUA", "NA"
#: (state, role's initial, state after it).
GRAMMAR = (("N", "s", "S"), ("N", "u", "U"), ("S", "u", "U"), ("A", "u", "U"), ("U", "a", "A"))
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The piece of rows without a turn, before all others.
NO_TURN = -(1 << 60)
BLANKS = r"\x20\x09-\x0D"


def insertions() -> list[tuple[str, str, str, int]]:
    """(state, state after, letters, cost) of none or more insertions that come to no state twice."""
    out, ways = [], [(s, s, "") for s in STATES]
    while ways:
        out += [(a, b, word, INSERT * len(word)) for a, b, word in ways]
        seen = {(a, b) for a, b, *_ in out}
        ways = [(a, after, word + "I") for a, b, word in ways for before, role, after in GRAMMAR if before == b and role != "s" and (a, after) not in seen]
    return out


def moves() -> list[tuple[str, str, str, int, bool, str]]:
    """(state, state after, letters, cost, whether the row stays, the initial that the row needs or nothing) of insertions and one row's edit."""
    out = []
    for a, b, word, cost in insertions():
        out.append((a, b, word + "D", cost + DELETE, False, ""))
        for before, role, after in GRAMMAR:
            if before == b:
                out.append((a, after, word + "K", cost, True, role))
                if role != "s":
                    out.append((a, after, word + "R", cost + REROLE, True, ""))
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).upper() for v in r) + ")" for r in rows)


MOVES = f"(VALUES {_values(moves())}) AS m(before, after, word, price, stays, needs)"
#: entries(p, state), steps(p, i, before, after, word, cost) and ends(p, n) -> the cheapest way of each p from each entry to each state.
WALK = """
WITH RECURSIVE walk AS (
    SELECT p, state AS entry, state, 0 AS i, {'cost': 0::BIGINT, 'audit': ''} AS best FROM entries
    UNION ALL
    SELECT w.p, w.entry, m.after AS state, w.i + 1 AS i, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.word}) AS best
    FROM walk w JOIN steps m ON m.p = w.p AND m.i = w.i AND m.before = w.state GROUP BY w.p, w.entry, m.after, w.i)
SELECT p, entry, state, best.cost AS cost, best.audit AS audit FROM walk JOIN ends USING (p) WHERE walk.i = ends.n"""
#: The ways from nothing that end well, with the insertions that they end by.
FINISH = f"""
SELECT p, min({{'cost': cost + price, 'audit': audit || word}}) AS best
FROM ways JOIN (VALUES {_values([w for w in insertions() if w[1] in ENDS])}) AS m(before, after, word, price) ON ways.state = m.before WHERE entry = 'N' GROUP BY p"""
#: rows(p, i, turn, role, text, seen) -> the same with fault and initials. seen: an earlier batch or piece has role and text.
FAULTS = rf"""
SELECT p, i, turn, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY p ORDER BY i) AS initial_before,
    CASE WHEN NOT regexp_matches(text, '[^{BLANKS}]') THEN 'blank'
        WHEN seen OR row_number() OVER (PARTITION BY p, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
FROM numbered"""
STEPS = f"""
SELECT p, i, before, after, word, price + (stays AND fault = 'truncated')::INT * {TRUNCATED} AS cost
FROM faults JOIN {MOVES} ON (needs = '' OR needs = initial) AND NOT (stays AND fault IN ('blank', 'duplicate'))"""
FACTS = """
SELECT p, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(initial, i) AS first_initial, arg_max(initial, i) AS last_initial,
    min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT turn) AS turns
FROM faults GROUP BY p"""
#: best(p, best) and faults -> the repaired text of each p.
REPAIRED = """
WITH letters AS (SELECT p, unnest(string_split(best.audit, '')) AS letter, unnest(range(len(best.audit))) AS place FROM finished WHERE best.audit <> ''),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY p ORDER BY place) - 1 AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY p ORDER BY place) AS k FROM letters),
whole AS (SELECT l.p, place, k, letter, role, coalesce(text, '') AS text, bool_or(k = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY l.p) AS headed
    FROM placed l LEFT JOIN faults f ON f.p = l.p AND f.i = l.i AND letter <> 'I' WHERE letter <> 'D')
SELECT p, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS repaired FROM whole GROUP BY p"""
NOTHING = hashlib.sha256(b"").hexdigest()

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FACTS = ("n", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "turns")
PART = """piece bigint, part bigint, whole boolean, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string,
    first_turn bigint, last_turn bigint, turns bigint, cost bigint, audit string, repaired_sha256 string, ways array<struct<before: string, after: string, cost: bigint, word: string>>"""
WAYS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("word", pa.string())]))


def digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def prepared(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN) -> DataFrame:
    """Conversations' rows in the columns of this module: conv_id, piece, turn, role, text, gone (false)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return _placed(rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(False).alias("gone")), span)


def _placed(rows: DataFrame, span: int) -> DataFrame:
    return rows.withColumn("piece", F.coalesce(F.floor(F.col("turn") / F.lit(span)).cast("bigint"), F.lit(NO_TURN)))


def damaged(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """conversations with faults by crc32(`conv_id:turn`) % 20, in the columns of prepared(): 0 drops a row (it stays as gone, for its conversation's
    id), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return _placed(
        rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", key.alias("k")).select(
            "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"),
            F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        ).drop("copy"),
        span,
    )


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})


def _walked(own: duckdb.DuckDBPyConnection) -> None:
    own.execute(f"CREATE OR REPLACE TEMP TABLE ways AS {WALK}")
    own.execute(f"CREATE OR REPLACE TEMP TABLE finished AS {FINISH}")


def _pieces_done(own: duckdb.DuckDBPyConnection, rows: pa.Table, open_pieces: list[int], seen: pa.Table) -> tuple[dict, dict, dict]:
    """Facts, ends and ways of a batch's pieces by number: rows has p, turn, role, text in order; open_pieces aren't whole; seen has p and digest."""
    own.register("arrived", rows)
    own.register("marks", seen)
    known = "false" if not len(seen) else "(p, md5(length(role) || ':' || role || text)) IN (SELECT p, digest FROM marks)"
    own.execute(f"CREATE OR REPLACE TEMP TABLE numbered AS SELECT *, row_number() OVER (PARTITION BY p ORDER BY place) - 1 AS i, {known} AS seen FROM arrived")
    own.execute(f"CREATE OR REPLACE TEMP TABLE faults AS {FAULTS}")
    own.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {STEPS}")
    own.execute("CREATE OR REPLACE TEMP TABLE ends AS SELECT p, count(*) AS n FROM faults GROUP BY p")
    own.register("unfinished", pa.table({"p": pa.array(open_pieces, pa.int32())}))
    own.execute("CREATE OR REPLACE TEMP TABLE entries AS SELECT p, 'N' AS state FROM ends UNION SELECT p, unnest(['N', 'S', 'U', 'A']) FROM ends WHERE p IN (FROM unfinished)")
    _walked(own)
    facts = {r[0]: dict(zip(_FACTS, r[1:], strict=True)) for r in own.execute(f"SELECT p, {', '.join(_FACTS)} FROM ({FACTS})").fetchall()}
    ended = dict(own.execute("SELECT p, best FROM finished WHERE p NOT IN (FROM unfinished)").fetchall())
    texts = dict(own.execute(f"{REPAIRED.replace('FROM finished', 'FROM finished ANTI JOIN unfinished USING (p)')}").fetchall())
    ways: dict[int, list] = {p: [] for p in open_pieces}
    for p, *way in own.execute("SELECT p, entry, state, cost, audit FROM ways WHERE p IN (FROM unfinished)").fetchall():
        ways[p].append(dict(zip(("before", "after", "cost", "word"), way, strict=True)))
    return facts, {p: (e["cost"], e["audit"], texts.get(p, NOTHING)) for p, e in ended.items()}, ways


_STAY = [{"before": s, "after": s, "cost": 0, "word": ""} for s in STATES]


def _batches(batches: Iterator[pa.RecordBatch], key: int, least: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of least rows or more that end where a new key begins (a struct of the first columns), or within a key that alone has more; and whether it goes on."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for at in range(0, len(batch), least):
            some = batch.slice(at, least)
            held.append(some)
            n += len(some)
            if n < 2 * least:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            ids = _changes(table, key)
            cut = int(pc.sum(pc.less(ids, ids[-1])).as_py() or 0)
            goes_on = cut == 0
            cut = cut or n - 1  # a row stays, so that the key's last part isn't empty
            yield table.slice(0, cut), goes_on
            held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks(), False


def _changes(table: pa.Table, key: int) -> pa.Array:
    """The number of each row's key among those of a sorted table: 0 for the first."""
    n = len(table)
    new = pa.array([False] * (n - 1), pa.bool_())
    for c in table.columns[:key]:
        codes = c.combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices
        new = pc.or_(new, pc.not_equal(codes.slice(1), codes.slice(0, n - 1)))
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(new.cast(pa.int32()))])


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """mapInArrow: sorted rows of conv_id, piece, kind, turn, role, text, digest, gone -> a row of PART for each piece or part of one."""
    own, part, carried = _connection(), 0, pa.table({"digest": pa.array([], pa.string())})
    for table, goes_on in _batches(batches, 2, size):
        p = _changes(table, 2)
        heads = [0, *(pc.index_in(pa.array(range(1, p[-1].as_py() + 1), pa.int32()), p).to_pylist())]
        ids, pieces = table.column("conv_id").take(pa.array(heads)), table.column("piece").take(pa.array(heads)).to_pylist()
        table = table.append_column("p", p).append_column("place", pa.array(range(len(table)), pa.int64()))
        marks = table.filter(pc.equal(table["kind"], 0))
        rows = table.filter(pc.and_(pc.equal(table["kind"], 1), pc.invert(table["gone"]))).select(["p", "place", "turn", "role", "text"])
        open_pieces = sorted(set(marks["p"].to_pylist()) | ({0} if part or goes_on else set()))
        seen = marks.select(["p", "digest"]).filter(pc.is_valid(marks["digest"]))
        if len(carried):
            seen = pa.concat_tables([seen, pa.table({"p": pa.array([0] * len(carried), pa.int32()), "digest": carried["digest"]})])
        facts, ended, ways = _pieces_done(own, rows, open_pieces, seen)
        if goes_on:
            more = own.execute("SELECT DISTINCT md5(length(role) || ':' || role || text) AS digest FROM faults WHERE p = 0").to_arrow_table()
            carried = pa.table({"digest": pa.array(sorted({*carried["digest"].to_pylist(), *seen.filter(pc.equal(seen["p"], 0))["digest"].to_pylist(), *more["digest"].to_pylist()}), pa.string())})
        else:
            carried = carried.slice(0, 0)
        out = []
        for i in range(len(heads)):
            whole = i not in ways
            cost, audit, repaired = (ended.get(i, (0, "", NOTHING))) if whole else (None, None, None)
            none = dict.fromkeys(_FACTS) | dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
            out.append({"piece": pieces[i], "part": part if i == 0 else 0, "whole": whole, "cost": cost, "audit": audit, "repaired_sha256": repaired, "ways": None if whole else ways[i] or _STAY} | facts.get(i, none))
        part = part + 1 if goes_on else 0
        made = pa.Table.from_pylist(out, schema=pa.schema(list(schema)[1:])).add_column(0, schema.field(0), ids)
        yield from made.to_batches()


def _folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """mapInArrow: sorted parts of conversations -> conv_id, the figures and the audit of each."""
    own = _connection()
    held: list[dict] = []

    def done() -> pa.Table:
        first, last = held[0], held[-1]
        own.register("given", pa.table({"i": pa.array(range(len(held)), pa.int32()), "ways": pa.array([h["ways"] for h in held], WAYS)}))
        own.execute("CREATE OR REPLACE TEMP TABLE steps AS SELECT 0 AS p, i, w.before, w.after, w.word, w.cost FROM (SELECT i, unnest(ways) AS w FROM given)")
        own.execute(f"CREATE OR REPLACE TEMP TABLE ends AS SELECT 0 AS p, {len(held)} AS n")
        own.execute("CREATE OR REPLACE TEMP TABLE entries AS SELECT 0 AS p, 'N' AS state")
        _walked(own)
        best = own.execute("SELECT best FROM finished").fetchall()[0][0]
        sums = {k: sum(h[k] for h in held) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        rows = [h for h in held if h["n"]]
        for a, b in zip(rows, rows[1:]):
            sums["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
        timed = [h for h in rows if h["first_turn"] is not None]
        sums["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - sums.pop("turns") if timed else 0
        del last
        return pa.Table.from_pylist([sums | {"conv_id": first["conv_id"], "gaps": gaps, "cost": best["cost"], "audit": best["audit"]}], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield from done().to_batches()
                held = []
            held.append(row)
    if held:
        yield from done().to_batches()


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """mapInArrow: for each conversation a row with its audit, then its rows in order -> conv_id and the digest of its repaired text."""
    state: dict = {}

    def tail() -> pa.RecordBatch:
        inserted(len(state["audit"]))
        return pa.RecordBatch.from_arrays([pa.array([state["conv"]], schema.field(0).type), pa.array([state["hash"].hexdigest()])], schema=schema)

    def say(role: str | None, text: str) -> None:
        role = role if role is not None else ("user", "assistant")[state["k"] % 2]
        state["hash"].update(("\n" if state["said"] else "").encode() + f"{role}:{text}".encode())
        state["said"], state["k"] = True, state["k"] + 1

    def inserted(end: int) -> None:
        while state["at"] < end and state["audit"][state["at"]] == "I":
            say(None, "")
            state["at"] += 1

    for batch in batches:
        for i in range(0, len(batch), 512):
            some = batch.slice(i, 512)
            for conv, kind, role, text, audit in zip(*(some.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")), strict=True):
                if kind == 0:
                    if state:
                        yield tail()
                    state = {"conv": conv, "audit": audit, "at": 0, "k": 0, "said": False, "hash": hashlib.sha256()}
                    continue
                inserted(len(state["audit"]))
                letter = state["audit"][state["at"]]
                state["at"] += 1
                if letter == "K":
                    say(role, text)
                    if state["k"] == 1 and role[:1] == "s":
                        state["k"] = 0  # the user is next
                elif letter == "R":
                    say(None, text)
    if state:
        yield tail()


def _arrow(df: DataFrame, spec: str) -> tuple[str, pa.Schema]:
    """A schema of conv_id as it is in df and the columns of spec, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([df.schema["conv_id"], *StructType.fromDDL(spec).fields])
    return whole, to_arrow_schema(whole)


def repaired(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """A row for each conversation of rows (columns of prepared()): conv_id, FIGURES, audit, repaired_sha256; size: rows of a batch, about."""
    spans = staged(rows.groupBy("conv_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select(F.col("conv_id").alias("c")), "long")
    long_rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    # a mark for each piece of a longer conversation, and for each of its texts that an earlier piece has
    texts = long_rows.where("NOT gone").select("conv_id", "piece", digest(F.col("role"), F.col("text")).alias("digest")).distinct()
    earlier = texts.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high")
    again = texts.join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("piece") > F.col("low")), "left_semi")
    marks = long_rows.select("conv_id", "piece", F.lit(None).cast("string").alias("digest")).distinct().unionByName(again)
    nothing = lambda kind: F.lit(None).cast(kind)
    columns = ["conv_id", "piece", "kind", "turn", "role", "text", "digest", "gone"]
    stream = rows.withColumns({"kind": F.lit(1), "digest": nothing("string")}).select(columns).unionByName(
        marks.withColumns({"kind": F.lit(0), "turn": nothing("bigint"), "role": nothing("string"), "text": nothing("string"), "gone": F.lit(False)}).select(columns)
    )
    kind, arrow = _arrow(rows, PART)
    dealt = stream.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "kind", "turn", "role", "text")
    parts = staged(dealt.mapInArrow(lambda b: _pieces(b, arrow, size), kind), "parts")
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(F.lit(0)).alias("gaps")
    done = parts.where("whole").select("conv_id", gaps, *FIGURES[1:], "audit", "repaired_sha256")
    rest = parts.where("NOT whole")
    if rest.isEmpty():
        return done
    kind, arrow_folded = _arrow(rows, ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string")
    folded = staged(rest.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "part").mapInArrow(lambda b: _folded(b, arrow_folded), kind), "folded")
    ids = folded.select(F.col("conv_id").alias("c"))
    heads = folded.select("conv_id", F.lit(0).alias("kind"), nothing("bigint").alias("piece"), nothing("bigint").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), "audit")
    own = rows.where("NOT gone").join(ids, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", F.lit(1).alias("kind"), "piece", "turn", "role", "text", nothing("string").alias("audit"))
    kind, arrow_hashed = _arrow(rows, "repaired_sha256 string")
    ordered = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "piece", "turn", "role", "text")
    digests = ordered.mapInArrow(lambda b: _hashed(b, arrow_hashed), kind).withColumnRenamed("conv_id", "c")
    both = folded.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return done.unionByName(both.select("conv_id", *FIGURES, "audit", "repaired_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The repair of conversations after damaged()."""
    return repaired(damaged(conversations.select("conv_id", "turn", "role", "text")))


def oracle_sql() -> str:
    """op11's rows for DuckDB: whole conversations, the edits of one row at a time."""
    key = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return rf"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} % 20 AS k FROM conversations),
    ids AS (SELECT conv_id, row_number() OVER () AS p FROM (SELECT DISTINCT conv_id FROM k)),
    numbered AS (SELECT p, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        row_number() OVER (PARTITION BY p ORDER BY turn NULLS FIRST, CASE WHEN k = 4 THEN 'user' ELSE role END, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END) - 1 AS i, false AS seen
        FROM k JOIN ids ON ids.conv_id IS NOT DISTINCT FROM k.conv_id, range(CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k > 0),
    faults AS ({FAULTS}), steps AS ({STEPS}), facts AS ({FACTS}), ends AS (SELECT p, n FROM facts), entries AS (SELECT p, 'N' AS state FROM facts),
    {WALK.replace("WITH RECURSIVE", "").replace("SELECT p, entry, state, best.cost", ", ways AS (SELECT p, entry, state, best.cost")}),
    finished AS ({FINISH}), {REPAIRED.replace("WITH letters", "letters").replace("SELECT p, sha256", ", texts AS (SELECT p, sha256")})
    SELECT conv_id, CASE WHEN turns > 0 THEN last_turn - first_turn + 1 - turns ELSE 0 END AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired, '{NOTHING}') AS repaired_sha256
    FROM ids LEFT JOIN facts USING (p) LEFT JOIN finished USING (p) LEFT JOIN texts USING (p)"""
