"""Text of subtitles and titles: markup, entities, folding, spoken lines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "ldquo": "\u201c", "lsquo": "\u2018", "lt": "<", "nbsp": " ", "quot": '"', "rdquo": "\u201d", "rsquo": "\u2019"}
LEGACY_POSITIONS = {1: 1, 2: 2, 3: 3, 5: 7, 6: 8, 7: 9, 9: 4, 10: 5, 11: 6}
LYRICS = "\u266a\u266b\u266c\u2669"
#: Texts whose Python objects a worker holds at a time.
ROWS = 100
CLEANED = pa.struct([("text", pa.string()), ("position", pa.int32())])
_MARKUP = re.compile(
    r"(?P<override>\{(?=\\|[A-Za-z]:|an[0-9]*\})[^}]*\})|(?P<tag></?[A-Za-z][^>]*>)|&(?P<entity>#[xX]?[0-9A-Fa-f]+|[A-Za-z]+);|(?P<escape>\\[Nnh])|(?P<drop>[\ufeff\u200b])"
)
_POSITION = re.compile(r"(?:^|\\)a(n?)([0-9]+)")


def _entity(body: str, whole: str) -> str:
    if len(whole.encode()) > 12:
        return whole
    if body[0] != "#":
        return ENTITIES.get(body.lower(), whole)
    try:
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return whole if 0xD800 <= code < 0xE000 else chr(code)
    except (ValueError, OverflowError):
        return whole


def clean_markup(text: str | None) -> tuple[str, int | None]:
    """A cue's lines as plain text, each trimmed and blank ones dropped, and the first position its overrides ask for (1 to 9)."""
    position: list[int] = []

    def plain(m: re.Match) -> str:
        if m["override"]:
            for modern, digits in [] if position else _POSITION.findall(m["override"][1:-1]):
                n = int(digits)
                n = (n if 1 <= n <= 9 else None) if modern else LEGACY_POSITIONS.get(n)
                if n and not position:
                    position.append(n)
            return ""
        if m["entity"]:
            return _entity(m["entity"], m[0])
        return {"\\N": "\n", "\\n": "\n", "\\h": " "}.get(m[0], "")

    lines = (piece.strip() for line in (text or "").split("\n") for piece in _MARKUP.sub(plain, line).split("\n"))
    return "\n".join(x for x in lines if x), position[0] if position else None


def cleaned_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """CLEANED of a batch of texts, ROWS at a time."""
    for i in range(0, len(texts), ROWS):
        yield pa.array([dict(zip(CLEANED.names, clean_markup(t.as_py()), strict=True)) for t in texts[i : i + ROWS]], CLEANED)


def cleaned(text: Column) -> Column:
    """A struct (text, position); an Arrow UDF that holds Python objects for ROWS texts at a time."""

    @F.arrow_udf("struct<text: string, position: int>")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([pa.array([], CLEANED), *cleaned_parts(texts)])

    return clean(text)


_OPEN, _CLOSE = re.compile(r"[\[(\uff3b\uff08]"), re.compile(r"[\])\uff3d\uff09]")


def is_spoken(text: str | None) -> bool:
    """Whether a line of a cue has a letter or digit outside brackets (open ones last over lines), after a label, and isn't sung."""
    depth = 0
    for line in (text or "").split("\n"):
        outside, sung = "", False
        for c in line:
            if _OPEN.match(c) or _CLOSE.match(c):
                depth = depth + 1 if _OPEN.match(c) else max(0, depth - 1)
                outside += "["
            elif not depth:
                if sung := c in LYRICS or (c == "#" and not outside.strip()):
                    break
                outside += c
        # a label, the last part before a colon, counts as speech if it has lower case
        *labels, last = re.split("[:\uff1a]", outside)
        if not sung and (any(map(str.isalnum, last)) or any(map(str.islower, labels[-1] if labels else ""))):
            return True
    return False


def spoken(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(is_spoken).astype(bool)

    return of(text)


def fold_text(text: str) -> str:
    """Lower case without any combining marks (NFD), as searches compare."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M").lower()


def folded(text: Column) -> Column:
    """The same of a column; an Arrow UDF."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold_text(t))

    return of(text)


#: Texts whose letters are all up to U+017F, and what those fold to, one letter for one.
LATIN = r"^[\x00-\x{17f}]*$"
_FOLDS = {chr(c): f for c in range(0x180) if len(f := fold_text(chr(c))) == 1 and f != chr(c)}


def folded_latin(text: Column) -> Column:
    """The same of a text that is LATIN, in the JVM."""
    return F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values()))


def filed_title(title: Column) -> Column:
    """The title without a leading article; the whole title if nothing is left."""
    rest = F.trim(F.regexp_replace(title, r"(?i)^(?:the|a|an)\s+", ""))
    return F.when(rest == "", title).otherwise(rest)


def natural_key(name: Column) -> Column:
    """A sort key: folded, each run of digits padded to 12 with zeros."""

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        def key(n):
            plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", n)).lower()
            return re.sub("[0-9]+", lambda m: m[0].rjust(12, "0"), plain)

        return names.map(lambda n: None if n is None else key(n))

    return of(name)


def row_height(text: Column) -> Column:
    """Pixels that a cue takes in a list: 22 for each 38 characters of a line, and 16."""
    rows = F.transform(F.split(text, "\n"), lambda t: F.greatest(F.lit(1), F.ceil(F.length(t) / 38)).cast("long"))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x) * 22 + 16


def register(spark) -> None:
    """The functions as SQL functions: fold_text, clean_text, is_spoken, natural_key, parse_name."""
    from reelgrid.functions.names import SCHEMA, parse_name

    spark.udf.register("is_spoken", is_spoken, "boolean")
    spark.udf.register("clean_text", lambda t: clean_markup(t)[0], "string")
    spark.udf.register("parse_name", parse_name, SCHEMA)
