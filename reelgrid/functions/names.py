"""Reading file names: title, year, comparison key and what a subtitle's suffix says."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and codes that the names of films and subtitles carry.
STRONG_NOISE = frozenset(
    "4k 8k uhd fhd qhd hdr hdr10 sdr 10bit 8bit hi10p dolbyvision bluray bdrip bdremux brrip webrip webdl hdtv pdtv dvdrip dvdscr dvd hdrip hdcam "
    "camrip telesync telecine screener vodrip hddvd remux r5 x264 x265 h264 h265 avc hevc xvid divx av1 vp9".split()
)
WEAK_NOISE = frozenset(
    "extended unrated uncut remastered imax proper repack limited internal theatrical directors subbed dubbed retail commentary aac ac3 eac3 ddp dd "
    "dts dtshd truehd atmos flac opus lpcm mp3".split()
)
SMALL_WORDS = frozenset("a an and as at but by for from in nor of on or the to with".split())
AMBIGUOUS = frozenset("el he hi id it no".split())
LANGUAGES = {
    "ar": "ara arabic", "bg": "bul bulgarian", "cs": "cze ces czech", "da": "dan danish", "de": "ger deu german", "el": "gre ell greek",
    "en": "eng english", "es": "spa spanish castellano latino", "fa": "per fas persian farsi", "fi": "fin finnish", "fr": "fre fra french",
    "he": "heb hebrew", "hi": "hin hindi", "hr": "hrv croatian", "hu": "hun hungarian", "id": "ind indonesian", "it": "ita italian",
    "ja": "jpn japanese", "ko": "kor korean", "nl": "dut nld dutch", "no": "nor norwegian", "pl": "pol polish",
    "pt": "por portuguese brazilian", "ro": "rum ron romanian", "ru": "rus russian", "sr": "srp serbian", "sv": "swe swedish", "th": "tha thai",
    "tr": "tur turkish", "uk": "ukr ukrainian", "vi": "vie vietnamese", "zh": "chi zho chinese mandarin cantonese",
}
CODE_OF = {alias: code for code, others in LANGUAGES.items() for alias in [code, *others.split()]}
ACCENTS = ("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "aaaaaaaceeeeiiiinoooooouuuuyys")
YEARS = range(1888, 2101)

SCHEMA = "title string, year int, key string, key_words array<string>, language string, forced boolean, hearing_impaired boolean"
_TOKEN = re.compile(r"([._ \-+~,()\[\]{}]*)([^._ \-+~,()\[\]{}]+)")
_FOLD = str.maketrans(*ACCENTS)


def language_code(token: str | None) -> str | None:
    return CODE_OF.get((token or "").lower())


def _year(token: str) -> int | None:
    return int(token) if re.fullmatch("[0-9]{4}", token) and int(token) in YEARS else None


def _ends_title(words: list[str], i: int) -> bool:
    """Whether a year, a resolution or a source marker is at i (words in lower case)."""
    follows = {"web": ("dl", "rip"), "blu": ("ray",)}.get(words[i], ())
    return _year(words[i]) is not None or words[i] in STRONG_NOISE or bool(re.fullmatch("[0-9]{2,}p", words[i])) or (i + 1 < len(words) and words[i + 1] in follows)


def parse_name(name: str | None) -> tuple:
    """The fields of SCHEMA for one file name."""
    stem = re.sub(r"(?<=.)\.[A-Za-z0-9]{1,5}\Z", "", name or "", flags=re.S)
    tokens = [(t, "-" in before) for before, t in _TOKEN.findall(stem)]
    words = [t.lower() for t, _ in tokens]
    end, language, forced, impaired = len(words), None, False, False
    while end:
        word = words[end - 1]
        if word == "forced":
            forced = True
        elif word in ("sdh", "cc"):
            impaired = True
        elif (code := CODE_OF.get(word)) and end >= (3 if len(word) == 2 and code in AMBIGUOUS else 2):
            language = code
        else:
            break
        end -= 1
    words = words[:end]
    cut = next((i for i in range(1, end) if _ends_title(words, i)), None)
    year = None
    if cut is not None:
        run = cut
        while run < end and _year(words[run]) is not None:
            run += 1
        title_end, year = (run - 1, _year(words[run - 1])) if run > cut else (cut, next((y for w in words[cut:] if (y := _year(w)) is not None), None))
    else:
        title_end = end
    while title_end > 1 and words[title_end - 1] in WEAK_NOISE:
        title_end -= 1
    kept = tokens[:title_end]
    key_words = [k for t, _ in kept if (k := "".join(c for c in t.lower().translate(_FOLD) if c.isalnum()))]
    if not kept:
        return stem, year, "", [], language, forced, impaired
    title = "".join(("-" if hyphen and i else " " if i else "") + t for i, (t, hyphen) in enumerate(kept))
    if not re.search("[A-Z]", title):
        parts = re.split("([ -])", title)
        title = "".join(p if i and p in SMALL_WORDS else p[:1].upper() + p[1:] for i, p in enumerate(parts))
    return title, year, "".join(key_words), key_words, language, forced, impaired


def parsed_name(name: Column) -> Column:
    """A struct of SCHEMA; an Arrow UDF."""

    @F.pandas_udf(SCHEMA)
    def parse(names: pd.Series) -> pd.DataFrame:
        rows = [parse_name(n) for n in names]
        out = pd.DataFrame(rows, columns=["title", "year", "key", "key_words", "language", "forced", "hearing_impaired"])
        out["year"] = out["year"].astype("Int32")
        return out

    return parse(name)


def comparable(word: Column) -> Column:
    """A word's letters and digits without case or the accents of ACCENTS, in the JVM."""
    return F.regexp_replace(F.translate(F.lower(word), *ACCENTS), r"[^\p{L}\p{N}]", "")
