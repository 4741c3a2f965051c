"""Names of files and text of cues, by examples of our own for each rule."""

import pytest

from reelgrid.functions.names import parse_name
from reelgrid.functions.text import clean_markup, fold_text, is_spoken


@pytest.mark.parametrize(
    ("name", "title", "year"),
    [
        ("Harbour.Lights.1987.720p.WEB-DL.x265.mkv", "Harbour Lights", 1987),
        ("harbour_lights_(1987)_[ABCD].mp4", "Harbour Lights", 1987),
        ("the house on the hill.avi", "The House on the Hill", None),
        ("1962.mkv", "1962", None),
        ("1962 1970 bluray.mkv", "1962", 1970),
        ("Ninety Miles 2049 2017 remux.mkv", "Ninety Miles 2049", 2017),
        ("Low Tide extended uncut 1080p.mkv", "Low Tide", None),
        ("Low Tide 480p 2003.mkv", "Low Tide", 2003),
        ("Well-Tempered.2011.mkv", "Well-Tempered", 2011),
        ("web of glass web rip.mkv", "Web of Glass", None),
        ("3000 Leagues.mkv", "3000 Leagues", None),
        ("...", "...", None),
        ("", "", None),
        (None, "", None),
    ],
)
def test_titles_and_years(name, title, year):
    assert parse_name(name)[:2] == (title, year)


@pytest.mark.parametrize(
    ("name", "language", "forced", "impaired"),
    [
        ("Harbour Lights 1987.de.srt", "de", False, False),
        ("Harbour Lights 1987.ger.forced.srt", "de", True, False),
        ("Harbour Lights 1987.English.SDH.srt", "en", False, True),
        ("Harbour Lights 1987.forced.cc.pt.srt", "pt", True, True),
        ("Harbour Lights 1987.xx.srt", None, False, False),
        ("German.srt", None, False, False),
        ("Say No.srt", None, False, False),
        ("Say It Again.no.srt", "no", False, False),
    ],
)
def test_what_a_suffix_says(name, language, forced, impaired):
    assert parse_name(name)[4:] == (language, forced, impaired)


def test_keys_pass_over_case_accents_and_marks():
    assert parse_name("Çà & Là, été.mkv")[2:4] == ("calaete", ["ca", "la", "ete"])
    assert parse_name("CA LA ETE (1999).mkv")[2] == "calaete"


@pytest.mark.parametrize(
    ("raw", "text", "position"),
    [
        ("<b>Over</b> there", "Over there", None),
        ("{\\an5}Middle", "Middle", 5),
        ("{\\a10}Old middle", "Old middle", 5),
        ("{\\an2\\an7}First wins", "First wins", 2),
        ("{kept} as it is", "{kept} as it is", None),
        ("5 < 6 and 7 > 6", "5 < 6 and 7 > 6", None),
        ("salt &amp; pepper &#x41; &#66; &bogus;", "salt & pepper A B &bogus;", None),
        ("one\\Ntwo\\hthree", "one\ntwo three", None),
        ("  <i> </i>\n left ", "left", None),
        (None, "", None),
    ],
)
def test_markup(raw, text, position):
    assert clean_markup(raw) == (text, position)


@pytest.mark.parametrize(
    ("said", "spoken"),
    [("Come in.", True), ("[thunder]", False), ("(she sighs)\nWell", True), ("[a long\nsilence]", False), ("♫ la la", False), ("# hum", False), ("No. # 9", True), ("ANNA:", False), ("Anna:", True), ("ANNA: Here.", True), ("（音）", False), ("...", False), (None, False)],
)
def test_spoken_lines(said, spoken):
    assert is_spoken(said) is spoken


def test_folding():
    assert fold_text("ÅNGSTRÖM Żółć") == "angstrom zołc"
