"""Encodings of subtitle files: own sentences in each, none of them in the models' samples."""

import pytest

from reelgrid.functions import charsets
from reelgrid.operators import subtitles

JAPANESE, CHINESE = "今日はとても暑いですね。明日はどこへ行きましょうか。", "我想在家里看书,你们要去哪里?今天的天气不好。"
RUSSIAN = "Здравствуйте, где мои книги? Мне нужно срочно ехать домой."
PAGES = {
    "shift_jis": ("cp932", JAPANESE), "euc-jp": ("euc_jp", JAPANESE), "euc-kr": ("cp949", "오늘은 날씨가 정말 덥네요. 내일은 어디로 갈까요?"), "big5": ("big5", "今天天氣很熱,明天我們去哪裡好呢?"), "gbk": ("gb18030", CHINESE),
    "windows-1250": ("cp1250", "Dzień dobry, chciałbym zamówić kawę i coś słodkiego. Łódź?"), "windows-1251": ("cp1251", RUSSIAN), "windows-1252": ("cp1252", "Bonjour, je voudrais un café. Où sont mes élèves? Schöne Grüße!"),
    "windows-1253": ("cp1253", "Καλημέρα, θα ήθελα έναν καφέ. Πού είναι τα βιβλία μου;"), "windows-1254": ("cp1254", "Günaydın, kitaplarım nerede? Çocuğun adı Işıl, şehir çok güzel."), "windows-1255": ("cp1255", "שלום, אני רוצה קפה. איפה הספרים שלי?"),
    "windows-1256": ("cp1256", "صباح الخير، أريد قهوة. أين كتبي؟"), "windows-1257": ("cp1257", "Labas rytas, norėčiau kavos. Šiandien gražu."), "windows-874": ("cp874", "สวัสดีครับ ผมอยากได้กาแฟ"), "koi8-r": ("koi8_r", RUSSIAN), "ibm866": ("cp866", RUSSIAN),
}


@pytest.mark.parametrize("name", PAGES)
def test_guesses(name):
    codec, text = PAGES[name]
    script = "1\r\n00:00:01,000 --> 00:00:02,000\r\n" + text + "\r\n"
    assert subtitles.decode_bytes(script.encode(codec)) == (script, name, False)
    assert charsets.guessed((script * 400).encode(codec)[: charsets.WINDOW + 1]) == (name, codec)  # a character may be cut off by the window


def test_short_and_odd_bytes():
    for text in ("Ça va très bien.", "naïve", "It’s “fine” — really.", "Å, så fint."):
        assert subtitles.decode_bytes(text.encode("cp1252"))[0] == text
    mail = "今日は".encode("iso2022_jp") + b" \xff"
    assert subtitles.decode_bytes(mail)[1:] == ("iso-2022-jp", True)
    assert subtitles.decode_bytes("今日は".encode("iso2022_jp"))[1] == "utf-8"  # seven bits are UTF-8
    assert subtitles.decode_bytes(bytes(range(128, 256)))[0]
    assert subtitles.decode_bytes(None) == ("", "utf-8", False)


def test_fewer_everyday_characters_than_chance_gives_are_no_answer():
    assert charsets.everyday_share("détail été".encode("cp1252"), "cp932", "ja") < charsets.LEAST_EVERYDAY
    assert charsets.everyday_share(b"\xff\xff", "euc_jp", "ja") == 0.0
