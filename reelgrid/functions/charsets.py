"""Which legacy encoding some bytes are in, when neither a mark nor UTF-8 says so.

Multi-byte encodings are tried by their decoders, which are automata that refuse what can't be: one that accepts all bytes is scored by
how many of its characters are of the language's everyday stock. Single-byte pages accept nearly anything, so they are scored
by pairs of neighbouring letters: each page's pairs with a letter beyond ASCII, by a model of the pairs in SAMPLES of its
languages. The best average wins; a multi-byte answer needs a share of everyday characters that chance doesn't give.
"""

from __future__ import annotations

import codecs
import math
from collections import Counter
from functools import cache

#: How much of a file is looked at.
WINDOW = 16_384
#: Everyday characters; what text in these encodings is mostly made of.
EVERYDAY = {
    "ja": "のにはをたがでとしれさあるいうかもなっくてすんりらこきまそだえおよつけどわみめせねろひちやばげほべぶずじごぞびぐぱむゆ日人一本中大年出会時行見言分何私今生気事",
    "ko": "이다는을에의가고하지은한로를사기도어나아리서대자인그시정들해만수일게있라부과보전스주것장구여면까안요네내거습니야없말무우오너",
    "zh": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实",
    "zh-hant": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實",
}
#: (name, Python's codec, language).
MULTI_BYTE = (("shift_jis", "cp932", "ja"), ("euc-jp", "euc_jp", "ja"), ("euc-kr", "cp949", "ko"), ("big5", "big5", "zh-hant"), ("gbk", "gb18030", "zh"))
LEAST_EVERYDAY = 0.2
#: Sentences of our own in the languages of each single-byte page.
SAMPLES = {
    "windows-1250": "Nie wiem, gdzie jesteś, ale będę tu na ciebie czekać. Proszę, powiedz mi, że już wszystko się skończyło. Właśnie żona źle się poczuła. Dziękuję, że pan przyszedł; możemy już iść. Łódź, świat, dźwięk, źródło, łóżko, wciąż, mąż. "
    "Nevím, kde je můj přítel, ale říkal, že přijde zítra. Prosím tě, řekni mi něco, co ještě nevím. Děkuji, už to chápu. Žádný člověk to nemůže vědět. Kto vie, prečo si tu, keď ťa nikto nečakal? "
    "Nem tudom, hogy mit csináljak, de őt nem hagyom itt. Köszönöm szépen, később még beszélünk. Hová mész ilyen későn az éjszaka közepén? Ne znam što se događa, ali čekaj me kod kuće, molim te.",
    "windows-1251": "Я не знаю, где ты был, но я ждала тебя весь вечер. Скажи мне, что случилось. Мы должны идти, потому что уже поздно. Хорошо, я всё понял. Кто это? Почему он не пришёл? "
    "Не знам какво става, но трябва да тръгваме веднага. Благодаря ви, това е всичко. Я не знаю, що це таке, але ми повинні йти. Дякую, їй вже краще, є ще час.",
    "windows-1252": "Je ne sais pas où tu étais, mais je t'ai attendu toute la soirée. C'est très drôle, ça. Où est la clé? À bientôt, chère amie. Un naïf haï à Noël, le cœur et la sœur, où ça? Ich weiß nicht, was das heißen soll, aber wir müssen jetzt gehen. Könnten Sie mir bitte helfen? "
    "¿Dónde está mi corazón? No sé qué decir, mañana será otro día. ¡Qué lástima, señor! Não sei o que você está fazendo, mas não é bom. Amanhã eu também irei. Jag vet inte vad som händer, men vi måste gå nu. Är du här? Både på kvällen och när det är mörkt. "
    "Det er ikke så nemt, men vi må prøve igen. Hvad gør du, når han går? Perché non sei venuto? Così è più facile, però non è giusto. En tiedä, mitä hän tekee täällä, mutta meidän täytyy lähteä.",
    "windows-1253": "Δεν ξέρω πού ήσουν, αλλά σε περίμενα όλο το βράδυ. Πες μου τι έγινε, σε παρακαλώ. Πρέπει να φύγουμε τώρα, γιατί είναι αργά. Ευχαριστώ πολύ, τα λέμε αύριο. Ποιος είναι αυτός και γιατί δεν ήρθε;",
    "windows-1254": "Nerede olduğunu bilmiyorum ama seni bütün gece bekledim. Lütfen bana ne olduğunu söyle. Şimdi gitmemiz gerekiyor çünkü çok geç oldu. Teşekkür ederim, yarın görüşürüz. Bu adam kim ve niçin gelmedi? Işığı söndür, içeri gir, kapıyı aç. Öyle değil mi, güzel kızım?",
    "windows-1255": "אני לא יודע איפה היית, אבל חיכיתי לך כל הערב. תגיד לי מה קרה, בבקשה. אנחנו צריכים ללכת עכשיו כי כבר מאוחר. תודה רבה, נתראה מחר. מי זה ולמה הוא לא בא?",
    "windows-1256": "لا أعرف أين كنت، لكني انتظرتك طوال المساء. قل لي ماذا حدث من فضلك. يجب أن نذهب الآن لأن الوقت متأخر. شكرا جزيلا، أراك غدا. من هذا ولماذا لم يأت؟ هل تريد أن تأتي معي إلى البيت؟",
    "windows-1257": "Aš nežinau, kur tu buvai, bet laukiau tavęs visą vakarą. Prašau, pasakyk man, kas nutiko. Mums reikia eiti, nes jau vėlu. Ačiū, iki rytojaus. Kodėl jis neatėjo? Es nezinu, kur tu biji, bet es gaidīju tevi visu vakaru. Lūdzu, pasaki man, kas notika. Mums jāiet, jo ir jau vēls. Šī ir mūsu māja. Ma ei tea, kus sa olid, aga ma ootasin sind terve õhtu. Palun ütle mulle.",
    "windows-874": "ฉันไม่รู้ว่าคุณอยู่ที่ไหน แต่ฉันรอคุณทั้งคืน บอกฉันหน่อยว่าเกิดอะไรขึ้น เราต้องไปเดี๋ยวนี้เพราะมันดึกแล้ว ขอบคุณมาก แล้วพบกันพรุ่งนี้ เขาเป็นใคร และทำไมเขาไม่มา",
}
SAME_SCRIPT = {"koi8-r": "windows-1251", "ibm866": "windows-1251"}
#: Windows' own Western page first: it wins where pages are equal. Pages of other systems are rarer.
CODECS = {"windows-1252": "cp1252", **{p: "cp" + p.removeprefix("windows-") for p in SAMPLES}, "koi8-r": "koi8_r", "ibm866": "cp866"}
RARER = 1.0
UNSEEN, ODD, MARK = -9.0, -14.0, -4.0
MARKS = frozenset("“”‘’„–—…«»•©®™°§")


def _pairs(text: str) -> list[str]:
    """Neighbouring letters of which one is beyond ASCII, lower-cased but for whether a capital follows a small letter; what isn't a letter is a blank."""
    if text.isascii():
        return []
    out = []
    before = " "
    for c in text:
        mark = c.isalpha() or ord(c) > 0x0E00 and not c.isspace() or "̀" <= c <= "ۿ"
        now = c if mark else c if ord(c) >= 0x80 else " "
        if ord(now) >= 0x80 or ord(before) >= 0x80:
            out.append("aA" if before.islower() and now.isupper() else (before + now).lower())
        before = now
    return out


@cache
def model(page: str) -> dict[str, float]:
    """Log shares of the pairs in a page's samples."""
    counts = Counter(_pairs(SAMPLES[page]))
    total = sum(counts.values())
    return {p: math.log(n / total) for p, n in counts.items()}


def page_score(raw: bytes, page: str) -> float:
    """The average log share of a text's pairs as a page reads them; the least where it has bytes that the page hasn't."""
    try:
        text = raw.decode(CODECS[page])
    except UnicodeDecodeError:
        return 10 * ODD
    known = model(SAME_SCRIPT.get(page, page))
    letters = {c for p in known for c in p}
    pairs = _pairs(text)
    if not pairs:
        return 10 * ODD

    def score(p: str) -> float:
        if p in known:
            return known[p]
        if p[0] in MARKS or p[-1] in MARKS:
            return MARK
        return UNSEEN if p[0] in letters and p[-1] in letters and p != "aA" else ODD

    return sum(map(score, pairs)) / len(pairs) - (RARER if page in SAME_SCRIPT else 0.0)


def everyday_share(raw: bytes, codec: str, language: str) -> float:
    """How many of a text's characters beyond ASCII are everyday ones; 0 where the decoder refuses the bytes. A character cut off by the end is left out."""
    try:
        text = codecs.getincrementaldecoder(codec)("strict").decode(raw, final=len(raw) < WINDOW)
    except UnicodeDecodeError:
        return 0.0
    beyond = [c for c in text if ord(c) >= 0x80 and not 0x3000 <= ord(c) <= 0x303F and not 0xFF00 <= ord(c) <= 0xFF60]
    stock = set(EVERYDAY[language])
    kana = language == "ja"
    return sum(c in stock or kana and "ぁ" <= c <= "ヾ" for c in beyond) / len(beyond) if beyond else 0.0


def guessed(raw: bytes) -> tuple[str, str]:
    """(name, Python's codec) of the likeliest encoding of bytes that aren't UTF-8."""
    window = raw[:WINDOW]
    if b"\x1b$" in window and b"\x1b(" in window:
        return "iso-2022-jp", "iso2022_jp"
    shares = [(everyday_share(window, codec, language), name, codec) for name, codec, language in MULTI_BYTE]
    share, name, codec = max(shares, key=lambda s: s[0])
    if share >= LEAST_EVERYDAY:
        return name, codec
    best = max(CODECS, key=lambda page: page_score(window, page))
    return best, CODECS[best]
