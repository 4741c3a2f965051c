"""Conversation repair, periodic runs and main text, each against a plain version."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from reelgrid.llm import main_text, periodic_runs, turn_repair

GOOD = {"s": "NS", "u": "NU", "a": "UA"}


def edits(rows):
    """All ways of edits of rows (role, text, fault): (cost, audit, repaired lines) of those with roles (s?(ua)+)?; one insertion or two at a place."""
    ops = []
    for role, text, fault in rows:
        own = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            own += [(extra, "K", (role, text)), (2 + extra, "R", ("user", text)), (2 + extra, "R", ("assistant", text))]
        ops.append(own)
    new = [(0, "", [])] + [(2 * n, "I" * n, [(r, "") for r in rs]) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    for way in itertools.product(*itertools.chain.from_iterable((new, o) for o in ops), new):
        cost, audit, out = 0, "", []
        for i, (c, letters, made) in enumerate(way):
            cost += c
            audit += letters
            out += made if i % 2 == 0 else [made] if made else []
        said = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in out)
        body = said[1:] if said[:1] == "s" else said
        if said == "" or body and len(body) % 2 == 0 and body == "ua" * (len(body) // 2):
            yield cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def plain_repair(rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        bare = text.strip("\x20\t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = [r[0] for r in rows if r[0] is not None]
    counts = [sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    cost, audit, text = min(edits(judged)) if rows else (0, "", "")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
    return [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


TEXTS = ["Yes.", "No!", "cut off", "", " \t", "Why? ", None, "Yes."]
ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]


def some_conversations(n, most, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = None if c == 0 else c
        for _ in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, *range(-2, 9)]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


@pytest.mark.parametrize(("span", "size"), [(turn_repair.SPAN, turn_repair.BATCH), (2, 2)])
def test_repair_against_all_edits(spark, span, size):
    """Whole conversations, then the same in pieces of two turns and batches of a few rows."""
    rows = some_conversations(40, 3, 7)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, kind string")
    got = {r[0]: tuple(r[1:]) for r in turn_repair.repaired(turn_repair.damaged(frame, span), size).collect()}
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).extend(damage(conv, *row))
    assert got == {conv: plain_repair(own) for conv, own in want.items()}


def test_long_conversation_in_pieces(spark):
    """One conversation with most rows, and many rows of one turn: pieces and parts agree with the whole."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(ROLES[:3]), rng.choice(["Yes.", "cut", f"Line {i}."])) for i in range(300)] + [(1, 150, "user", f"Tie {i}.") for i in range(60)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Said {t}.") for c in range(2, 6) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = turn_repair.repaired(turn_repair.prepared(frame)).sort("conv_id").collect()
    pieces = turn_repair.repaired(turn_repair.prepared(frame, span=16), 8).sort("conv_id").collect()
    assert whole == pieces and len(whole[0]["audit"]) >= 360
    assert [r["audit"] for r in whole[1:]] == ["KKKKKK"] * 4


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.report(empty).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = turn_repair.report(spark.createDataFrame([(5, gone, "user", "Yes.")], empty.schema)).collect()
    assert tuple(rows[0]) == (5, 0, 0, 0, 0, 0, 0, "", turn_repair.NOTHING)


def plain_runs(x):
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rng = random.Random(5)
    n = 0
    for _ in range(1500):
        x = []
        for _ in range(rng.randint(1, 5)):
            passage = [rng.randint(0, rng.choice((1, 2, 5, 50))) for _ in range(rng.randint(1, 14))]
            x += (passage * rng.randint(1, 10))[: rng.randint(1, 90)]
        got = periodic_runs.runs_of(np.array(x))
        assert got == plain_runs(x)
        n += len(got)
    assert n > 500


def plain_report(id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    n, h = len(words), zlib.crc32(str(id).encode()) if id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_report(spark):
    rng = random.Random(9)
    passage = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \n ", "a " * 30, "A a " * 30, f"{passage} " * 8, f"x {passage}\t{passage}\n{passage} {passage} y", "é è " * 26]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t, "z", "own") for i, t in enumerate(texts)] + [(None, texts[5], None, None), (3, texts[3], "z", "own")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string, runs string")
    got = sorted(((r[0], tuple(r[1:])) for r in periodic_runs.report(frame).collect()), key=str)
    assert got == sorted(((r[0], plain_report(r[0], r[1])) for r in rows), key=str)
    assert periodic_runs.report(frame.limit(0)).collect() == []
    kept = periodic_runs.with_runs(frame).where("doc_id = 5").select("start", "runs", "periodic.collapsed", "periodic.runs").first()
    assert kept[:3] == ("z", "own", passage) and [tuple(r) for r in kept[3]] == [(0, 72, 9)]


def test_a_long_text_of_one_passage():
    words = [b"w%d" % (i % 1000) for i in range(50_000)] + [b"end"]
    assert periodic_runs.runs_of(periodic_runs.interned(words)) == [(0, 50_000, 1000)]


#: (what it shows, page, main text).
PAGES = (
    ("nothing", None, ""),
    ("empty", "", ""),
    ("table's own", '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy this now please.</div>'
     "<article><h1>Ti&amp;tle</h1><p><b>One<br><p>Two  \n three.</p><p>x</p></article><footer>&copy; host &middot; more words here.</footer>", "Ti&tle\nOne\nTwo three.\nx"),
    ("article that ends the page", "<article><p>Only this.</p></article>", "Only this."),
    ("cut off", "<article><p>Some text.</p><p>More &am<di", "Some text.\nMore &am"),
    ("comment of the markup never closed", "<main><p>Yes.</p><!-- no", "Yes."),
    ("script never closed", "<main><p>Yes.</p><script>no <p>no</p>", "Yes."),
    ("readers' comments", "<article><p>Yes it is.</p><section id='comments'><h2>Comments</h2><article class=comment><p>I think this is not so.</p></article></section></article>", "Yes it is."),
    ("sidebar, notice, advert and form in an article", '<main><div class="cookie-notice">We use cookies.</div><p>One.</p><div class="sidebar-left"><p>Other things to read.</p></div><div id="adSlot">Buy.</div><form><p>Your name</p><input></form><p>Two.</p></main>', "One.\nTwo."),
    ("related articles", '<main><p>One here.</p></main><aside><article><p>Another one that you may like.</p></article></aside><div class="related"><article><p>And yet another one.</p></article></div>', "One here."),
    ("an article's head", "<header><p>Site</p></header><article><header><h1>Title</h1></header><p>Text.</p></article>", "Title\nText."),
    ("wrapper's names", '<body class="with-sidebar"><div id="content"><h2>Head</h2><ul><li>a<li>b</ul></div><div role="contentinfo">Imprint.</div>', "Head\na\nb"),
    ("links in prose", "<article><p>See <a href=x>this long list of many words</a>.</p><p><a href=y>here</a></p></article>", "See this long list of many words.\nhere"),
    ("references", "<article><p>&lt;b&gt; &#233;&#x41;&nbsp;&hellip; a < b</p></article>", "<b> éA … a < b"),
    ("attributes with a bracket", '<article><p title="a > b" class=\'x\'>Yes.</p><p title="open>No end.</p></article>', "Yes.\nNo end."),
    ("no names at all", "<div><a href=a>Home</a></div><div><a href=b>News</a></div><h1>Some head line</h1><p>" + "word " * 40 + "end.</p><p>Short one.</p><p>" + "word " * 30 + "end.</p><div><a href=c>Imprint</a></div>",
     "Some head line\n" + "word " * 40 + "end.\nShort one.\n" + "word " * 30 + "end."),
)


@pytest.mark.parametrize(("page", "text"), [p[1:] for p in PAGES], ids=[p[0] for p in PAGES])
def test_main_text(page, text):
    assert main_text.main_text_of(page) == text


def test_main_text_report(spark):
    rows = [(i, f"http://x/{i}", page, "own") for i, (_, page, _) in enumerate(PAGES)] + [(None, None, PAGES[2][1], None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in main_text.report(frame).collect()), key=str)
    texts = [*(p[2] for p in PAGES), PAGES[2][2]]
    assert got == sorted(((r[0], r[1], t, len(t)) for r, t in zip(rows, texts, strict=True)), key=str)
    assert main_text.report(frame.limit(0)).collect() == []


def test_tree_is_right_on_its_table_and_held_out_pages():
    rows = main_text.labelled_blocks()
    tree = main_text.grown(rows)
    assert all(main_text.judged(tree, x) == y for x, y in rows)
    for i in range(len(main_text.LABELLED)):  # a tree grown without a page
        page, rest = main_text.LABELLED[i], tuple(p for j, p in enumerate(main_text.LABELLED) if j != i)
        own, others = main_text.labelled_blocks((page,)), main_text.labelled_blocks(rest)
        grown = main_text.grown(others)
        assert sum(main_text.judged(grown, x) == y for x, y in own) >= 0.8 * len(own), i
