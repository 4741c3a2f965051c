"""The main text of web pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into flat blocks: a block is the text between two tags that begin or end a block, with
character references decoded and each stretch of white space (Unicode's, a line break's tag too) as one space. A block has
FEATURES: its count of words and the share of them within links, the same of the block before and the one after, and what
encloses it: whether the nearest enclosing element that says what it is holds content (an article, or a name such as "content")
or something else (a menu, an advert, a form, a comment, by its tag, role, class or id), whether any encloses it that content
never stands in, whether it is a heading, and whether it ends as a sentence does. A decision tree of Gini splits
says which blocks are main text; it is trained on the blocks of LABELLED, whose labels stand in the table.
Scripts, styles, comments of the markup, titles and other elements that don't show text have no blocks.

Null and empty pages have the empty text. Markup may be damaged: elements that aren't closed end with what encloses them, a tag,
comment or script cut off by the end of the page is no text. Pages are taken whole; nothing is dropped but blocks that the tree
rejects. Repeated rows give equal texts; of the caller's columns only the named ones are read.
"""

from __future__ import annotations

import functools
import html as html_references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import mapped

#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript template title textarea iframe object svg math select button canvas audio video datalist head".split())
#: Of these, the ones whose content isn't markup: it ends at their own end tag alone.
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label link map mark meta nobr output param q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: An element beyond which ENDS doesn't look.
HOLDS = frozenset("ul ol dl menu table tbody thead tfoot div section article body".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog address".split())
#: What never has main text in it, whatever it encloses in turn.
NEVER = frozenset("nav footer aside menu dialog".split())
GOOD_NAMES = frozenset("article content main post entry story text body maincontent articlebody postbody entrycontent".split())
BAD_NAMES = frozenset(
    """ad ads adv adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners
    nav navbar navigation menu menus topnav subnav breadcrumb breadcrumbs pagination pager tabs toolbar topbar skip
    header masthead site-header pageheader footer foot sitefooter pagefooter copyright colophon legal
    sidebar side aside rail widget widgets related recommended recommendations trending popular more-from tags tagcloud
    comment comments commentlist discussion reply replies respond disqus
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay dialog banner-notice announcement warning toast
    form search searchbox login signup signin subscribe subscription newsletter register contact
    share sharing social follow buttons meta byline hidden search-form complementary contentinfo""".split()
)
#: Of these, whole names of elements that never have main text in them.
NEVER_NAMES = frozenset("ad ads advert advertisement sponsored sidebar widget related recommended comment comments commentlist comment-list replies cookie-notice newsletter breadcrumbs pagination navbar menu".split())
ROLES = {"main": 1, "article": 1, "navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "menu": -1, "menubar": -1, "alertdialog": -1}

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "within", "never", "heading", "sentence")

_TAG = re.compile(r"""<(?:!--|(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT = re.compile(r"<[/!?A-Za-z][^>]*\Z")


class Block(NamedTuple):
    text: str
    words: int
    density: float
    within: int
    never: int
    heading: int


@functools.lru_cache(1 << 16)
def kind_of(tag: str, attributes: str) -> tuple[int, int]:
    """1 for an element that holds content, -1 for one that holds something else, 0 for one that doesn't say (names before tags); and 1 if main text never stands in it."""
    if tag in ("html", "body"):
        return 0, 0
    found, never = 0, int(tag in NEVER)
    for name, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            said = ROLES.get(value.strip().lower(), 0)
        else:
            # each name (as written, and joined of its parts) and each of its parts
            never |= int(any(whole.lower() in NEVER_NAMES for whole in value.split()))
            names = {n for whole in value.split() for n in (whole.lower(), *(p.lower() for p in _PART.findall(whole)))}
            said = -1 if names & BAD_NAMES else 1 if names & GOOD_NAMES else 0
        found = said if found == 0 or said < 0 else found
    return found or (1 if tag in GOOD_TAGS else -1 if tag in BAD_TAGS else 0), never


class _Open(NamedTuple):
    tag: str
    within: int
    never: int


def blocks_of(page: str) -> list[Block]:
    """The flat blocks of a page that have text."""
    out: list[Block] = []
    stack = [_Open("", 0, 0)]
    chunks: list[tuple[str, bool]] = []
    links = heading = 0

    def flush() -> None:
        if not chunks:
            return
        text = " ".join(html_references.unescape("".join(c for c, _ in chunks)).split())
        if text:
            n = text.count(" ") + 1
            linked = sum(len(html_references.unescape(c).split()) for c, inside in chunks if inside)
            top = stack[-1]
            out.append(Block(text, n, min(1.0, linked / n), top.within, top.never, int(heading > 0)))
        chunks.clear()

    def close(depth: int) -> None:
        nonlocal links, heading
        while len(stack) > depth:
            gone = stack.pop().tag
            links -= gone == "a"
            heading -= gone in HEADINGS

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if not m:
            text = _CUT.sub("", text)
        if text:
            chunks.append((text, links > 0))
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            chunks.append((" ", False))
            continue
        if tag not in INLINE:
            flush()
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
            continue
        if tag in UNSEEN and tag != "head":
            end = _end_of(page, tag, at)
            at = n if end < 0 else end
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            _end_others(stack, tag, close)
        elif tag == "a" and links:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "a"), 0)
            if depth == len(stack) - 1:  # a link doesn't stand in a link: the one before wasn't closed
                close(depth)
        top = stack[-1]
        kind, never = kind_of(tag, m[3] or m[6] or "")
        if tag == "header" and top.within > 0 and kind < 0:  # an article's own head: its title belongs to it
            kind = 0
        stack.append(_Open(tag, kind or top.within, top.never or never))
        links += tag == "a"
        heading += tag in HEADINGS
    flush()
    return out


def _end_of(page: str, tag: str, at: int) -> int:
    """Where an unseen element that begins before at ends: after its end tag; nested ones of the same tag count unless it is raw."""
    depth = 1
    for m in _ends(tag).finditer(page, at):
        depth += -1 if m[1] else int(tag not in RAW)
        if depth == 0:
            return m.end()
    return -1


@functools.cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I)


def _end_others(stack: list[_Open], tag: str, close) -> None:
    """Ends the elements that a start tag of a block ends: an open paragraph, and what ENDS says."""
    ended = ENDS.get(tag, ())
    for i in range(len(stack) - 1, 0, -1):
        own = stack[i].tag
        if own in ended or own == "p" or own in HEADINGS and tag in HEADINGS:
            close(i)
            if own != "p":
                return
        elif own in HOLDS or own not in INLINE and not ended:
            return


def features_of(blocks: list[Block]) -> list[tuple]:
    """FEATURES of each block; beyond the first and the last there is a block of no words."""
    none = Block("", 0, 0.0, 0, 0, 0)
    rows = []
    for before, b, after in zip([none, *blocks[:-1]], blocks, [*blocks[1:], none], strict=True) if blocks else ():
        rows.append((b.words, b.density, before.words, before.density, after.words, after.density, b.within, b.never, b.heading, int(b.text[-1] in ".!?…:;\"'”’)")))
    return rows


#: The training table: pages of blocks, each "label words markup" with * for so many words; 1 is main text. Fixed values of our own.
LABELLED = (
    "0 6 <nav><ul><li><a>*</a></li></ul></nav> | 0 10 <div class=ad>*</div> | 1 7 <article><h1>*</h1> | 1 60 <p>*.</p> | 1 4 <p>*.</p> | 1 1 <p>*.</p> | 1 25 <p>*.</p></article> | 0 14 <footer>*</footer>",
    "0 3 <header><a>*</a></header> | 0 2 <nav><a>*</a></nav> | 1 9 <main><h1>*</h1> | 1 80 <p>*.</p> | 1 3 <h2>*</h2> | 1 5 <p>*</p> | 1 45 <p>*.</p> | 1 6 <ul><li>*</li> | 1 8 <li>*</li></ul></main> | 0 9 <footer>*.</footer>",
    "0 4 <div id=menu><a>*</a></div> | 1 8 <div class=content><h1>*</h1> | 1 50 <p>*.</p> | 1 12 <p>*.</p> | 0 20 <div class=advert>*.</div> | 1 30 <p>*.</p></div> | 0 30 <div id=sidebar>*.</div> | 0 4 <div class=footer>*</div>",
    "1 6 <article><h1>*</h1> | 0 4 <div class=share><a>*</a></div> | 1 40 <p>*.</p> | 0 12 <aside>*.</aside> | 1 33 <p>*.</p> | 0 5 <section class=comments><h3>*</h3> | 0 40 <p>*.</p> | 0 70 <p>*.</p></section></article>",
    "0 15 <div class=cookie>*.</div> | 0 5 <form><label>*</label></form> | 1 70 <article><p>*.</p> | 1 9 <p><a>*</a></p> | 1 3 <p><a>*</a></p> | 1 2 <blockquote>*</blockquote></article> | 0 50 <div class=comment>*.</div> | 0 8 <div class=related><a>*</a></div>",
    "0 2 <div><a>*</a></div> | 0 3 <div><a>*</a></div> | 0 1 <div><a>*</a></div> | 1 9 <h1>*</h1> | 1 45 <p>*.</p> | 1 60 <p>*.</p> | 1 20 <p>*.</p> | 1 38 <p>*.</p> | 0 4 <div>*</div> | 0 3 <div><a>*</a></div>",
    "0 5 <div><a>*</a></div> | 0 4 <td><a>*</a></td> | 1 7 <h1>*</h1> | 1 90 <p>*.</p> | 1 15 <p>*.</p> | 1 30 <p>*.</p> | 0 6 <div>*</div> | 0 5 <div><a>*</a></div> | 0 2 <div>*</div>",
    "0 3 <nav>*</nav> | 0 40 <nav>*.</nav> | 0 30 <footer>*.</footer> | 0 60 <aside>*.</aside> | 0 25 <aside><article>*.</article></aside> | 0 45 <div class=newsletter>*.</div> | 0 80 <div class=notice>*.</div> | 0 1 <div class=ad>*</div>",
    "0 4 <div class=nav><a>*</a></div> | 0 10 <div>*.</div> | 1 4 <h1>*</h1> | 1 40 <p>*.</p> | 1 3 <p>*.</p> | 1 50 <p>*.</p> | 1 2 <h2>*</h2> | 1 6 <p>*.</p> | 1 35 <p>*.</p> | 1 5 <p>*.</p> | 1 42 <p>*.</p> | 0 3 <div>*</div> | 0 2 <div><a>*</a></div>",
    "0 2 <div><a>*</a></div> | 0 2 <div><a>*</a></div> | 1 2 <h1>*</h1> | 1 30 <p>*.</p> | 1 28 <p>*.</p> | 1 2 <p>*.</p> | 1 55 <p>*.</p> | 0 30 <div><a>*</a></div> | 0 12 <div>*</div> | 0 40 <div class=related><article>*.</article></div>",
    "0 55 <form><p>*.</p></form> | 0 12 <header><p>*.</p></header> | 1 5 <main><p>*</p> | 1 2 <p>*.</p> | 1 10 <p><a>*</a>.</p> | 1 1 <p>*</p></main> | 0 1 <footer><a>*</a></footer>",
)


def labelled_blocks(pages: tuple[str, ...] = LABELLED) -> list[tuple[tuple, int]]:
    """Features and label of each block of labelled pages. A block within an element that says what it is has its label whatever stands beside it:
    it is in the table again beside nothing, links and prose."""
    rows = []
    for page in pages:
        pieces = [p.strip().split(" ", 2) for p in page.split(" | ")]
        blocks = blocks_of("".join(markup.replace("*", " ".join(["word"] * int(n))) for _, n, markup in pieces))
        rows += zip(features_of(blocks), (int(label) for label, _, _ in pieces), strict=True)
    beside = ((0, 0.0), (3, 1.0), (40, 0.0))
    named = [(x, y) for x, y in rows if x[FEATURES.index("within")] or x[FEATURES.index("never")]]
    return rows + [(x[:2] + before + after + x[6:], y) for x, y in named for before in beside for after in beside]


def _impurity(labels: list[int]) -> float:
    share = sum(labels) / len(labels)
    return 2 * share * (1 - share) * len(labels)


def grown(rows: list[tuple[tuple, int]], least: int = 1, depth: int = 6) -> tuple | int:
    """A decision tree: (feature, threshold, tree of rows at most the threshold, tree of the rest), or a leaf's label. Gini splits; the first of equals."""
    labels = [y for _, y in rows]
    leaf = int(2 * sum(labels) > len(labels))
    best, best_gain = None, 1e-9
    if depth and 0 < sum(labels) < len(labels):
        for f in range(len(FEATURES)):
            values = sorted({x[f] for x, _ in rows})
            for low, high in zip(values, values[1:]):
                cut = (low + high) / 2
                a, b = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
                gain = _impurity(labels) - _impurity(a) - _impurity(b)
                if min(len(a), len(b)) >= least and gain > best_gain:
                    best, best_gain = (f, cut), gain
    if not best:
        return leaf
    f, cut = best
    return (f, cut, grown([r for r in rows if r[0][f] <= cut], least, depth - 1), grown([r for r in rows if r[0][f] > cut], least, depth - 1))


def judged(tree: tuple | int, x: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def trained() -> tuple | int:
    """The tree of LABELLED; every task grows the same one, from some hundreds of rows."""
    return grown(labelled_blocks())


def main_text_of(page: str | None, tree: tuple | int | None = None) -> str:
    """The blocks of a page that the tree takes for main text, a line each."""
    blocks = blocks_of(page or "")
    tree = trained() if tree is None else tree
    return "\n".join(b.text for b, x in zip(blocks, features_of(blocks), strict=True) if judged(tree, x))


def main_text(html: Column, tree: tuple | int | None = None) -> Column:
    """The main text of a column of pages; tree: one grown from other labelled blocks."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            yield mapped(some, lambda page: main_text_of(page, tree), pa.string())

    return of(html)


def report(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Id, url, text and the text's length in code points of every page, a map without a shuffle."""
    made = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"), main_text(F.col(html)).alias("text"))
    return made.select(F.col("_id").alias(id), F.col("_url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))


def oracle_sql() -> str:
    """op13's rows for DuckDB, from what the tables' pages have in their article element: blocks end at tags of blocks, four character references."""
    text = "regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1)"
    for pattern, to in ((r"[\s]+", " "), (r"(?i)<br\s*/?>", " "), (r"(?i)</?(p|h[1-6]|div|ul|ol|li|article)(\s[^>]*)?>", chr(10)), (r"<[^>]*>", "")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    for pattern, to in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    for pattern, to in ((r" *\n[ \n]*", chr(10)), (" +", " "), (r"^[ \n]+|[ \n]+$", "")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"SELECT page_id, url, {text} AS text, CAST(length({text}) AS BIGINT) AS n_chars FROM pages"
