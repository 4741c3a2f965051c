"""Each operator against a brute-force version, an exact round trip, or held-out accuracy; and odd rows."""

import base64
import collections
import hashlib
import html.parser
import io
import itertools
import math
import random
import re
import time
import tracemalloc
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reelgrid.llm import bpe, common, components, language, media, mixing_coder, queries, rollup, simhash, suffix_arrays, suffix_tree, token_blocks, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, f long, seen string, key string"


def odd_rows(n: int = 0):
    """Nulls in any column, empty and long texts, ties, repeated rows; extra columns whose names clash."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("aeiourstnl") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " ", "\n\n", "one", "one two", "ONE two three", "one two THREE", "x" * 30_000, "ab " * 9_000, "a  b\t\tc ", "é日本語 ß\U0001f600", " lead and trail "]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", None if i % 7 == 0 else f"src{i % 3}", None, i, 7, "x", "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[20], rows[20], (20, "another text of that id", "en", "src1", 1, None, None, None, None), (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 ----


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            parent[root(i)] = root(j)
    least = collections.defaultdict(lambda: None)
    for i, (d, _) in enumerate(prints):
        if d is not None and (least[root(i)] is None or d < least[root(i)]):
            least[root(i)] = d
    return [(d, f"{f:016x}", least[root(i)]) for i, (d, f) in enumerate(prints)]


def some(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_simhash_equals_brute_force(which, request):
    df = request.getfixturevalue(which)
    want = brute_components([(r.doc_id, brute_print(r.text)) for r in df.collect()])
    assert some(map(tuple, simhash.near_duplicates(df).collect())) == some(want)


def test_every_pair_within_the_radius_shares_a_mask():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for at in itertools.combinations(range(0, 64, 1 if radius < 3 else 3), radius):
            gap = sum(1 << b for b in at)
            assert any(not gap & m for m in masks)


@pytest.mark.parametrize("small", [2, 32])
def test_links_close_over_crowded_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {c for c in centres} | {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) & (2**64 - 1) for c in centres for _ in range(60)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "f long")
    linked = {frozenset((a % 2**64, b % 2**64)) for a, b in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, linked))
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    at = {p: i for i, p in enumerate(prints)}
    edges = spark.createDataFrame([(at[min(x)], at[max(x)]) for x in linked], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert [got.get(i, i) for i in range(len(prints))] == [w[2] for w in want]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def test_first_of_each_keeps_one_of_a_group(odd, empty):
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    labelled = brute_components([(i, brute_print(r.text)) for i, r in enumerate(odd.collect())])
    assert len(rows) == len({c for *_, c in labelled})
    assert len({brute_print(t) for _, t in rows}) == len(rows)
    assert simhash.first_of_each(empty).count() == 0


def test_first_of_each_by_any_column_s_name(odd):
    rows = odd.drop("id").withColumnRenamed("doc_id", "id").withColumns({c: F.lit(1) for c in ("n", "root", "row", "digest", "f")})
    kept = simhash.first_of_each(rows, id="id")
    assert kept.columns == rows.columns and kept.count() == simhash.first_of_each(odd).count()


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOTTEST", 2)
    left = spark.createDataFrame([(i, k) for i, k in enumerate([1] * 50 + [2] * 20 + [3, 4, 5, None])], "i long, k long")
    right = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d"), (None, "n")], "k long, v string")
    for how in ("inner", "left"):
        assert some(map(tuple, common.hot_join(left, right, "k", how).select("i", "v").collect())) == some(map(tuple, left.join(right, "k", how).select("i", "v").collect()))


# ---- 2 ----


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(common.LOWER_TABLE))
    w, hit, found, longest = words(text), set(), set(), (0, 1)
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        places = collections.defaultdict(list)
        for j in range(len(v) - n + 1 if v else 0):
            places[tuple(v[j : j + n])].append(j)
        for i in range(len(w) - n + 1):
            for j in places.get(tuple(w[i : i + n]), ()):
                hit |= set(range(i, i + n))
                found |= {str(item)} - {"None"}
                m = n
                while i + m < len(w) and j + m < len(v) and w[i + m] == v[j + m]:
                    m += 1
                longest = max(longest, (m, -i))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), longest[0], -longest[1]


def leaky(spark, docs):
    """Items cut out of the documents, short ones, overlapping ones, an empty one, repeats."""
    rng, rows = random.Random(3), [(None, "nothing"), (None, "one two three"), (1, None), (2, ""), (3, "One TWO"), (3, "One TWO"), (4, "ab ab ab ab ab ab ab ab ab ab ab ab ab")]
    for k, r in enumerate(docs.where("text is not null").limit(40).collect()):
        w = r.text.split()
        if len(w) > 30:
            i = rng.randrange(len(w) - 25)
            rows.append((10 + k, " -- ".join(w[i : i + rng.randint(5, 25)])))
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_decontamination_equals_brute_force(spark, which, block_bytes, request):
    df = request.getfixturevalue(which)
    bench = leaky(spark, df)
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = [(r.doc_id, *brute_hits(r.text, items)) for r in df.collect()]
    assert some(map(tuple, suffix_arrays.report(df, bench, block_bytes=block_bytes).collect())) == some(want)


def test_decontaminated_keeps_clean_rows_as_they_were(odd, empty, spark):
    bench = spark.createDataFrame([(3, "one two")], "item_id long, text string")
    rows = odd.withColumns({c: F.lit(777) for c in ("n_words", "hit_spans", "found", "row", "_found", "longest")})
    kept = suffix_arrays.decontaminated(rows, bench)
    assert kept.columns == rows.columns
    assert some(map(tuple, kept.collect())) == some(tuple(r) for r in rows.collect() if not brute_hits(r.text, [(3, "one two")])[4])
    assert suffix_arrays.report(empty, bench).count() == 0
    assert suffix_arrays.report(odd, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_are_joined_for_clashing_names(odd, spark):
    bench = spark.createDataFrame([(i, f"one two {w}" if w else "one two") for i, w in enumerate(["", "three", "x"] * 40)], "item_id long, text string")
    rows = odd.withColumns({c: F.lit(5) for c in ("a", "b", "found")})
    want = some(tuple(r) for r in rows.collect() if not brute_hits(r.text, [(3, "one two")])[4])
    assert some(map(tuple, suffix_arrays.decontaminated(rows, bench, block_bytes=300).collect())) == want


def test_longest_matches_of_every_suffix():
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n)).encode()
    docs, items = [text(200), text(3), b"", text(90)], [("x", text(40)), ("y", text(12))]
    shard = suffix_arrays.Shard(docs, suffix_arrays.Benchmark(items))
    got, where = shard.longest()
    words = [d.split() for d in docs]
    flat = [w for d in words for w in d]
    k = 0
    for _, t in items:
        t = t.split()
        for i in range(len(t)):
            most = max(next((n for n in range(min(len(t) - i, len(d) - p) + 1) if n == min(len(t) - i, len(d) - p) or d[p + n] != t[i + n]), 0) for d in words for p in range(len(d)))
            assert got[k] == most
            assert not most or flat[where[k] : where[k] + most] == t[i : i + most]
            k += 1


# ---- 3 ----


def test_warc_round_trip_and_links(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(None, None, None), (9001, "http://a/", ""), (9002, "x", "a\r\n\r\nWARC/1.0\r\n<p>b &amp;lt; c</p>"), (9002, "x", "a\r\n\r\nWARC/1.0\r\n<p>b &amp;lt; c</p>")], "page_id long, url string, html string"))
    found = warc.responses(pages)
    warc.write_warc(warc.response_records(found), f"{tmp_path}/w", per_file=7)
    back = warc.read_responses(spark, f"{tmp_path}/w")
    cols = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]
    assert some(map(tuple, back.select(cols).collect())) == some(map(tuple, found.select(cols).collect()))
    derived = warc.derive(back).collect()
    by = collections.defaultdict(list)
    for r in derived:
        by[r.refers_to].append(r)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    for r in found.collect():
        one, two = sorted(by[r.record_id], key=lambda x: x.record_type)[:: len(by[r.record_id]) // 2]
        assert (one.record_type, two.record_type) == ("conversion", "metadata") and one.concurrent_to == two.record_id and two.concurrent_to == one.record_id
        assert r.payload_digest in two.block and f"source-content-length: {len(r.payload.encode())}" in two.block
    assert any(r.block == "a\nWARC/1.0\nb &lt; c" for r in derived)
    warc.write_warc(warc.derive(back).withColumnRenamed("http_headers", "h"), f"{tmp_path}/d")
    again = warc.read_warc(spark, f"{tmp_path}/d")
    assert some((r.record_id, r.block) for r in again.collect()) == some((r.record_id, r.block) for r in derived)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


class Shown(html.parser.HTMLParser):
    """The text that a page shows, by a parser: a line for each block."""

    BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav footer header title body head html blockquote pre".split())

    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in self.BLOCKS and not self.hidden else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in self.BLOCKS and not self.hidden else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    def handle_entityref(self, name):
        self.handle_data(dict(warc.ENTITIES).get(f"&{name};", f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(dict(warc.ENTITIES).get(f"&#{name};", f"&#{name};"))

    def text(self) -> str:
        lines = (re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).strip(" ") for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_plain_text_is_what_a_parser_shows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("html IS NOT NULL").select("html", warc.plain_text(F.col("html")).alias("plain")).collect()
    assert len(pages) > 10 and all(r.plain == Shown(r.html).text() for r in pages)


def test_damaged_records_are_passed_over():
    good = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nxyz\r\n\r\n"
    assert [(r["record_type"], r["block"]) for r in warc.parsed(good + bad + good + b"WARC/1.0\r\n")] == [("metadata", "abc"), ("response", ""), ("metadata", "abc")]


# ---- 4 ----


@pytest.mark.parametrize("ids", [[], [0], [5] * 5000, list(range(50_257)), None])
def test_mixing_coder_round_trip(ids):
    rng = np.random.default_rng(0)
    ids = np.array(ids if ids is not None else rng.zipf(1.2, 30_000) % 50_257, np.int64)
    blocks = list(mixing_coder.encode(ids, block=256, lanes=50))
    assert (mixing_coder.decode(blocks, lanes=33) == ids).all()
    for i in range(0, len(blocks), 17):  # each block on its own
        assert (mixing_coder.decode([blocks[i]]) == ids[i * 256 : (i + 1) * 256]).all()


def test_damage_is_noticed():
    (block,) = mixing_coder.encode(np.arange(500) % 97)
    broken = bytearray(block)
    broken[40] ^= 255
    with pytest.raises(mixing_coder.Damaged):
        mixing_coder.decode([bytes(broken)])


def test_ids_outside_the_format_are_refused():
    for ids in ([3, 65_535], [-1, 4]):
        with pytest.raises(mixing_coder.OutOfRange):
            list(mixing_coder.encode(np.array(ids)))
    for cut in (b"", b"TKB2", next(mixing_coder.encode(np.arange(9)))[:-7], b"x" * 40):
        with pytest.raises(mixing_coder.Damaged):
            mixing_coder.decode([cut])


@pytest.mark.parametrize("most", [3, 1000])
def test_words_encoded_together_are_the_library_s(most):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_blocks.Encoder(path, most), Tokenizer.from_file(path)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["a  b c", "  a b  ", "a\nb c d\n e", "x <|endoftext|> y a", " q", "tab\t b c", "it's I'll 'x' 12a a1,.b", "a\x1c b\u3000c \x85d"]
    for some in (texts, texts[:13], [t for t in texts if bpe.lone_spaces(t)], [None, ""], []):
        ids, sizes = own.ids(pa.array(some, pa.string()), 7)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in some]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_words_are_encoded_once_whatever_follows_them():
    """Lines, commas and the like around a known word cost the library no further word."""
    own = token_blocks.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, seen = own.tokenizer, []

    class Spy:
        def encode(self, text, **how):
            seen.append(text)
            return library.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **how)

    own.ids(pa.array(["a zyxophone\nzyxophone"]))
    own.tokenizer = Spy()
    text = "a zyxophone, zyxophone. zyxophone!\nzyxophone; zyxophone?!\nzyxophone $ zyxophone"
    ids, _ = own.ids(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert seen and not any("zyxophone" in t for t in seen)


def test_lines_and_punctuation_are_the_library_s():
    rng, path = random.Random(3), public_tokenizers.path("byte_bpe_50k.json")
    own = token_blocks.Encoder(path, 40)
    pieces = ["a", "the", "wordthatislongerthanwhatisremembered", " ", " ", " ", "\n", "\n\n", ".", ",", "!", "***", "'s", "'", "\u00e9", "12", "<|endoftext|>", "|>", "\t", "\r\n", "\x0b", "\u3000", "\x85", "x.", "\u2026", "\0"]
    for k in range(200):
        some = pieces if k % 2 else [p for p in pieces if p not in ("\t", "\r\n", "\x0b", "\u3000", "\x85", "\n\n")]
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(5)]
        texts = [t.replace("  ", " ").replace(" \n", " ").replace("\n ", " ") for t in texts] if k % 4 < 2 else texts
        ids, sizes = own.ids(pa.array(texts), 7)
        want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_coded_blocks_are_those_of_earlier_files():
    ids = np.random.default_rng(1).zipf(1.3, 20_000) % 50_257
    assert zlib.crc32(b"".join(mixing_coder.encode(ids))) == 4019695410


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_blocks_hold_every_id(spark, which, request, tmp_path):
    from tokenizers import Tokenizer

    df, path = request.getfixturevalue(which), public_tokenizers.path("byte_bpe_50k.json")
    token_blocks.write(df, f"{tmp_path}/t", path)
    tokenizer = Tokenizer.from_file(path)
    coded = [(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")) for r in df.collect()]
    want = some((d, len(c), zlib.crc32(c.tobytes())) for d, c in coded)
    got = token_blocks.report(token_blocks.read(spark, f"{tmp_path}/t")).collect()
    assert some((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


# ---- 5 ----


def test_language_is_found_and_clean_documents_stay(docs):
    got = language.of_documents(docs).select("doc_id", "lang", "language", "accepted").collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got)
    assert all(r.accepted for r in got)


def test_language_of_odd_rows(odd, empty, docs):
    model = language.fitted(docs)
    kept = language.accepted_documents(odd, model)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts and "\n\n" not in texts
    assert language.accepted_documents(empty, model).count() == 0
    assert language.accepted_documents(empty).count() == 0 and language.fitted(empty).langs == []


def brute_fused(model, rows):
    """(language, posterior, text_language, accepted) of rows (text, declared, country, path, host, domain), by plain counts of votes."""
    n, read = len(model.langs), [model.scores((r[0] or "").encode()) for r in rows]
    vote = [max(range(n), key=lambda i: (logs[i], -i)) if letters and max(logs[:n]) >= logs[n] else None for logs, letters in read]
    totals = [vote.count(i) for i in range(n)]
    tables = [collections.Counter((r[k], v) for r, v in zip(rows, vote, strict=True) if v is not None) for k in range(6)]
    out = []
    for r, v, (logs, letters) in zip(rows, vote, read, strict=True):
        others = lambda k, i: max(tables[k][r[k], i] - (v == i), 0)  # noqa: B023, E731
        fused = []
        for i in range(n):
            everywhere = (totals[i] + 1) / (sum(totals) + n)
            domain = (others(5, i) + 20 * everywhere) / (sum(others(5, j) for j in range(n)) + 20)
            prior = (others(4, i) + 20 * domain) / (sum(others(4, j) for j in range(n)) + 20)
            says = sum(math.log((others(k, i) + 1 / values) / (max(totals[i] - 1, 0) + 1)) for k, values in ((1, 27**3), (2, 27**2), (3, 27**2)))
            fused.append(logs[i] + math.log(prior) + says)
        best = max(range(n), key=lambda i: (fused[i], -i))
        posterior = 1 / sum(math.exp(x - fused[best]) for x in fused)
        accepted = letters > 0 and logs[n] + math.log(1e-3) <= max(logs[:n]) and posterior >= 0.5
        out.append((model.langs[best] if accepted else "und", round(posterior, 6), "und" if v is None else model.langs[v], accepted))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fusion_of_documents_equals_brute_force(which, request, docs):
    df, model = request.getfixturevalue(which), language.fitted(docs)
    code = lambda d: m[1] if (m := re.fullmatch("([a-z]{2,3})(?:[-_].*)?", (d or "").lower())) else ""
    ends = lambda h: m[1] if (m := re.search(r"\.([a-z]{2})$", h)) else ""
    rows = [(r.doc_id, (r.text, code(r.lang), ends((r.source or "").lower()), "", (r.source or "").lower(), ".".join((r.source or "").lower().split(".")[-2:]))) for r in df.collect()]
    want = some((d, *w) for (d, _), w in zip(rows, brute_fused(model, [r for _, r in rows]), strict=True))
    clash = df.withColumns({c: F.lit("x") for c in ("language", "row", "host", "fused", "kept")})
    got = language.of_documents(clash, model).select("doc_id", "language", F.round("posterior", 6), "text_language", "accepted").collect()
    assert some(map(tuple, got)) == want


def test_fusion_of_pages_equals_brute_force(spark, sf, docs):
    model = language.fitted(docs)
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(None, None, None), (1, "http://a.b.de/fr/x", "<html lang='es-MX'>la la"), (2, "http://c.b.de/", "")], "page_id long, url string, html string"))
    rows = []
    for r in pages.collect():
        url, html = r.url or "", r.html or ""
        host = m[1].lower() if (m := re.search("://([^/?#:]*)", url)) else ""
        shown = re.sub("<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ", html))
        declared = m[1].lower() if (m := re.search(r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", html)) else ""
        path = m[1].lower() if (m := re.search("://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", url)) else ""
        rows.append((r.page_id, (shown, declared if 2 <= len(declared) <= 3 else "", m[1] if (m := re.search(r"\.([a-z]{2})$", host)) else "", path, host, ".".join(host.split(".")[-2:]))))
    want = some((p, *w) for (p, _), w in zip(rows, brute_fused(model, [r for _, r in rows]), strict=True))
    got = language.of_pages(pages, model).select("page_id", "language", F.round("posterior", 6), "text_language", "accepted").collect()
    assert some(map(tuple, got)) == want


def test_many_languages_take_no_longer_expressions(spark):
    rng = random.Random(0)
    words = lambda k: " ".join("".join(chr(97 + (k * 7 + rng.randrange(6)) % 26) for _ in range(5)) for _ in range(30))
    langs = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(250)]
    rows = [(i, words(i // 3), langs[i // 3], "s") for i in range(750)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fitted(df)
    assert model.langs == langs
    began = time.time()
    assert language.of_documents(df.limit(8), model).where("language IS NOT NULL").count() == 8
    assert time.time() - began < 30


def test_junk_is_rejected(spark, docs):
    rng = random.Random(2)
    junk = ["".join(rng.choice("qxzjkvwpyfghbc") for _ in range(400)), "0123 4567 89", "!!! ???"]
    rows = spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string")
    assert not any(r.accepted for r in language.of_documents(rows, language.fitted(docs)).collect())


def test_declaration_suffix_and_host_decide_short_texts(spark, docs):
    model = language.fitted(docs)
    rows = [(i, f"http://h{i % 3}.example.de/de/{i}", '<html lang="de"><p>ja</p>') for i in range(40)] + [(99, "http://h0.example.de/de/1", "<p>a</p>")]
    got = language.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")), model)
    assert {r.page_id: r.accepted for r in got.collect()}[None] is False


# ---- 6 ----


def test_url_rules_and_terms(spark):
    cases = [
        ("http://Example.com/en/7x", "example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://a.b.com/en/", "a.b.com", "/en/", "com/en/", "block"),
        ("https://x.example.net/de/81?q", "x.example.net", "/de/81", "example.net/de/8", "block"),
        ("https://x.net/de/#casino-porn", "x.net", "/de/", "net/de/", "allow"),
        ("http://notcom/en/", "notcom", "/en/", None, "allow"),
        ("http://site.info/porn/1", "site.info", "/porn/1", None, "block"),
        ("http://site.info/export/pornography", "site.info", "/export/pornography", None, "allow"),
        ("http://site.info/free-bonus", "site.info", "/free-bonus", None, "block"),
        ("http://site.info/free-free", "site.info", "/free-free", None, "allow"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/porn", "", "", None, "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, judged string")
    got = {r.page_id: tuple(r.judged[k] for k in ("host", "path", "rule", "verdict")) for r in url_filter.judge_urls(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_first_of_equally_long_rules_wins(spark):
    df = spark.createDataFrame([(1, "http://a.com/x/1")], "page_id long, url string")
    for rules in ((("block", "a.com/x"), ("allow", "a.com/x")), (("allow", "a.com/x"), ("block", "a.com/x"))):
        assert url_filter.judge_urls(df, rules=rules).first().judged.verdict == rules[0][0]


def test_terms_weigh_what_their_table_says(spark):
    terms = spark.createDataFrame([("Bet", 0.4), ("bet", 0.6), ("slots", 0.5), ("odd", None), (None, 2.0), ("", 3.0), ("vile", 1.5)], "term string, weight double")
    vocabulary = url_filter.vocabulary_of(terms)
    assert vocabulary == {"bet": 0.6, "slots": 0.5, "vile": 1.5}
    urls = ["http://s.info/bet", "http://s.info/bet/BET", "http://s.info/bet-slots", "http://s.info/vile", "http://s.info/alphabet-slots"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.judged.verdict for r in url_filter.judge_urls(df, vocabulary=vocabulary).collect()}
    assert got == {0: "allow", 1: "allow", 2: "block", 3: "block", 4: "allow"}
    assert {r.judged.verdict for r in url_filter.judge_urls(df, vocabulary={}, rules=()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.vocabulary_of(terms, most=2)


# ---- 7 ----


def reference_encoding():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_bpe_equals_the_library(which, request):
    path, own = reference_encoding()
    df = request.getfixturevalue(which)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r.doc_id, len(i := own.encode_ordinary(r.text or "")), sha(np.array(i, "<u4").tobytes()), sha((r.text or "").encode())) for r in df.collect()]
    assert some(map(tuple, bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())) == some(want)


@pytest.mark.parametrize("leaf", [1, 3, 24])
def test_tree_joins_equal_plain_merges(leaf):
    path, own = reference_encoding()
    encoder = bpe.Encoder.from_file(path, public_tokenizers.PATTERN)
    encoder.leaf = leaf
    rng = random.Random(leaf)
    for _ in range(300):
        alphabet = rng.choice(["ab", "aeiost", "thesingatonr", "the ing", "=-", "éßäñ", "日本語"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == own.encode_ordinary(text)
    for text in ("a" * 20_000, " " * 5_000, "\x1c \x85　x", "it's  I'LL\n\n x"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == own.encode_ordinary(text)


# ---- 8 ----


def brute_base(rows):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(common.LOWER_TABLE)), "\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = collections.Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for d, t in rows]


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("rare", [False, True])
def test_base_scores_equal_brute_force(which, rare, request, monkeypatch):
    if rare:  # most words go by the join
        monkeypatch.setattr(suffix_tree, "LEAST_NEXT", 5.0)
    df = request.getfixturevalue(which)
    want = some((*w[:5], round(w[5], 6)) for w in brute_base([(r.doc_id, r.text) for r in df.collect()]))
    got = suffix_tree.score_held_out(df).collect()
    key = lambda rows: [(*w[:5], round(w[5], 4)) for w in rows]
    assert key(some((*tuple(r)[:5], round(r.base_score, 6)) for r in got)) == key(want)


def brute_scores(rows, share):
    """Scores when no context is common: states of one and two words from plain counts; share: of the words with codes."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(common.LOWER_TABLE)), "\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    before = lambda w, i: ((w[i - 1],), (w[i - 2] if i > 1 else None, w[i - 1]))
    count, total, gram = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in rows:
        if not held(d):
            w = words(t)
            count.update(w)
            for i in range(1, len(w)):
                for c in before(w, i):
                    total[c] += 1
                    gram[c, w[i]] += 1
    n, v = sum(count.values()), len(count)
    least = max(1.0, share * n)
    root = lambda w: math.log((count[w] + 1) / (n + v + 1))
    known = lambda w: root(w) if count[w] >= least else math.log((least + 1) / (n + v + 1))
    mixed = lambda w: root(w) if count[w] >= least else math.log(3 / (n + v + 1))
    both = lambda a, b: math.log(math.exp(a) + math.exp(b))
    after = collections.defaultdict(dict)
    for (c, w), k in gram.items():
        after[c][w] = k
    direct = lambda c, w: math.log((after[c][w] - 0.75) / total[c])
    counted = lambda c, w: after[c].get(w, 0) >= 2
    back = lambda c: math.log(1 - sum(k - 0.75 for k in after[c].values() if k >= 2) / total[c])
    differs = lambda c, lower: total[c] >= 2 and sum(k / total[c] * (math.log(k / total[c]) - lower(w)) for w, k in after[c].items() if k >= 2) >= 0.05
    one = {c for c in list(after) if len(c) == 1 and differs(c, known)}
    two = set()
    for c in [c for c in after if len(c) == 2]:
        s = c[1:]
        lower = lambda w, s=s: (both(direct(s, w), known(w) + back(s)) if counted(s, w) else known(w) + back(s)) if s in one else known(w)
        if differs(c, lower):
            two.add(c)
    one |= {c[1:] for c in two}
    out = []
    for d, t in rows:
        w, score = words(t), 0.0
        for i in range(len(w)):
            p, covered = 0.0, False  # beside the root's share, and then in its place
            for c, kept in zip(before(w, i), (one, two), strict=True) if i else ():
                if c in kept and counted(c, w[i]):
                    p, covered = both(direct(c, w[i]), (p if covered else p + mixed(w[i])) + back(c)), True
                elif c in kept:
                    p += back(c)
            score += p if covered else p + root(w[i])
        out.append((d, t, score / math.log(10)))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_scores_of_rarer_words_contexts_equal_brute_force(which, request, monkeypatch):
    monkeypatch.setattr(suffix_tree, "LEAST_CONTEXT", 2.0)  # no context is common
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(suffix_tree, "HELD", 3000)
    df = request.getfixturevalue(which)
    df = df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 100_000))  # copies, so that states are met
    got = some((r.doc_id, round(r.score, 5)) for r in suffix_tree.score_held_out(df).collect())
    want = some((d, round(x, 5)) for d, _, x in brute_scores([(r.doc_id, r.text) for r in df.collect()], 2.0 * suffix_tree.LEAST_NEXT))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-3 for g, w in zip(got, want, strict=True))


def brute_tree(rows):
    """Scores when every word is common: the tree of one and two words from plain counts, each state mixed with its suffix's."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(common.LOWER_TABLE)), "\n"]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for d, t in rows:
        if not held(d):
            w = words(t)
            count.update(w)
            for depth in (1, 2):
                for i in range(depth, len(w)):
                    after[tuple(w[i - depth : i])][w[i]] += 1
    n, v = sum(count.values()), len(count)
    assert suffix_tree.LEAST_CONTEXT * n <= 1
    kept = set()

    def share(c, w):
        if not c:
            return (count[w] + 1) / (n + v + 1)
        lower = share(c[1:], w)
        if c not in kept:
            return lower
        total = sum(after[c].values())
        counted = {x: k for x, k in after[c].items() if k >= max(2, suffix_tree.LEAST_NEXT * total)}
        return ((counted[w] - 0.75) / total if w in counted else 0.0) + (1 - sum(k - 0.75 for k in counted.values()) / total) * lower

    for depth in (1, 2):
        for c in [c for c in after if len(c) == depth]:
            total = sum(after[c].values())
            counted = {x: k for x, k in after[c].items() if k >= max(2, suffix_tree.LEAST_NEXT * total)}
            if counted and sum(k / total * math.log(k / total / share(c[1:], x)) for x, k in counted.items()) >= suffix_tree.DIVERGENCE:
                kept.add(c)
    kept |= {c[1:] for c in kept if len(c) == 2 and any(k >= max(2, suffix_tree.LEAST_NEXT * sum(after[c[1:]].values())) for k in after[c[1:]].values())}
    out = []
    for d, t in rows:
        w = words(t)
        score = 0.0
        for i in range(len(w)):
            c = tuple(w[max(0, i - 2) : i])
            while c and any(x not in count for x in c):
                c = c[1:]
            score += math.log10(share(c, w[i]))
        out.append((d, score))
    return out, kept


def test_scores_of_common_words_contexts_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(90):
        w = ["a"]
        while len(w) < 45:  # a chain with memory, so that some states differ from their suffixes
            w.append(rng.choice("bcde") if w[-1] == "a" else "a" if w[-1] in "bc" and rng.random() < 0.8 else f"w{min(rng.randrange(60), rng.randrange(60))}")
        rows.append((i, " ".join(w) + (" never-seen a b" if i % 9 == 0 else "")))
    want, kept = brute_tree(rows)
    assert {len(c) for c in kept} == {1, 2} and len(kept) > 20
    got = sorted((r.doc_id, r.score) for r in suffix_tree.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-6 * abs(w[1]) for g, w in zip(got, want, strict=True)), [(g, w) for g, w in zip(got, want) if abs(g[1] - w[1]) > 1e-6][:5]


def test_scores_by_any_column_s_name(odd):
    rows = odd.drop("id", "key").withColumnRenamed("doc_id", "key").withColumnRenamed("text", "copies")
    got = suffix_tree.scored(rows, rows, id="key", text="copies")
    assert got.columns[0] == "key" and got.count() == odd.count()


def test_states_grow_with_the_texts(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score - r.base_score for r in suffix_tree.scored(df, df).collect()}
    twice, once = [got[i] for i in range(20)], [got[i] for i in range(20, 60)]
    assert min(twice) > max(once) + 20


def test_suffix_tree_is_a_distribution_and_beats_its_base(spark, docs):
    got = suffix_tree.score_held_out(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]
    training = docs.limit(60)
    counts = suffix_tree.word_counts(training.select("text")).cache()
    tree = suffix_tree.grown(training, counts)
    assert tree.states
    codes = np.arange(len(tree.codes.of))
    rest = counts.count() - len(codes) + 1  # words without a code, and one unknown
    for depth, (contexts, *_) in tree.states.items():
        for c in contexts[:40]:
            p = (10.0 ** tree.conditional(np.full(len(codes), c), depth, codes)).sum()
            unseen = 1.0
            for d in range(1, depth + 1):
                states, backoff, *_ = tree.states.get(d, (np.zeros(0, np.int64),) * 4)
                at = np.searchsorted(states, c % len(codes) ** d)
                if at < len(states) and states[at] == c % len(codes) ** d:
                    unseen *= 10.0 ** backoff[at]
            assert rest == 1 and p + unseen / (tree.total + tree.distinct + 1) == pytest.approx(1.0, abs=1e-9)


def test_scores_of_nothing(empty, odd):
    assert suffix_tree.score_held_out(empty).count() == 0
    nothing = suffix_tree.scored(odd, odd.limit(0)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in nothing)


# ---- 9 ----


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_audio_is_stored_whole(which, request):
    df = request.getfixturevalue(which)
    rows = {(r.doc_id, r.payload_sha256): r for r in media.report(df).collect()}
    features = {}
    for r in df.collect():
        raw = (r.text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        got = rows[r.doc_id, hashlib.sha256(padded).hexdigest()]
        assert (got.n_bytes, got.payload_bytes, got.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        stored = media.to_wav(padded)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == padded
        assert (got.media_bytes, got.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert features.setdefault(padded, got.feature) == got.feature
    assert len(set(features.values())) >= 0.5 * len(features)


def test_fingerprints_follow_the_spectrum():
    t = np.arange(8000)
    tone = lambda hz: (128 + 100 * np.sin(2 * np.pi * hz * t / 8000)).astype(np.uint8)
    peaks = media.peaks_of(np.concatenate((tone(1000), tone(2500))))
    assert (peaks[:100, 0] == 1000 * media.FRAME // 8000).all() and (peaks[-100:, 0] == 2500 * media.FRAME // 8000).all()
    marks = media.fingerprint(tone(1000))
    assert (np.diff(marks) >= 0).all() and set((marks >> 16 & 255).tolist()) <= {15, 16, 17}


def test_the_last_samples_count():
    clip = np.full(1000, 128, np.uint8)
    other = clip.copy()
    other[-30:] = np.tile([0, 255], 15)
    assert (media.peaks_of(clip)[-1] != media.peaks_of(other)[-1]).any()
    for n in (0, 1, 127, 128, 129, 192, 1000):
        assert len(media.peaks_of(np.zeros(n, np.uint8))) == 1 + -(-max(0, n - 128) // 64)


def brute_landmarks(samples):
    """Peaks by direct sums, paired over the next frames."""
    x = np.concatenate((samples.astype(float), np.full(-(len(samples) - 128) % 64, 128.0)))
    peaks, k = [], np.arange(128)
    for i in range(0, len(x) - 127, 64):
        frame = ((x[i : i + 128] - np.float32(x[i : i + 128].mean())) * np.hanning(128)).astype(np.float32)
        size = [round(abs(sum(frame * np.exp(-2j * np.pi * k * b / 128))), 3) for b in range(1, 65)]
        best = sorted(range(64), key=lambda b: (-size[b], b))[:2]
        peaks.append([b + 1 for b in best if size[b] > sum(size) / 64])
    return sorted((i << 24) | (a << 16) | (b << 8) | g for i in range(len(peaks)) for g in (1, 2, 3) if i + g < len(peaks) for a in peaks[i] for b in peaks[i + g])


def test_landmarks_equal_direct_sums(spark):
    rng = np.random.default_rng(4)
    t = np.arange(960)
    clips = [bytes((128 + 60 * np.sin(2 * np.pi * a * t / 8000) + 50 * np.sin(2 * np.pi * b * t / 8000 + 1)).astype(np.uint8)) for a, b in rng.integers(300, 3700, (6, 2))]
    df = spark.createDataFrame([(i, media.to_wav(c), "x") for i, c in enumerate(clips)] + [(99, None, "y")], "doc_id long, media binary, row string")
    got = {r.doc_id: r.landmarks for r in media.with_fingerprints(df).collect()}
    assert got.pop(99) is None
    assert got == {i: brute_landmarks(np.frombuffer(c, np.uint8)) for i, c in enumerate(clips)}
    assert media.summaries(media.with_fingerprints(df)).where("doc_id = 99").first()["read"].feature is None


# ---- 10 ----


def test_rollup_commits_are_idempotent(spark, tmp_path):
    docs = [(i, None if i % 4 == 0 else f"s{i % 3}", "en", f"w {'x ' * i}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    one = rollup.image(F.col("source"), F.col("lang"), "words-1", rollup.token_count(F.col("text"), "words-1"))
    two = rollup.image(F.col("source"), F.col("lang"), "alnum-2", F.col("doc_id"))
    null = F.lit(None).cast("struct<source: string, lang: string, tokenizer: string, n_tokens: bigint>")
    sums = rollup.Rollup(spark, f"{tmp_path}/r")
    assert sums.totals().collect() == [] and sums.version() == 0
    sums.commit("a", df.select(null.alias("before"), one.alias("after")))
    for again in range(2):
        (tmp_path / "r" / "version=99").mkdir(exist_ok=True)  # an attempt that failed
        assert sums.commit("a/b:c", df.where("doc_id < 5").select(one.alias("before"), null.alias("after"))) is not bool(again)
        sums.commit("c", df.where("doc_id >= 15").select(one.alias("before"), two.alias("after")))
    sums.commit("d", df.limit(0).select(one.alias("before"), null.alias("after")))
    want = collections.Counter()
    for i, s, _, t in docs[5:]:
        key = (s, "en", "alnum-2" if i >= 15 else "words-1")
        want[key, 0] += 1
        want[key, 1] += i if i >= 15 else len(t.split())
    got = {((r.source, r.lang, r.tokenizer), k): v for r in sums.totals().collect() for k, v in enumerate((r.n_docs, r.n_tokens))}
    assert got == dict(want) and sums.version() == 4


def test_counts_by_tokenizer_files_equal_the_libraries(odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, (ranks, own) = Tokenizer.from_file(path), reference_encoding()
    counts = (rollup.counted(path)("text"), rollup.counted(ranks, public_tokenizers.PATTERN)("text"))
    got = odd.select("text", *(c.alias(f"n{i}") for i, c in enumerate(counts))).collect()
    assert all(r.n0 == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n1 == len(own.encode_ordinary(r.text or "")) for r in got)
    assert empty.select(counts[0]).count() == 0


@pytest.mark.parametrize("name", ["op10_token_rollups", "token_rollups_by_pattern"])
def test_rollups_of_the_documents(spark, sf, docs, name):
    from tokenizers import Tokenizer

    library, (_, own) = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), reference_encoding()
    words = lambda p: lambda t: len(re.findall(p, t))
    count = {
        "op10_token_rollups": (("byte_bpe_50k", lambda t: len(library.encode(t, add_special_tokens=False).ids)), ("byte_bpe_multi_50k", lambda t: len(own.encode_ordinary(t)))),
        "token_rollups_by_pattern": (("words-1", words(common.SPACE_WORD)), ("alnum-2", words("[A-Za-z0-9]+"))),
    }[name]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    want = collections.Counter()
    for r in docs.collect():
        if r.doc_id not in toxic:
            version, of = count[r.lang == "en"]
            want[(r.source, r.lang, version), 0] += 1
            want[(r.source, r.lang, version), 1] += of(r.text or "")
    got = {((r.source, r.lang, r.tokenizer), k): v for r in queries.queries()[name](spark, sf).collect() for k, v in enumerate((r.n_docs, r.n_tokens))}
    assert got == dict(want)


# ---- all ----


def test_every_operator_has_a_query():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries.queries()) == 1


def test_hashing_words_takes_little_room():
    texts = [f"word{k % 977} Other{k}x é{k % 31}".encode() for k in range(100_000)]
    tracemalloc.start()
    try:
        words = suffix_arrays.Words(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    few = suffix_arrays.Words(texts[-50:])
    assert (words.hash[-len(few.hash) :] == few.hash).all()
    assert peak < 20 * sum(map(len, texts))


def test_counts_are_those_of_the_ids():
    own = token_blocks.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pa.array([None, "", "a b  c", "one two three one", "\tx \n y", "é ü " * 50])
    assert own.counts(texts).tolist() == own.ids(texts)[1].tolist()
    assert own.counts(texts.slice(0, 0)).tolist() == []
