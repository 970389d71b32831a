import base64
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
import zstandard
from pyspark.sql import functions as F

from nearfield.llm import compression, extraction, pii
from nearfield.llm.common import table
from tests.oracle import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)


# --- identifiers


def brute_identifiers(text):
    """Places by independent expressions, for texts without odd signs around tokens."""
    out = []
    for kind, pattern in (("email", r"[\w.]+@[\w.]+\.com"), ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"), ("card", r"(?<!\w)\d{16}(?!\w)"), ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("secret", r'(?<=token = ")[0-9a-f]{40}')):
        for m in re.finditer(pattern, text, re.I):
            value = m[0].lower()
            if kind == "card" and not pii._luhn(value) or kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            out.append((kind, value, m.start()))
    return out


def test_identifiers_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {(r.doc_id, *x) for r in docs.select("doc_id", "text").collect() for x in brute_identifiers(r.text) if not re.search(r"[#$%&*|!]{2}", r.text)}
    got = pii.extract(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(want) > 50 and want <= {(r.doc_id, r.kind, r.value, r.begin) for r in got}
    assert all(texts[r.doc_id][r.begin : r.end].lower() == r.value for r in got if not re.search(r"[#$%&*|!]{2}", texts[r.doc_id]))


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(1)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'x token = "{token()}" y') for i in range(20)] + [(100, f"here {token()} is one"), (101, "order 1234567812345678 of 2024, version 3.1")]
    got = {(r.doc_id, r.kind, r.score < 1) for r in pii.extract(frame(spark, rows)).collect()}
    assert got == {(i, "secret", False) for i in range(20)} | {(100, "secret", True)}
    few = frame(spark, rows[:3] + rows[-2:])
    assert {r.doc_id for r in pii.extract(few).collect()} == {0, 1, 2}


@pytest.mark.parametrize(("text", "want"), [
    ("mail A.B@Mail.example.COM, now", [("a.b@mail.example.com", "email")]), ("at 1.2.3.4.", [("1.2.3.4", "ip")]), ("at 1.2.3.400", [("1.2.3.400", None)]),
    ("call +1 (017) 555-7713.\nNext", [("+1 (017) 555-7713", "phone")]), ("call +1%%% (017)### 555-7713$$$ x", [("+1 (017) 555-7713", "phone")]),
    ("4539578763621486", [("4539578763621486", "card")]), ("4539578763621487", [("4539578763621487", None)]), ("@ - (", []), ("", []), ("a1", [("a1", None)]),
])
def test_mentions(text, want):
    assert [(m[2], m[3]) for m in pii.mentions(text)] == want


HEX = "0123456789abcdef" * 2 + "89abcdef"


@pytest.mark.parametrize(("text", "want"), [
    ("at 10.0.0.1:8080 now", [("10.0.0.1", "ip")]), ("a@x.com,b@y.com", [("a@x.com", "email"), ("b@y.com", "email")]), ("<mailto:A@b.com>", [("a@b.com", "email")]),
    (f'set token="{HEX}".', [(HEX, "secret")]), ("4539-5787-6362-1486", [("4539-5787-6362-1486", "card")]), ("pay 4539 5787 6362 1486, then", [("4539 5787 6362 1486", "card")]),
    ("call 555-123-4567.", [("555-123-4567", "phone")]), ("4539 5787 6362 1487", []), ("4539-5787-6362-1487", []), ("at 12:30, 1,234,567", []),
])
def test_several_identifiers_in_a_token(text, want):
    got = list(pii.mentions(text))
    assert [(m[2], m[3]) for m in got if m[3]] == want
    assert all(text[m[0] : m[1]].lower() == m[2] for m in got)


@pytest.mark.parametrize("piece", ["7 ", "7\n", "12345\n", "!", "a@", "(", "a1", "+1 ", "1,", "x", " \n", "@ ", "1234 5678 ", "4539 5787 6362 1486\t", "$ "])
def test_mentions_take_time_in_proportion(piece):
    text = piece * ((1 << 17) // len(piece)) + "\nat 1.2.3.4"
    began = time.process_time()
    found = list(pii.mentions(text))
    assert time.process_time() - began < 10 and found[-1][2:4] == ("1.2.3.4", "ip")


def test_rounds_go_on_until_nothing_is_new(spark):
    """A chain: each pattern's instances make the next pattern good enough, far beyond a handful of rounds."""
    rows, steps = [], 12
    for i in range(9):
        rows.append((f"seed{i}", "email", False, ["p0"]))
    for step in range(steps):
        for i in range(2):
            rows.append((f"x{step}-{i}", None, False, [f"p{step}", f"p{step + 1}"]))
        for i in range(9 if step < steps - 1 else 0):
            rows.append((f"more{step}-{i}", "email", False, [f"p{step + 1}"]))
    rows.append(("no", None, True, [f"p{steps}"]))
    found = spark.createDataFrame(rows, "instance string, seed string, refuted boolean, patterns array<string>")
    known = {r.instance: r.kind for r in pii.bootstrap(found).collect()}
    assert known == {r[0]: "email" for r in rows if not r[2]}


def test_identifiers_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "to a@b.com"), (3, "to a@b.com"), (3, "to a@b.com"), (4, "word " * 40_000 + "9.9.9.9"), (5, "7" * 50_000)]
    docs = frame(spark, rows).withColumn("instance", F.lit("x"))
    got = sorted(((r.doc_id, r.kind, r.begin) for r in pii.extract(docs).collect()), key=str)
    assert got == sorted([(None, "email", 3), (3, "email", 3), (3, "email", 3), (4, "ip", 200_000)], key=str)
    assert pii.extract(docs.limit(0)).count() == 0


# --- pages


class _Articles(HTMLParser):
    """All words within the article, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.words += data.split()


def test_pages(spark):
    pages = table(spark, SF, "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    assert len(got) == len(html)
    same = 0
    for i, page in html.items():
        brute = _Articles()
        brute.feed(page)
        same += Counter(brute.words) == Counter(got[i].text.split())
    assert same >= 0.9 * len(html)


P = "This is a sentence of some length, with commas, and more words so that it counts. "


@pytest.mark.parametrize(("html", "has", "lacks"), [
    (f"<body><div class=sidebar><p>{P * 5}</p></div><div><p>{P}</p><p>{P}Second</p></div></body>", ["Second"], []),
    (f"<div><ul><li><a href=x>{P * 3}</a></ul></div><div id=m><p>{P}main</p><p>short.</p></div>", ["main", "short."], []),
    (f"<article><p>{P}one<p>{P}two<script>var a = '<p>no</p>'</script></article><footer>foot {P}</footer>", ["one", "two"], ["no", "foot"]),
    ("<p>a &amp; b &lt;c&gt;", ["a & b <c>"], []), ("plain", ["plain"], []), ("", [], []), ("<div " + "<" * 500 + '"', [], []), ("<div>" * 3000 + P + "</div>" * 3000, ["sentence"], []), ("</p></div>>x", ["x"], []),
])
def test_markup(html, has, lacks):
    _, text, _ = extraction.extract_text(html)
    assert all(x in text for x in has) and not any(x in text for x in lacks)


@pytest.mark.parametrize("html", [
    *[f'<{tag} class="{name}"><div><p>{P}one</p><p>{P}two</p></div></{tag}>' for tag in ("body", "main", "article") for name in ("home has-sidebar wide", "ast-right-sidebar", "nav-open")],
    f'<body><div id=page class="has-sidebar"><p>{P}one</p><p>{P}two</p></div></body>', f'<body><a href="#x">Skip</a><div class="nav-open"><p>{P}one</p><p>{P}two</p></div></body>',
])
def test_names_never_hide_the_whole_page(html):
    _, text, score = extraction.extract_text(html)
    assert "one" in text and "two" in text and score > 0


@pytest.mark.parametrize("html", [
    f'<body class="single has-sidebar"><p>{P}one</p><p>{P}</p><p>{P}two</p></body>', f'<body><form id="aspnetForm"><div><p>{P}one</p><p>{P}two</p></div></form></body>',
    f'<div id="content" class="no-comments"><p>{P}one</p><p>{P}two</p></div>', f'<form><nav>menu</nav><aside class="ad"><p>{P}one</p><p>{P}two</p></aside></form>',
    f'<head><title>t<body><div><p>{P}one</p><p>{P}two</p></div>', f'<html><head><meta charset=x><p>{P}one</p><p>{P}two</p>', f'<svg><p>{P}one</p><p>{P}two</p>',
])
def test_wrappers_never_hide_the_page(html):
    _, text, score = extraction.extract_text(html)
    assert "one" in text and "two" in text and "menu" not in text and score > 0


@pytest.mark.parametrize(("html", "want"), [
    (f'<p>{P}<a href="x>link</a> more</p>', P + "link more"), (f'<p>{P}<a href="x>link</a> and <b class="y">bold</b></p>', P + "link and bold"),
    (f'<p>{P}<a title="a > b" href=y>link</a></p>', P + "link"), (f"<p>{P}<b class=x don't>it</b> isn't", P + "it isn't"), (f"<p>{P}<a href='", P.strip()),
    (f"<p>{P}</p><!-- no end <p>gone", P.strip()), (f"<p>{P}1 < 2 <3 and </>x</ p>y", P + "1 < 2 <3 and xy"), (f"<p>{P}</p><script>var a = '</p>'; <b>", P.strip()),
])
def test_broken_tags_leak_nothing(html, want):
    assert extraction.extract_text(html)[1] == want


@pytest.mark.parametrize("piece", ["<a x ", '<a x="', "<a x='>", "<a x=\"'", "</p ", "<div>", "</div>", "<p></b>", "<!--", "<!-- -", "<? ", "<", "</", "<title>", "<svg>", "</script ", "&amp", "<a<", "= ", "<ul><li>", '<p class="', "\n\n", "<table>"])
def test_broken_markup_takes_time_in_proportion(piece):
    for start in ("", "<script>", '<p class="x">'):
        page = start + piece * ((1 << 18) // len(piece))
        began = time.process_time()
        extraction.extract_text(page)
        assert time.process_time() - began < 5


def test_scores_by_hand():
    own = P.strip()
    points = 1 + own.count(",") + len(own) / 100
    html = f"<body><div><p>{P}</p><p>{P}</p></div></body>"
    assert abs(extraction.extract_text(html)[2] - 2 * points) < 1e-6
    linked = f"<body><div><p>{P}</p><p>{P}</p><a>{P.strip()}</a></div></body>"
    size = 3 * len(own)
    assert abs(extraction.extract_text(linked)[2] - (2 * points + (points * 0)) * (1 - len(own) / size)) < points


def test_pages_of_odd_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (None, f"<p>{P}", "u"), (3, "x" * 300_000, "u"), (3, "x" * 300_000, "u")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, title string")
    got = sorted(((r.page_id, r.title, len(r.text or ""), r.score is None) for r in extraction.extract(pages).collect()), key=str)
    assert got == sorted([(1, None, 0, True), (2, "", 0, False), (None, "", len(P.strip()), False), (3, "", 300_000, False), (3, "", 300_000, False)], key=str)
    assert extraction.extract(pages.limit(0)).count() == 0


# --- compression


def brute_dictionary(texts, size=compression.DICTIONARY_BYTES):
    counts = Counter(w for t in texts if t for w in t.split())
    rows = sorted(((-(n - 1) * len(w.encode()), w) for w, n in counts.items() if n > 1 and len(w.encode()) >= 2))
    out, used = [], 0
    for _, w in rows:
        if used + len(w.encode()) + 1 > size:
            break
        out.append(w.encode() + b" ")
        used += len(out[-1])
    return b"".join(reversed(out))


def brute_size(text, content):
    prefix = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prefix.precompute_compress(level=3)
    packed = zstandard.ZstdCompressor(level=3, dict_data=prefix, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text)
    assert zstandard.ZstdDecompressor(dict_data=prefix).decompress(packed, max_output_size=len(text)) == text
    return len(packed)


def test_compression_scores(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    domain, general = brute_dictionary([rows[i] for i in sorted(good) if i in rows]), brute_dictionary(rows.values())
    for r in compression.compression_scores(docs, labels).collect():
        a, b = (brute_size(rows[r.doc_id].encode(), c) for c in (domain, general))
        assert (r.domain_bytes, r.general_bytes) == (a, b) and abs(r.score - (b - a) / b) < 1e-12


def test_compression_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "free text here"), (3, "alpha beta gamma " * 20_000), (3, "alpha beta gamma " * 20_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = sorted(((r.doc_id, r.domain_bytes, r.score) for r in compression.compression_scores(docs, labels).collect()), key=str)
    assert [g[0] for g in got] == sorted([1, 2, None, 3, 3], key=str)
    assert (1, None, None) in got and (2, 0, 0.0) in got
    assert compression.compression_scores(docs, labels.limit(0)).count() == 5
    assert compression.compression_scores(docs.limit(0), labels).count() == 0


def test_long_words_leave_room_for_others(spark):
    blob = "".join(random.Random(1).choices("abcdefghijklmnop", k=70_000))
    texts = [*[f"hello {blob} world"] * 3, *["hello world again"] * 300, "漢字仮名" * 100, "漢字仮名" * 100]
    content = compression.dictionary(compression.word_counts(frame(spark, list(enumerate(texts)))))
    words = content.decode().split()
    assert {"hello", "world", "again"} <= set(words) and max(map(len, words)) <= compression.WORD


def test_long_texts_use_the_dictionary_all_along(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(4000)]
    content = " ".join(words).encode()
    part = " ".join(rng.sample(words, 400))
    noise = base64.b64encode(rng.randbytes(3 << 20)).decode()
    near, far = compression.compressor(content), compression.compressor(b"")
    def gain(text):
        return compression.compressed_size(text.encode(), far) - compression.compressed_size(text.encode(), near)
    assert gain(noise + part) - gain(noise) > 0.6 * gain(part)


def test_dictionary_grows_with_the_corpus(spark):
    """Rare words of a large vocabulary are in the dictionary, and of use wherever they are in it."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(40_000)]
    counts = spark.createDataFrame([(w, 2 + (i < 20_000)) for i, w in enumerate(words)], "word string, n bigint")
    content = compression.dictionary(counts)
    held = set(content.decode().split())
    saved = sum((2 if i < 20_000 else 1) for i, w in enumerate(words) if w in held)
    assert saved >= 0.9 * 60_000 and len(content) > compression.DICTIONARY_BYTES
    near, plain = compression.compressor(content), compression.compressor(b"")
    for part in (words[:2000], words[10_000:12_000]):
        text = " ".join(rng.sample(part, 1500)).encode()
        assert len(near.compress(text)) < 0.6 * len(plain.compress(text))
    assert compression.dictionary(counts.limit(100)) == compression.dictionary(counts.limit(100), share=0.0)
