"""Corpus operators against plain Python on a small fixture with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import time
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from proofmill.llm import bpe, common, decontaminate, html, license, lines, near, quality, substring, toxicity
from proofmill.llm.queries import vocabulary_path

rnd = random.Random(3)
VOCAB = ["the", "of", "and", "tion", "Über", "été", "ner", "stan", "ble", "ing", "wh", "ea", "ont", "ly", "re", "漢字", "x1", "9"]


def prose(n):
    return " ".join(rnd.choice(VOCAB) + rnd.choice(["", "", "a", "er", "."]) for _ in range(n))


def edited(text, every):
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


BASE = prose(120)
ITEM = prose(30)
TEXTS = (
    [BASE, BASE, edited(BASE, 60), edited(BASE, 7), None, "", " \n\t ", "one", "one two three", "aaaa" * 60, "aaaa" * 50, "y" * 49, "y" * 50]
    + ["\n".join([prose(30), "Contact line %d of the site" % i, "All rights reserved.", prose(25)]) for i in range(14)]
    + [prose(40) + " " + ITEM.upper() + " " + prose(20), prose(900) + "\n" + " ".join(ITEM.split()[4:19]), prose(20) + "\n" + BASE[100:400] + "\n" + prose(20)]
    + ["word*** " * 60, "BIG!! NEWS!! " * 40, "Licensed under the Apache License, Version 2.0.\n" + prose(60), prose(60) + "\nLicensed under some other terms of ours."]
    + ["<|endoftext|> ΑΣ İ ﬁ ́e don't 12345   x", prose(3000), "Is it so.\n" * 300]
)
ROWS = [(i, t, "extra") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + [(None, "a row without an id " * 20, "extra")], "doc_id long, text string, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- 1 --------------------------------------------------------------------------------------------


def shingles(t):
    w = plain_words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: top(i) for i in ids}


def test_near(docs, empty):
    got = {i: r["class_id"] for i, r in by_id(near.near_duplicates(docs)).items()}
    assert got.pop(None) is None
    assert got == classes([(i, t) for i, t, _ in ROWS])
    assert got[1] == got[2] == 0 and got[3] == 3
    assert near.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("pivots", [16, 1])
def test_near_large_cluster(spark, monkeypatch, pivots):
    """A cluster of many blocks, most pairs of which are no link; with few pivots most links come last."""
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "PIVOTS", pivots)
    rows = [(i, edited(BASE, rnd.randint(6, 40)) if i else BASE) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_repeated_ids(spark):
    """A doc_id with two texts holds the classes of both together; a pair of the second text is not lost."""
    a, b = prose(60), prose(60)
    rows = [(5, a), (5, b), (7, a + " tail"), (8, b + " tail"), (9, prose(60)), (9, ""), (9, None), (1, ""), (9, rows_ := prose(30)), (9, rows_)]
    got = [tuple(r) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1)] + [(5, 5)] * 2 + [(7, 5), (8, 5)] + [(9, 9)] * 5
    got = near.near_duplicates(spark.createDataFrame([(1, b), (5, a), (5, b)], "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (5, 1)}


def test_sketch_estimates_probability_jaccard():
    a, b = prose(400), None
    b = " ".join(a.split()[:300] + prose(100).split())
    held, sizes = near.sketch([a, b, ""], 512)
    x, y = shingles(a), shingles(b)
    assert abs((held[0] == held[1]).mean() - len(x & y) / len(x | y)) < 0.1 and sizes[2] == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(path, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# -- 2 --------------------------------------------------------------------------------------------


def plain_lines(rows, min_docs=10):
    """Dropped lines of each row of (doc_id, text), by the rules of the module, in plain Python."""

    def token(w):
        return lines.FIELD if re.search("[0-9]", w) else w

    tmpl = {t: [tuple(map(token, plain_words(x))) for x in t.split("\n")] for _, t in rows if t is not None}
    have = {t: {x for x in ls if x} for t, ls in tmpl.items()}
    docs_of, leaf = {}, {}
    for t, ls in have.items():
        for x in ls:
            docs_of.setdefault(x, set()).add(t)
    often = {x for x, d in docs_of.items() if len(d) >= min_docs}
    for x in docs_of.keys() - often:
        leaf.setdefault((len(x), x[: lines.DEPTH]), []).append(x)
    open_ = {}
    for xs in leaf.values():
        if len(xs) > 1 and sum(len(docs_of[x]) for x in xs) >= min_docs and len(xs[0]) >= lines.LEAST:
            for x in xs:
                n, k = len(x), lines.DEPTH
                for a, b in itertools.combinations(range(lines.BANDS), 2):
                    fast = tuple(w for i, w in enumerate(x) if i < k or lines.BANDS * (i - k) // (n - k) not in (a, b))
                    open_.setdefault((n, a, b, fast), set()).add(x)
    open_ = {c: xs for c, xs in open_.items() if len({t for x in xs for t in docs_of[x]}) >= min_docs}
    clusters = [{x} for x in often] + list(open_.values())
    shared = set().union(*clusters)

    def speaks(t, cluster):
        total, own = sum(map(len, have[t])), sum(len(x) for x in have[t] - shared)
        return own > 0 and (2 * own >= total - sum(len(x) for x in have[t] & cluster) or len(have[t] & shared) <= lines.FEW)

    gone = {x for c in clusters if sum(speaks(t, c) for t in {t for x in c for t in docs_of[x]}) >= min_docs for x in c}
    return {i: [x in gone for x in tmpl[t]] if t is not None else [] for i, t in rows}


def check_lines(spark, rows):
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "n_lines", "n_dropped", "kept_text"))
    for (i, t), gone in zip(rows, plain_lines(rows).values(), strict=True):
        if t is not None:
            kept = "\n".join(x for x, g in zip(t.split("\n"), gone, strict=True) if not g)
            assert (got[i]["kept_text"], got[i]["n_lines"], got[i]["n_dropped"]) == (kept, len(gone), sum(gone)), i
    return [got[i]["n_dropped"] for i, _ in rows]


def test_lines(spark, docs, empty):
    got = {r["doc"]["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    for i in range(13, 27):
        t = TEXTS[i].split("\n")
        assert got[i]["kept_text"].split("\n") == [t[0], t[3]], i
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (4, 2)
    assert got[4]["kept_text"] is None and got[4]["n_lines"] == 0 and got[0]["kept_text"] == BASE
    assert got[0]["doc"]["key"] == "extra" and lines.dedup_lines(empty).count() == 0
    check_lines(spark, [(i, t) for i, t, _ in ROWS])


NAMES = ["anna", "bert", "cleo", "dora", "emil", "fritz", "gerd", "hugo", "ida", "jan", "karl", "lena"]


def test_lines_generalise_varying_words(spark):
    rows = [(i, prose(30) + f"\nThis page was made by {n} at the office") for i, n in enumerate(NAMES)]
    assert check_lines(spark, rows) == [1] * len(NAMES)


def test_lines_hold_several_clusters_in_a_leaf(spark):
    """Two templates of equal weight, and unrelated prose, share token count and leading tokens."""
    rows = [(i, prose(30) + f"\nPosted by the {n} in the evening of") for i, n in enumerate(NAMES)]
    rows += [(20 + i, prose(30) + f"\nPosted by the group on {n} wall again") for i, n in enumerate(NAMES)]
    rows += [(40 + i, prose(30) + "\nPosted by the " + prose(5)) for i in range(30)]
    assert check_lines(spark, rows)[:24] == [1] * 24


def test_lines_drop_from_short_pages_too(spark):
    """A line of six words shared by pages with four words of their own goes; so does a long one."""
    rows = [(i, f"{n} has own words\nfollow us on all the channels") for i, n in enumerate(NAMES)]
    assert check_lines(spark, rows) == [1] * len(NAMES)
    rows = [(i, f"{n} has own words\n" + BASE) for i, n in enumerate(NAMES)]
    assert check_lines(spark, rows) == [1] * len(NAMES)


def test_lines_ties(spark):
    """Of pages with three recurring lines, own lines of exactly half the words beside a cluster speak for it; one word less does not."""
    rows = [(i, f"{n} has six words of its\nalpha beta gamma\ndelta eps zeta\neta theta iota") for i, n in enumerate(NAMES)]
    assert check_lines(spark, rows) == [3] * len(NAMES)
    assert check_lines(spark, [(i, t.replace("has six", "has")) for i, t in rows]) == [0] * len(NAMES)
    assert check_lines(spark, rows[: lines.MIN_DOCS - 1]) == [0] * (lines.MIN_DOCS - 1)


def test_lines_of_short_pages_with_a_menu_and_a_footer(spark):
    menu, foot = "home news sport maps mail shop jobs help about contact", "all rights are with us since the day we began"
    rows = [(i, f"{menu}\n{prose(4)} w{chr(97 + i % 26)}{chr(97 + i // 26)}\n{foot}") for i in range(60)]
    assert check_lines(spark, rows) == [2] * 60


def test_lines_of_near_copies_are_no_templates(spark):
    """Copies with a line of their own keep their text, but lose what other documents show to be boilerplate."""
    copies = [(i, BASE.replace(". ", ".\n") + f"\nown words {n}\nall rights are with us") for i, n in enumerate(NAMES)]
    assert set(check_lines(spark, copies)) == {0}
    others = [(20 + i, prose(40) + "\nall rights are with us") for i in range(12)]
    assert check_lines(spark, copies + others) == [1] * 24


# -- 3 and 8 --------------------------------------------------------------------------------------

ALPHABET = list("aAbB zZ  \n\t'sRE.,!?0123") + list("ßİΣσςéÉÜñ́ 　\u0085\x1c​漢字😀ǅ²½Ⅷ٠कि")
STRANGE = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 80))) for _ in range(400)] + ["<|endoftext|>a<|startoftext|><|endoftext|>", "a" * 5000, "ab" * 3000, " " * 70 + "x"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def test_every_code_point_as_the_library_has_it():
    xs = [f"a{chr(c)}b{chr(c)}1" for c in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200), 0x10FFFF]]
    for name, own in (("byte_bpe_50k.json", lambda p: bpe.RankSynchronousCounter(p).count(xs)), ("word_bpe_49k.json", lambda p: [g[1] for g in bpe.WordEncoder(p).encode(xs)])):
        want = [e.ids for e in library(name).encode_batch(xs, add_special_tokens=False)]
        want = [len(w) for w in want] if name.startswith("byte") else [" ".join(map(str, w)) for w in want]
        got = own(vocabulary_path(name))
        assert [hex(ord(x[1])) for x, a, b in zip(xs, got, want, strict=True) if a != b] == []


def test_long_words():
    """Words without a space of 40,000 bytes and more: equal to the library, in a second or two."""
    words = ["".join(rnd.choices("abcdefgh", k=40_000)), "ab" * 40_000, "漢字仮名交" * 8_000, "z" * 513]
    for name, own in (("byte_bpe_50k.json", lambda p: bpe.RankSynchronousCounter(p).count(words)), ("word_bpe_49k.json", lambda p: [g[0] for g in bpe.WordEncoder(p).encode(words)])):
        began = time.process_time()
        got = own(vocabulary_path(name))
        assert got == [len(library(name).encode(x, add_special_tokens=False).ids) for x in words]
        assert time.process_time() - began < 20


def test_token_counts(docs, empty):
    t, path = library("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.json")
    assert bpe.RankSynchronousCounter(path).count(STRANGE) == [len(t.encode(x, add_special_tokens=False).ids) for x in STRANGE]
    for i, r in by_id(bpe.token_counts(docs, path)).items():
        if i is not None:
            text = TEXTS[i] or ""
            n = len(t.encode(text, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert bpe.token_counts(empty, path).count() == 0


def test_round_trip(docs, empty):
    t, path = library("word_bpe_49k.json"), vocabulary_path("word_bpe_49k.json")
    for x, (n, ids, said) in zip(STRANGE, bpe.WordEncoder(path).encode(STRANGE), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert (n, ids, said) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False))
    for i, r in by_id(bpe.encode_decode(docs, path, keep_text=True)).items():
        if i is not None:
            want = t.encode(TEXTS[i] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


# -- 4 --------------------------------------------------------------------------------------------

ITEMS = [(1, ITEM), (2, "One"), (3, None), (4, "..."), (5, "three stan"), (6, " ".join(ITEM.split()[:13])), (10, prose(13)), (None, "the")]


def bench_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(rows, items):
    """(hit words, items met) of each doc_id, over every place of every text."""
    windows, out = {}, {}
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for i, t in rows:
        w, hit, met = bench_words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and (own := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    met |= own
        out[i] = len(hit), met
    return out


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    want = plain_contamination([(i, t) for i, t, _ in ROWS], ITEMS)
    for i, t, _ in ROWS:
        w, hit, items = len(bench_words(t)), *want[i]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (w, hit, sorted(items)), i
        assert r["contaminated"] == (hit > 0 and 20 * hit >= w)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


# -- 5 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=/>x</a></nav><div class='ad'>buy</div><article><h1>A &amp;amp; B</h1><p><b>one\n two<br>three<p>f&ouml;ur</article><footer>c</footer></body></html>", "A &amp; B\n\none two three\n\nföur"),
        ("<main><p>a</p><form>f<input></form><!-- no <p>z</p> --><aside>s</aside><section id=comments><p>c</p></section><p>b</p></main>", "a\n\nb"),
        ("<body><div id='cookie-notice'>we use cookies</div><ul class=menu><li>m</ul><p>" + "long text " * 20 + "</p><p>short</p><div class=sidebar>x</div></body>", ("long text " * 20).strip() + "\n\nshort"),
        ("plain < text & no markup, but of a length that a reader would take for text", "plain < text & no markup, but of a length that a reader would take for text"),
    ],
)
def test_html(page, text):
    assert html.extract(page) == text


BODY = ["A paragraph of the body that is long enough to be taken for text, number %d." % i for i in range(4)]


@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_html_teasers_beside_a_body(tag):
    """Cards or a stub in the marked element do not silence the text in plain blocks, with or without the tag."""
    cards = "".join(f"<{tag}><h3><a href=/{i}>A linked headline of some other page of this site</a></h3><p>Read on</p></{tag}>" for i in range(3))
    body = "<div>" + "".join(f"<p>{t}</p>" for t in BODY) + "</div>"
    for page in (cards + "<div></div>" * 3 + body, body + "<div></div>" * 3 + cards):
        assert html.extract(f"<body>{page}</body>") == "\n\n".join(BODY)


def test_html_outside_a_full_article():
    """A long run outside surges too, a short line there does not; the article keeps its short lines."""
    inside = "".join(f"<p>{t}</p>" for t in BODY * 4) + "<p>End.</p>"
    run = "".join(f"<p>{t} {t}</p>" for t in BODY)
    got = html.extract(f"<body><div>All about us</div><article>{inside}</article><div>Filed under news</div><div>{run}</div></body>")
    assert got.split("\n\n")[:17] == [*BODY * 4, "End."] and got.split("\n\n")[-4:] == [f"{t} {t}" for t in BODY]
    assert "All about us" not in got


@pytest.mark.parametrize("wrapper", ["content with-sidebar", "has-comments", "no-sidebar", "page header-fixed", "elementor-widget-text", "right-sidebar"])
def test_html_layout_wrappers(wrapper):
    """A wrapper named after chrome holds the article; real chrome inside it still goes."""
    body = "".join(f"<p>{t}</p>" for t in BODY * 3)
    got = html.extract(f"<body><div class='{wrapper}'><div>{body}</div><div class='sidebar-left'><p>{BODY[0]} beside</p></div></div></body>")
    assert got.split("\n\n") == BODY * 3


@pytest.mark.parametrize("page", ["<p class='notice'>By the way{}", "<ul><li class='ad'>Buy<li>One</ul>{}", "<table><tr><td class='ad'>Buy<tr><td>{}</table>", "<dl><dd class='promo'>Buy<dt>Term</dl>{}"])
def test_html_end_tags_left_out(page):
    got = html.extract("<article>" + page.format("".join(f"<p>{t}" for t in BODY)) + "</article>").split("\n\n")
    assert [t for t in got if t not in ("One", "Term")] == BODY


def test_html_keeps_the_heading_and_a_page_without_head_end():
    text = "".join(f"<p>{t}" for t in BODY)
    assert html.extract(f"<head><title>T</title><body><article><div class='entry-header'><h1>Name</h1></div>{text}</article>").split("\n\n") == ["Name", *BODY]


class PlainLines(HTMLParser):
    """An independent reading of well-formed pages: (text, inside the article) of each block, None at what is no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.words, self.skipped, self.inside = [], [], [], 0

    def cut(self):
        text = " ".join("".join(self.words).split())
        self.lines += [(text, self.inside > 0)] if text else []
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            self.words.append(" " if tag == "br" else "")
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        parts = set(re.findall("[a-z]+", named))
        gone = tag in html.DROPPED or (tag == "header" and not self.inside) or (tag not in ("html", "body", "main", "article") and parts & html.CHROME)
        if tag in html.BLOCKS or gone:
            self.cut()
        if self.skipped or gone:
            self.skipped.append(tag)
        self.inside += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in html.BLOCKS:
            self.cut() if not self.skipped else self.words.clear()
        self.inside -= tag in ("article", "main")
        if self.skipped and tag in self.skipped:
            while self.skipped.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skipped:
            self.words.append(data)


def test_html_equals_a_plain_reading(spark):
    """On pages whose article is whole and marked, the distribution keeps what a plain reading of the article gives."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = 0
    for page in pages:
        p = PlainLines()
        p.feed(page)
        p.close()
        p.cut()
        same += html.extract(page) == "\n\n".join(t for t, inside in p.lines if inside)
    assert same == len(pages)


def test_html_the_distribution_decides(spark):
    """On pages whose article is right, a narrower window or a higher surge loses lines of it; and it is
    found without its element's name."""
    pages = [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    lines = [html.stripped(p) for p in pages]
    kept = [html.between_surge_and_dive(x) for x in lines]
    article = [[text for text, _, inside, _ in x if inside and text] for x in lines]
    assert kept == article
    for window in (2, 3, 4):
        other = [html.between_surge_and_dive(x, window) for x in lines]
        assert other != kept and all(set(a) <= set(b) for a, b in zip(other, kept, strict=True))
    for surge in (200, 400):
        assert [html.between_surge_and_dive(x, surge=surge) for x in lines] != kept
    unnamed = [html.between_surge_and_dive(html.stripped(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p))) for p in pages]
    size = lambda rows: sum(len(t) for x in rows for t in x)
    assert size(unnamed) <= size(article) and size(unnamed) > 0.98 * size(article)


def test_html_short_pages_and_lonely_lines():
    assert html.extract("<body><div>Short one.</div><div>Tiny.</div></body>") == "Short one.\n\nTiny."
    lonely = "<div>All of it</div>" + "<div></div>" * 3
    assert html.extract(f"<body>{lonely}<div>{''.join(f'<p>{t}</p>' for t in BODY)}</div></body>").split("\n\n") == BODY


HOSTILE = {
    "no end of tag": "<a b " * 200_000,
    "hidden ends": '<a ">" ' * 150_000,
    "open quotes": '<a "' * 250_000,
    "open comments": "<!--" * 250_000,
    "open cdata": "<![CDATA[>" * 100_000,
    "deep": "<div>" * 200_000 + "x",
    "items behind walls": "<li><ul>" + "<div>" * 100_000 + "<li></li>" * 50_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_hostile_pages_take_linear_time(name):
    began = time.process_time()
    html.extract(HOSTILE[name])
    assert time.process_time() - began < 5


def test_html_comment_articles():
    text = "".join(f"<p>{t}</p>" for t in BODY)
    got = html.extract(f"<main><article class='post'>{text}</article><article class='comment'><p>I think so too</p></article></main>")
    assert got.split("\n\n") == BODY


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>äb</p></article>", 1), (2, None, None, 1)], "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in html.main_text(pages).orderBy("page_id").collect()] == [(1, "u", "äb", 2), (2, None, "", 0)]


# -- 6 --------------------------------------------------------------------------------------------


def test_license(docs, empty):
    got = by_id(license.license_scan(docs))
    at = next(i for i, t in enumerate(TEXTS) if t and t.startswith("Licensed under the Apache"))
    assert got[at]["families"] == ["apache-2.0"] and got[at]["n_licensed"] == 1
    assert got[at + 1]["n_licensed"] == 0 and got[13]["families"] == ["reserved"]
    assert got[4]["n_paragraphs"] == 0 and got[0]["families"] == []
    assert license.license_scan(empty).count() == 0


def license_words(line):
    return [w for w in (x.rstrip(".-") for x in regex.split(license.WORD, line.lower())) if w]


def test_license_equals_plain_python(spark):
    """The scan of real lines, given the fitted weights, against loops over runs, lines and windows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame(ROWS, "doc_id long, text string, k string").selectExpr("doc_id + 100000", "text", "k", "k", "doc_id")).cache()
    table, bias, (family, licence) = license.fit(docs)
    weight, names = {r["gram"]: r["w"] for r in table.collect()}, list(bias)
    name = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(name(b).to_bytes(8, "little"), xxhash.xxh64_intdigest(name(a).to_bytes(8, "little"), 42)))

    def grams(ws):
        return {signed(name(w)) for w in ws if len(w) > 3} | {pair(a, b) for a, b in itertools.pairwise(ws)}

    templates = [(f, grams(license_words(t))) for f, ts in license.TEMPLATES.items() for t in ts]

    def verdict(found):
        found = found & weight.keys()
        if not found:
            return None
        logits = [bias[n] + sum(weight[g][k] for g in found) for k, n in enumerate(names)]
        e = [math.exp(x - max(logits)) for x in logits]
        p, best = max((x / sum(e), n) for x, n in zip(e[2:], names[2:], strict=True))
        if p >= family:
            cover = max(len(t & found) / len(t) for f, t in templates if f == best)
            return best if cover >= license.MIN_COVERAGE else "unconfirmed"
        return "unknown" if 1 - e[0] / sum(e) > licence else None

    got = by_id(license.license_scan(docs))
    met = set()
    for r in docs.collect():
        counts, families = {"yes": 0, "unconfirmed": 0, "unknown": 0}, set()
        runs = re.split("\n[\t-\r ]*\n", r["text"] or "")
        for run in runs:
            ls = [license_words(x) for x in run.split("\n")]
            units = [grams(ws) for ws in ls]
            for lo in range(0, len(ls), license.STEP) if len(ls) > 1 else ():
                part = ls[lo : lo + license.WINDOW]
                after = ls[lo + len(part)] if lo + len(part) < len(ls) else []
                joins = {pair(a[-1], b[0]) for a, b in zip(part, [*part[1:], after], strict=True) if a and b}
                units.append(set().union(*map(grams, part)) | joins)
            said = {verdict(u) for u in units} - {None}
            sure = said - {"unconfirmed", "unknown"}
            families |= sure
            if said:
                counts["yes" if sure else "unconfirmed" if "unconfirmed" in said else "unknown"] += 1
        n = sum(bool(plain_words(x)) for x in runs)
        g = got[r["doc_id"]]
        assert (g["n_paragraphs"], g["n_licensed"], g["n_unconfirmed"], g["n_unknown"], g["families"]) == (n, *counts.values(), sorted(families)), r["doc_id"]
        met |= families
    assert len(met) >= 4


def test_license_real_wordings(spark):
    said = {
        "mit": ["SPDX-License-Identifier: MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody"],
        "isc": ["ISC License", "SPDX-License-Identifier: ISC"],
        "gpl": ["// SPDX-License-Identifier: GPL-2.0-only", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."],
        "bsd": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer."],
    }
    rows = [(f, prose(30) + "\n\n" + t) for f, ts in said.items() for t in ts]
    got = by_id(license.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")))
    assert [got[i]["families"] for i in range(len(rows))] == [[f] for f, _ in rows]


def test_license_families(spark):
    rows = [(i, prose(30) + "\n" + t) for i, t in enumerate(ts[0] for ts in license.TEMPLATES.values())]
    got = by_id(license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["families"] for i in range(len(rows))] == [[f] for f in license.TEMPLATES]


def test_license_wrapped_headers(spark):
    """Headers wrapped over several lines, two of them in one document, are found; paragraphs are runs of lines."""
    longest = {f: max(ts, key=len) for f, ts in license.TEMPLATES.items() if f in ("apache-2.0", "bsd", "gpl", "mit")}
    wrapped = {f: "\n".join(" * " + x for x in textwrap.wrap(t, 50)) for f, t in longest.items()}
    assert all(w.count("\n") >= 2 for w in wrapped.values())
    rows = [(i, prose(30) + "\n\n" + w + "\n \n" + prose(30)) for i, w in enumerate(wrapped.values())]
    rows.append((9, wrapped["mit"] + "\n\n" + wrapped["gpl"] + "\nAll rights reserved."))
    got = by_id(license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["families"] for i in range(len(wrapped))] == [[f] for f in wrapped]
    assert all((got[i]["n_paragraphs"], got[i]["n_licensed"]) == (3, 1) for i in range(len(wrapped)))
    assert got[9]["families"] == ["gpl", "mit", "reserved"] and got[9]["n_licensed"] == 2


def test_license_unknown(spark):
    """A licence that no template holds is unknown; ordinary text is not."""
    unseen = "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed\nunder the terms and conditions for copying, distribution and modification of the software."
    rows = [(0, prose(40) + "\n\n" + unseen)] + [(i, "\n".join(prose(20) for _ in range(6))) for i in range(1, 40)]
    got = by_id(license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[0]["n_licensed"], got[0]["n_unconfirmed"], got[0]["n_unknown"]) == (0, 0, 1) and got[0]["families"] == []
    assert all(got[i]["n_unknown"] == 0 and got[i]["families"] == [] for i in range(1, 40))


# -- 7 --------------------------------------------------------------------------------------------


def test_substring(docs, empty):
    got = by_id(substring.substring_dedup(docs, keep_bytes=True))
    first = {}
    for i, t, _ in ROWS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t, _ in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), sum(gone), spans, kept), i
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert got[None]["n_removed"] == 0 and substring.substring_dedup(empty).count() == 0


def test_substring_hot_prefixes(spark, monkeypatch):
    """Prefixes of many documents, split by the bytes beside them, give the same spans; so do copies in one run of rows."""
    core = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ"
    rows = [(i, prose(3) + f"{i % 5}" * (i % 7) + core[i % 9 :] + core + f"{i % 3}" * (i % 11) + prose(4)) for i in range(48)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, rows[7][1]), (300, rows[8][1][9:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = outcome(substring.substring_dedup(frame))
    own = [t.encode() for _, t in sorted(rows)]
    which, place, name, _, _ = substring.samples(own)
    pairs = pd.DataFrame({"name": name, "doc_id": [sorted(rows)[w][0] for w in which]}).sort_values(["name", "doc_id"])
    once = pairs.drop_duplicates()
    often = once.groupby("name")["doc_id"].transform("size").to_numpy()
    for hot in (1, 3, 1000):
        monkeypatch.setattr(substring, "HOT", hot)
        want = {(d, n + substring._MARK * (c > hot)) for n, d, c in zip(once["name"].tolist(), once["doc_id"].tolist(), often.tolist(), strict=True) if c > 1}
        for step in (5, 10_000):
            got = pd.concat(list(substring.shared_names(pairs.iloc[k : k + step] for k in range(0, len(pairs), step))))
            assert len(got) == len(want) and set(map(tuple, got[["doc_id", "name"]].to_numpy().tolist())) == want, (hot, step)
    # the split itself, in this process: every sample hot
    monkeypatch.setattr(substring, "HOT", 1)
    texts = pd.DataFrame({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    wanted = pd.concat(list(substring.shared_names([pairs]))).groupby("doc_id")["name"].apply(list)
    texts["names"] = [wanted.get(i, []) for i in texts["doc_id"]]
    parts = pd.concat(list(substring.contexts([texts.iloc[:24], texts.iloc[24:]])))
    assert {1, 2, -1} <= set(parts["side"])
    frame = spark.createDataFrame(parts, "doc_id long, start int, before int, side byte, context binary")
    keyed = frame.withColumn("key", substring.group_key()).sort("key", "side", "doc_id").drop("key").toPandas()
    gone: dict = {}
    for doc, a, b in pd.concat(list(substring.repeated_runs([keyed]))).itertuples(index=False):
        gone.setdefault(doc, set()).update(range(a, b))
    size = {i: sum(n for d, n in ((r["doc_id"], r["n_removed"]) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) if d == i) for i in gone if i < 200}
    assert {i: len(g) for i, g in gone.items() if i < 200} == {i: n for i, n in size.items() if n}
    assert plain == outcome(substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")))


# -- 9 --------------------------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bucket(s, n):
    return signed(xxhash.xxh64_intdigest(s.encode(), 42)) % n


def buckets(w, n):
    """Hashed n-grams of words: each, its end, and each pair (a hash of hashes)."""
    name = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
    pair = lambda x, y: xxhash.xxh64_intdigest(name(y).to_bytes(8, "little"), xxhash.xxh64_intdigest(name(x).to_bytes(8, "little"), 42))
    return [bucket(x, n) for x in w] + [bucket(x[-3:], n) for x in w] + [signed(pair(x, y)) % n for x, y in itertools.pairwise(w)]


def repeated_words(w):
    where = {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k : k + 3]), []).append(k)
    return len({p for ks in where.values() if len(ks) > 1 for k in ks for p in (k, k + 1, k + 2)})


def plain_quality(rows, good_ids):
    """(base counts, base_failed, llr) of each text of (doc_id, text), with the ratios counted in plain Python."""
    n = quality.BUCKETS
    raw, good = [0] * n, [0] * n
    grams = {t: buckets(plain_words(t), n) for _, t in rows}
    for i, t in rows:
        for b in grams[t]:
            raw[b] += 1
            good[b] += i in good_ids
    a, b = sum(good) + n, sum(raw) + n
    ratio = [round(math.log((g + 1) / a) - math.log((r + 1) / b), 6) for g, r in zip(good, raw, strict=True)]
    out = {}
    for t in grams:
        w = plain_words(t)
        ls = [x for x in (t or "").split("\n") if plain_words(x)]
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), repeated_words(w))
        score = sum(ratio[x] for x in grams[t]) / (3 * len(w) - 1) if w else 0.0
        out[t] = (counts, len(w) < 50 or 100 * counts[4] > 50 * len(w), score)
    return out


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(len(ROWS))], "doc_id long, quality int, toxic int")
    want = plain_quality([(i, t) for i, t, _ in ROWS] + [(None, "a row without an id " * 20)], set(range(30)))
    for r in quality.quality_rules(docs, labels).collect():
        counts, failed, score = want[r["doc"]["text"]]
        assert tuple(r[c] for c in quality.BASE) == counts and r["base_failed"] == failed
        assert abs(r["llr"] - score) < 2e-6 and r["kept"] == (not failed and r["llr"] >= quality.MIN_SCORE)
    assert quality.quality_rules(empty, labels.limit(0)).count() == 0
    # a tie is kept: without labels every ratio is 0
    assert quality.quality_rules(docs, labels.limit(0), min_score=0.0).where("kept = base_failed").count() == 0


# -- 10 -------------------------------------------------------------------------------------------


def test_toxicity_learns_an_interaction(spark):
    """Each term alone is harmless; only both together are toxic."""
    rows, labels = [], []
    for i in range(900):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((i, prose(12) + (" brute" if a else "") + (" folk" if b else "")))
        labels.append((i, 1, int(a and b)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == labels[r["doc_id"]][2] for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_held_out(spark):
    """On held-out labelled documents: four of five toxic ones found, clean ones left alone; scores as plain sums over pairs give them."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    bad, good = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in bad) >= 0.75 * len(bad) and sum(r["predicted"] for r in good) <= 0.005 * len(good)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    m = {"terms": [5, 9, 11], "w": [0.5, -1.0, 0.25], "v": [[1.0, 0.0], [0.5, 2.0], [0.0, 1.0]], "b": -0.25}
    names = {toxicity.bucket(w): w for w in "abcdefghij"}
    m["terms"] = sorted(names)[:3]
    words = [names[t] for t in m["terms"]]
    for own in ([0, 1], [0, 1, 2], []):
        y = m["b"] + sum(m["w"][i] for i in own) + sum(sum(a * b for a, b in zip(m["v"][i], m["v"][j], strict=True)) for k, i in enumerate(own) for j in own[k + 1 :])
        model = {k: np.asarray(v) for k, v in m.items()}
        assert abs(toxicity.score(model, [" ".join(words[i] for i in own)])[0] - 1 / (1 + math.exp(-y))) < 1e-9


def test_toxicity_labels_that_repeat(spark):
    rows = [(i, "brute " * (i % 2) + prose(10)) for i in range(200)]
    labels = [(i, i % 2) for i in range(200)] + [(i, 0) for i in range(200)]
    docs = spark.createDataFrame([*rows, (3, "")], "doc_id long, text string")
    one, two = (toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect() for x in (labels, labels[:200]))
    assert len(one) == 201 and sorted(r["score"] for r in one) == sorted(r["score"] for r in two)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(ROWS) + 1
    assert toxicity.toxicity(docs, labels.limit(0)).where("score is null").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage against plain Python over what the stage before it kept, and run() against the stages in turn."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs]
    for stage in (cp.quality_stage, cp.line_stage, cp.near_stage, cp.benchmark_stage):
        kept.append(common.written(stage(spark, kept[-1], d), "t"))
        assert kept[-1].columns == docs.columns
    start, good, lined, first, clean = (sorted((r["doc_id"], r["text"]) for r in k.collect()) for k in kept)
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
    verdict = plain_quality(start, trusted)
    assert [i for i, _ in good] == [i for i, t in start if not verdict[t][1] and round(verdict[t][2], 6) >= quality.MIN_SCORE] and dict(good).items() <= dict(start).items()
    gone = plain_lines(good)
    assert lined == [(i, "\n".join(x for x, g in zip(t.split("\n"), gone[i], strict=True) if not g)) for i, t in good]
    root = classes(lined)
    assert first == [(i, t) for i, t in lined if root[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    hits = plain_contamination(first, items)
    assert clean == [(i, t) for i, t in first if not (hits[i][0] > 0 and 20 * hits[i][0] >= len(bench_words(t)))]
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in clean}
    assert {r["doc_id"]: r["n_tokens"] for r in cp.run(spark, d).collect()} == want


def test_normal_form():
    e = bpe.WordEncoder(vocabulary_path("word_bpe_49k.json"))
    assert e.normal("éΣ") == unicodedata.normalize("NFC", "é") + "σ"


CLASHING = "n node key at doc h rows words x e llr kept n_words text_ line gram task root class_id kept_text n_lines n_dropped items n_hit score bands".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows: nulls in every column, repeats, ties, an empty and a very long text, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, BASE), (1, BASE), (1, "other text of the same id " * 12), (2, None), (None, BASE), (3, ""), (4, long), (None, None)]
    return spark.createDataFrame([(i, t, *["own"] * len(CLASHING)) for i, t in rows], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in CLASHING]]))


def outcome(df):
    return sorted(map(str, df.collect()))


def test_awkward_tables(spark, odd):
    """Each operator: a row for a row, the same with and without the extra columns."""
    path, words = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[5:25]), "x"), (None, "a", "x"), (2, None, "x")], "item_id long, text string, win string")
    slim = odd.select("doc_id", "text")
    same = {
        "near": near.near_duplicates,
        "counts": lambda d: bpe.token_counts(d, path),
        "bpe": lambda d: bpe.encode_decode(d, words),
        "bench": lambda d: decontaminate.contamination(d, bench),
        "license": license.license_scan,
        "substring": substring.substring_dedup,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "lines": lambda d: lines.dedup_lines(d).select("doc.doc_id", "n_lines", "n_dropped", "kept_text"),
        "quality": lambda d: quality.quality_rules(d, labels).select("doc.doc_id", *quality.BASE, "base_failed", "llr", "kept"),
    }
    for name, operator in same.items():
        got = operator(odd)
        assert outcome(got) == outcome(operator(slim)) and got.count() == odd.count(), name
        assert operator(odd.limit(0)).count() == 0, name
    for out in (lines.dedup_lines(odd), quality.quality_rules(odd, labels)):
        assert all(r["doc"][c] == "own" for r in out.collect() for c in CLASHING)
    pages = odd.withColumnsRenamed({"doc_id": "page_id", "text": "html", "key": "url"})
    assert html.main_text(pages).count() == odd.count() and html.main_text(pages.limit(0)).count() == 0


def test_stages_on_awkward_tables(spark, odd):
    """Each stage keeps the columns and what they hold, on any rows."""
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    for stage in (cp.quality_stage, cp.line_stage, cp.near_stage, cp.benchmark_stage):
        out = stage(spark, odd, d)
        assert out.columns == odd.columns and stage(spark, odd.limit(0), d).count() == 0
        assert all(r[c] == "own" for r in out.collect() for c in CLASHING)
    assert sorted(str((r["doc_id"], (r["text"] or "")[:5])) for r in cp.near_stage(spark, odd, d).collect()) == sorted(str((i, (t or "")[:5])) for i, t in [(1, BASE), (1, "other"), (2, None), (3, ""), (4, "w0 w1"), (None, BASE), (None, None)])
    assert cp.bpe_stage(spark, odd, d).count() == odd.count() and cp.line_stage(spark, odd, d).count() == odd.count()
