"""Operators that work a text at a time, against plain Python."""

import base64
import hashlib
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, fertility, licences, main_text, private, redirects

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def junk_texts():
    rng = random.Random(4)
    vocab = ["a", "bb", "#c", "dé", "日本", "e e", "f|g", "\x1c"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(40)]
    return texts + ["x y\nx y\n\n \nx y", "one two three four five six seven eight " * 3, "\n".join(texts[:9] * 2)]


def test_base_measures(spark, awkward):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(junk_texts())], "doc_id bigint, text string")
    rows = rows.unionByName(awkward.select("doc_id", "text"))
    done = fertility.judged(fertility.measure(rows)).collect()
    assert len(done) == rows.count()
    for r in done:
        n, chars, symbols, lines, repeats = base_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            n, chars, symbols, lines, repeats), r.text
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)


def test_token_measures(spark):
    import math
    from collections import Counter

    import public_tokenizers as P
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["the cat sat on the mat", "Überraschung é😀 \x07", "日本語 テキスト", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fertility.measure(rows).collect():
        ids = [i for w in WORD.findall(r.text or "") for i in model.encode(w)]
        counts = Counter(ids)
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
        assert (r.n_tokens, r.n_bytes) == (len(ids), sum(model.is_byte(i) for i in ids))
        assert r.entropy == pytest.approx(entropy, abs=1e-9)
    scripts = [r.script for r in fertility.measure(rows).orderBy("doc_id").collect()]
    assert scripts == ["latin", "latin", "han", "other", "other"] or scripts[2] in ("han", "kana")


def test_bands_reject(spark):
    strange = " ".join(chr(0x10300 + i % 20) * 3 for i in range(60))
    plain = " ".join(f"word{i} stands here" for i in range(30))
    single = "aaaa " * 3 + " ".join("aaaa" + "a" * (i % 3) for i in range(3)) + " "
    rows = spark.createDataFrame(enumerate([strange, plain, single * 40]), "doc_id bigint, text string")
    done = {r.doc_id: r for r in fertility.judged(
        fertility.measure(rows), {"latin": fertility.Band(), "other": fertility.Band(max_bytes=0.5)}
    ).collect()}
    assert done[0].byte_share > 0.5 and not done[0].kept
    assert done[1].kept
    assert done[2].entropy < 3 and not done[2].in_band


def test_default_bands_reject_noise_and_keep_good_documents(spark):
    rng = random.Random(1)
    noise = [
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(200)),
        " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(60)),
        " ".join(rng.randbytes(16).hex() for _ in range(60)),
        " ".join("".join(chr(rng.randint(0x1F900, 0x1F9FF)) for _ in range(4)) for _ in range(60)),
    ]
    rows = spark.createDataFrame(list(enumerate(noise)), "doc_id bigint, text string")
    done = fertility.judged(fertility.measure(rows)).collect()
    assert not any(r.base_failed or r.in_band or r.kept for r in done)
    folder = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(good, "doc_id")
    kept = fertility.judged(fertility.measure(docs)).where("n_words >= 20").collect()
    assert len(kept) > 100 and all(r.in_band for r in kept)


def test_measure_empty_table(spark, awkward):
    assert fertility.judged(fertility.measure(awkward.limit(0))).collect() == []


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


TEXTS = [
    "Hello World's 42 <|endoftext|>x  İstanbul ΣΑΣ é\u0085\x1cfoo ﬁ 'S I'LL <|startoftext|", "", None,
    "日本語テキスト", "a b\x1fc d\x0be", "é Ａ①  ½²", "x" * 5000, "ab" * 3000 + "'s'll", "😀👍🏽",
    "<|endoftext|><|startoftext|>", "don't WE'RE", "  　",
]


def test_bpe_equals_the_library(spark, awkward):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").unionByName(
        awkward.select("doc_id", "text"))
    known = library()
    for r in bpe.decode(bpe.encode(rows)).collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == known.decode(ids, skip_special_tokens=False)


def test_bpe_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known = library()
    done = bpe.encode(rows, out="text_ids").collect()
    assert all(r.text_ids == known.encode(r.text, add_special_tokens=False).ids for r in done)


def test_merge_by_tree_takes_lowest_then_leftmost():
    rng = random.Random(2)
    for _ in range(300):
        ranks, new = {}, 10
        for a in range(4):
            for b in range(4):
                if rng.random() < 0.6:
                    ranks[a, b] = (rng.randint(0, 5) * 100 + len(ranks), rng.randint(0, 5))
        symbols = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        slow = [*symbols]
        while True:
            found = [(ranks[p][0], i) for i, p in enumerate(zip(slow, slow[1:])) if p in ranks]
            if not found:
                break
            i = min(found)[1]
            slow[i:i + 2] = [ranks[slow[i], slow[i + 1]][1]]
        assert bpe.merge_by_tree(symbols, ranks) == slow


def test_bpe_empty_table(spark, awkward):
    assert bpe.decode(bpe.encode(awkward.limit(0))).collect() == []
    assert "n_words" in bpe.encode(awkward).columns


PRIVATE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PRIVATE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def private_texts():
    rng = random.Random(9)
    parts = [
        "a@b.c", "_d@e.f", "x.y@", "@z.com", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "++12 34567890", "é😀", " ", "-", "7", "12", "a-b@c-d.e.f",
        "4111111111111111", "\n", "me%@x--y.zz..", "+1.2.3.4.5.6.7.8",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]
    return texts + ["1 " * 4000, "a" * 20000 + "@", "9" * 8000, "a.b" * 5000 + "@x.y", "", None]


def test_base_spans_equal_plain_patterns(spark, awkward):
    texts = private_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    done = {r.doc_id: r.spans for r in private.find(rows).collect()}
    assert len(done) == len(texts)
    for i, text in enumerate(texts):
        found = [(s.kind, s.start, s.stop) for s in done[i] if s.base]
        assert found == base_spans(text), text
    assert private.find(awkward).count() == awkward.count()
    assert private.find(awkward.limit(0)).collect() == []


def contexts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        rows.append((i, f"word{i % 7} please call agent at +1 (555) {100 + i}-{2000 + i} today we said {i}x"))
    rows.append((100, "now please call agent at 555-867-5309 today or never"))
    rows.append((101, "the price was 555-867-53 then and 12 more"))
    rows.append((102, "please call agent at 4th today"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_contexts_find_unseen_identifiers(spark):
    done = {r.doc_id: r.spans for r in private.find(contexts(spark)).collect()}
    added = {k: [(s.kind, s.start, s.stop) for s in v if not s.base] for k, v in done.items()}
    text = "now please call agent at 555-867-5309 today or never"
    at = text.index("555")
    assert added.pop(100) == [("phone", at, at + 12)]
    assert not any(added.values())


def test_masked(spark, awkward):
    rows = spark.createDataFrame([
        (1, "mail a.b@c.de or 1.2.3.4.", 5), (1, "none", 6), (None, "+1 (555) 123-4567 4111111111111111", 7), (3, None, 8),
        (4, "+4111111111111111", 1),
    ], "doc_id bigint, text string, spans int")
    done = sorted((tuple(r) for r in private.masked(rows).collect()), key=lambda r: r[2])
    # The third is one long run of digits to the patterns, too long for either kind.
    assert done == [
        (4, "+[card]", 1), (1, "mail [email] or [ip].", 5), (1, "none", 6),
        (None, "+1 (555) 123-4567 4111111111111111", 7), (3, None, 8),
    ]
    assert sorted(map(str, private.masked(awkward).collect())) == sorted(map(str, awkward.collect()))


def dice_rows(text, templates, threshold):
    def words(t):
        return re.findall(r"[a-z0-9\x80-\U0010FFFF]+", t.translate({c: c + 32 for c in range(65, 91)}))

    def grams(t):
        w = words(t)
        return {f"{a} {b}" for a, b in zip(w, w[1:])} if len(w) > 1 else set(w)

    out = []
    if text is None:
        return out
    lines = text.split("\n")
    for n, body in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
        g = grams(body)
        for name, template in templates.items():
            t = grams(template)
            if g and 2 * len(g & t) / (len(g) + len(t)) >= threshold:
                out.append((n, name, len(g), len(g & t)))
    return out


def test_real_notices_and_whole_licences(spark):
    def full(name):
        return (Path(licences.__file__).parent / "licence_texts" / f"{name}.txt").read_text("utf-8")

    texts = {
        "all-rights-reserved-short": "Copyright 2020.\nAll rights reserved.", "MIT-licensed": "Licensed under the MIT License.",
        "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "LGPL-notice": "Licensed under the GNU Lesser General Public License, version 3.",
        "GPL-3-full": full("GPL-3"), "Apache-2.0-full": full("Apache-2.0"), "MPL-2.0-full": full("MPL-2.0"),
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = {(r.doc_id, r.licence) for r in licences.scan(rows).collect()}
    assert {(name, name) for name in texts} <= found


def test_licences_equal_brute_force(spark, awkward):
    rng = random.Random(6)
    texts = []
    for body in licences.TEMPLATES.values():
        words = body.split()
        texts.append("intro line\n" + body.upper() + "\n" + body)
        for _ in range(3):
            texts.append(" ".join(w for w in words if rng.random() > 0.08))
    texts += ["MIT", "", None, "Released\nunder the\nMIT License"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for threshold in (0.5, 0.8):
        done = licences.scan(rows, threshold=threshold).collect()
        want = [(i, *r) for i, t in enumerate(texts) for r in dice_rows(t, licences.TEMPLATES, threshold)]
        assert sorted((r.doc_id, r.passage, r.licence, r.n_bigrams, r.n_shared) for r in done) == sorted(want)
    assert licences.scan(awkward).count() == 0
    assert licences.scan(awkward.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    urls = [
        (1, "https://a.example.org/es/x"), (2, "http://a.example.org/en/12"), (3, "http://a.example.org/en/2"),
        (4, "HTTP://B.COM/de/x?q#f"), (5, "http://b.com/fr/1"), (6, "http://notcom/"), (7, None), (8, "no address"),
        (9, "http://q.net/old"), (10, "http://q.net/old/#x"), (11, "http://r.net/a"), (12, "http://r.net/b"),
        (13, "https://org/"), (14, "http://r.net/?utm_source=1"), (15, "http://t.net/p"), (1, "http://t.net/p/"),
    ]
    rows = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("verdict", F.lit("x"))
    edges = spark.createDataFrame([
        ("http://q.net/old", "https://b.com/de/new"), ("http://r.net/a", "http://hub.net/"), ("http://hub.net/", "http://r.net/b"),
        ("http://r.net/b", "http://b.com/fr/9"), ("http://hub.net/", "http://b.com/de/9"), (None, "http://x.net/"),
        ("http://t.net/p", None),
    ], "src string, dst string")
    done = [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict, r.via) for r in redirects.judge(rows, edges).collect()]
    got = {(r[0], r[1]): r[2:] for r in done}
    assert len(done) == len(urls)
    assert got[1, urls[0][1]] == ("a.example.org", "/es/x", "example.org/es/", "block", "rule")
    assert got[2, urls[1][1]][2:] == ("example.org/en/1", "block", "rule")
    assert got[3, urls[2][1]][2:] == ("org/", "allow", "rule")
    assert got[4, urls[3][1]] == ("b.com", "/de/x", "com/de/", "block", "rule")
    assert got[5, urls[4][1]][2:4] == ("com/fr/", "allow")
    assert got[6, urls[5][1]][2:] == (None, "allow", "default")
    assert got[7, None] == ("", "", None, "allow", "default") == got[8, "no address"]
    assert got[9, urls[8][1]][2:] == got[10, urls[9][1]][2:] == (None, "block", "alias")
    # An allowed alias wins over a blocked one.
    assert got[11, urls[10][1]][2:] == got[12, urls[11][1]][2:] == (None, "allow", "alias")
    assert got[13, urls[12][1]][2:4] == ("org/", "allow")
    assert redirects.judge(rows.limit(0), edges.limit(0)).count() == 0


def test_declared_links(spark):
    pages = spark.createDataFrame([
        ("http://a.net/x/y", '<link href="/z" rel="canonical"><meta http-equiv="refresh" content="0; url=http://b.net/">'),
        ("http://a.net/x/y", '<LINK rel=canonical href=w><link rel="icon" href="/i">'), ("http://c.net", None),
    ], "url string, html string")
    found = {tuple(r) for r in redirects.page_edges(pages).collect()}
    assert found == {("http://a.net/x/y", "http://a.net/z"), ("http://a.net/x/y", "http://b.net/"),
                     ("http://a.net/x/y", "http://a.net/x/w")}


def test_link_targets_are_decoded_and_resolved(spark):
    from urllib.parse import urljoin

    base = "http://a.net/x/y/z?q=1"
    # What the page holds, and its target.
    given = {
        "/p?a=1&amp;b=2": "/p?a=1&b=2", "&#x2F;q&#47;r": "/q/r", "../up": "../up", "../../../top": "../../../top",
        "./here": "./here", "a/../b/./c": "a/../b/./c", "..": "..", "?only=query": "?only=query", "//b.net/w/../v": "//b.net/v",
        "http://c.net/d/../e": "http://c.net/e", "next?u=http://c.net/..": "next?u=http://c.net/..",
        "/odd&copy=1&#xD800;&#0;&#99999999;": "/odd&copy=1&#xD800;&#0;&#99999999;",
    }
    rows = spark.createDataFrame([(base, f'<link rel="canonical" href="{h}">') for h in given], "url string, html string")
    assert {r.dst for r in redirects.page_edges(rows).collect()} == {urljoin(base, t) for t in given.values()}
    refresh = spark.createDataFrame(
        [(base, '<meta http-equiv="refresh" content="0; url=http://b.net/?a=1;c&amp;b=2">')], "url string, html string"
    )
    assert [r.dst for r in redirects.page_edges(refresh).collect()] == ["http://b.net/?a=1;c&b=2"]
    # A block reaches a page through a link with a reference and dot parts in it; other columns keep their values.
    pages = spark.createDataFrame([
        (1, 7, "x", "http://b.net/m/n", '<link rel="canonical" href="http://s.com/fr/../de/i?a=1&amp;b=2">'),
        (2, 8, "y", "http://s.com/./k", '<link rel="canonical" href="m/../../de/i?b=2&#38;a=1">'), (3, 9, "z", None, None),
    ], "page_id bigint, _key bigint, ruling string, url string, html string")
    done = redirects.judge(pages.drop("html"), redirects.page_edges(pages))
    assert sorted((r.page_id, r._key, r.ruling, r.rule, r.verdict, r.via) for r in done.collect()) == [
        (1, 7, "x", None, "block", "alias"), (2, 8, "y", None, "block", "alias"), (3, 9, "z", None, "allow", "default"),
    ]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<%s><h1>Head &amp; tail</h1><p><b>First part, of the text, with commas, and more words.<br><p>Second&nbsp;one
 with <a href="/x">a link</a> in it and many more words, so it counts.</p><p>Sh is.</p><aside>aside text</aside>
<form><input name=q><button>Go</button></form><div class="comments"><p>Great post, thanks, a lot, really, so good it is!</p></div>
</%s><div id="sidebar"><p>Other things, that are not, the text, at all, but long enough to count.</p></div>
<footer>&copy; us &middot; here</footer></body></html>"""
TEXT = ("Head & tail First part, of the text, with commas, and more words. Second one with a link in it and many more "
        "words, so it counts. Sh is.")


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"'])
def test_main_text(tag):
    assert main_text.main_text(PAGE % (tag, tag.split()[0])) == TEXT


def test_main_text_of_nested_articles():
    long = "".join(f"<p>Sentence {i}, with some commas, and words, long enough to count as a paragraph.</p>" for i in range(60))
    page = (
        "<body><nav>Links</nav><article><header><h1>Title</h1></header><section>" + long + "</section>"
        "<section><p>A short section, which belongs too.</p></section><ul><li>point</li></ul>"
        "<table><tr><td>cell</td></tr></table><pre>code</pre><blockquote>quote</blockquote>"
        "<ul><li><a href='x'>other page</a></li></ul></article><aside>Aside</aside></body>"
    )
    text = main_text.main_text(page)
    assert text.startswith("Title Sentence 0") and "Sentence 59" in text
    assert text.endswith("A short section, which belongs too. point cell code quote")


SENTENCE = "A sentence with some commas, and words, long enough to count as a paragraph."


def test_main_text_keeps_named_sections():
    page = (
        f'<body><div class="site-banner">Buy</div><article><h1 id="comments">T</h1><p>{SENTENCE}</p>'
        '<section id="related-work"><p>Earlier papers.</p></section><p class="share-price">Up 3.</p>'
        '<div class="share-buttons">Tweet</div><div class="related-posts"><p>More posts</p></div><div id="notice">Note</div>'
        '<div class="cookie-law-info">Cookies</div><div role="search">Find</div>'
        '<article class="comment"><p>I think so too, and more so, by all that is said here.</p></article></article>'
        f'<article><p>{SENTENCE}</p></article></body>'
    )
    assert main_text.main_text(page) == f"T {SENTENCE} Earlier papers. Up 3. {SENTENCE}"


def test_main_text_without_article():
    page = (
        '<body><div class="wrapper"><div class="post"><div>' + f"<p>{SENTENCE}</p>" * 8 + "</div><div><p>Short end.</p></div>"
        '<ul><li>item</li></ul></div><div class="rail"><p>tiny</p></div></div><p><a href="/">elsewhere</a></p></body>'
    )
    assert main_text.main_text(page) == " ".join([SENTENCE] * 8 + ["Short end. item"])


@pytest.mark.parametrize("page", [
    "<div>a text block, " * 12000, "<a " * 70000, "<a '<b \"" * 30000, "<b>" * 30000 + "</i>" * 20000,
    "<b>" * 30000 + "<hr>" * 20000, "<b>" * 20000 + "<header>" * 10000, "<!x" * 60000, "<script></script " * 12000,
    "<p><b>" * 30000,
])
def test_main_text_takes_linear_time(page):
    start = time.process_time()
    main_text.main_text(page)
    assert time.process_time() - start < 5


def test_main_text_of_odd_pages(spark):
    deep = "<div>" * 20000 + "deep text, with commas, here and there" + "</div>" * 20000
    pages = [None, "", "plain text only", "<p>one<p>two", "<div><p>a < b & c", "<script>x", "<!-- open", deep,
             "<article><p>x</article><article><p>y"]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").withColumn("text", F.lit(1))
    done = {r.page_id: r.text for r in main_text.extract(rows.withColumn("_html", F.lit(7))).where("_html = 7").collect()}
    assert [done[i] for i in range(8)] == ["", "", "plain text only", "one two", "a < b & c", "", "",
                                           "deep text, with commas, here and there"]
    assert main_text.extract(rows.limit(0)).collect() == []


def test_main_text_of_given_pages(spark):
    import html as entities

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in main_text.extract(rows.withColumn("kept", F.col("html"))).collect():
        body = re.search(r"<article>(.*)</article>", r.kept, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        clean = [" ".join(entities.unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert r.text == " ".join(b for b in clean if b)
        assert hashlib.sha256(r.text.encode()).hexdigest()
