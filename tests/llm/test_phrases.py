"""Phrases against plain Python, at small chunks and low thresholds."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string"


def pieces(rows):
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            yield lang or "und", re.findall(r"[^\x20\x09]+", piece)


def counts(rows, most):
    found = defaultdict(Counter)
    for lang, words in pieces(rows):
        for k in range(1, most + 1):
            for i in range(len(words) - k + 1):
                found[lang][tuple(words[i:i + k])] += 1
    return found


def plain(rows, least, cover, count, most):
    out = {}
    for lang, f in counts(rows, most).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        longest = Counter()
        for q, b in chosen.items():
            for part in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}:
                longest[part] = max(longest[part], b)
        for p, a in chosen.items():
            cuts = [(phrases.ONE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * longest[p] < cover * a:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:count], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n, -score)
    return out


def texts():
    rng = random.Random(11)
    vocab = ["new", "york", "New", "city", "of", "the", "é", "日本", "x\x1cy", "a-b", " ", "to"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]
    rows = []
    for i in range(120):
        body = "".join(rng.choice(vocab) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
        rows.append((i, body, rng.choice(["en", "en", "en", "de", None])))
    passage = "the quick brown fox jumps over the lazy dog and the new york city sky"
    rows += [(200 + i, passage, "en") for i in range(60)]
    return rows + [(1, None, "en"), (2, "", None), (3, " . , ", "fr"), (4, "new york " * 500, "es"), (4, "New York " * 500, "es")]


@pytest.mark.parametrize("period,most", [(2, 3), (3, 4), (1, 2)])
def test_collocations(spark, period, most):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, cover, count in ((2, 50, 2000), (10, 80, 5)):
        done = phrases.collocations(docs, least=least, cover=cover, count=count, period=period, max_words=most).collect()
        found = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in done}
        assert found == plain(rows, least, cover, count, most)


def test_chunks_cover_each_phrase_once(spark):
    rows = texts()
    dictionary = phrases.parse(spark.createDataFrame(rows, SCHEMA), period=3)
    total = defaultdict(Counter)
    for r in dictionary.collect():
        words = r.chunk.split(" ")
        for k in (1, 2, 3):
            for i in range(min(r.owned, len(words) - k + 1)):
                total[r.lang][tuple(words[i:i + k])] += r.n
    assert total == {k: v for k, v in counts(rows, 3).items() if v}
    # The shared passage is held once per chunk, not once per document.
    assert dictionary.where("lang = 'en' and chunk like '%lazy dog%'").agg(F.max("n")).first()[0] >= 60


def test_every_hash_through_a_full_filter(spark, monkeypatch):
    """A filter too small for its hashes only lets through more."""
    monkeypatch.setattr(phrases, "MOST_FILTER_BITS", 64)
    rows = texts()
    done = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=2).collect()
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in done} == plain(rows, 2, 50, 2000, 3)


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame(
        [("en", "a", 1, 6_000_000_000), ("en", "b", 1, 5_000_000_001), ("en", "a b", 2, 5_000_000_000)],
        "lang string, phrase string, k int, n bigint")
    [r] = phrases.scored(grams).collect()
    assert r.score == 10**6 * 5_000_000_000**2 // (6_000_000_000 * 5_000_000_001)


def test_nothing(spark, awkward):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    named = awkward.withColumn("lang", F.lit(None).cast("string")).withColumn("chunk", F.lit(1)).withColumn("owned", F.lit(2))
    rows = [(r.doc_id, r.text, r.lang) for r in named.collect()]
    done = phrases.collocations(named, least=2).collect()
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in done} == plain(rows, 2, 50, 2000, 3)
