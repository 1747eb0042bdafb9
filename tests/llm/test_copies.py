"""Exact copies against plain Python."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from glyphmill.llm import copies


def plain(rows):
    """{normalised text: (smallest key, size)}"""
    found = defaultdict(list)
    for key, text in rows:
        found[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    return {t: (min((k for k in ks if k is not None), default=None), len(ks)) for t, ks in found.items()}


def check(done, rows):
    want = plain(rows)
    digests = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
    assert len(done) == len(rows)
    stayed = defaultdict(list)
    for r in done:
        assert (r.keep, r.n) == digests[bytes(r.digest)]
        if r.kept:
            stayed[bytes(r.digest)].append(r.doc_id)
    assert {d: [v[0]] for d, v in digests.items()} == stayed


def test_copies(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(copies.groups(awkward).collect(), rows)


def test_white_space(spark):
    texts = ["a b", "a\tb", "a \n b", " a b", "a b ", "a\x1cb", "a b", "", None, " ", "\n\n", "A b"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    check(copies.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_equal_hashes_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(copies.groups(docs, hashed=lambda t: F.unhex(F.lit("00"))).collect(), rows)


def test_one_text_everywhere(spark):
    rows = [(i, "the same" if i % 3 else f"own {i}") for i in range(3000)]
    check(copies.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_empty_and_other_keys(spark):
    assert copies.groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("c", "y")]
    check(copies.groups(spark.createDataFrame(rows, "doc_id string, text string")).collect(), rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2, "h", 3), (2, "a", 2, "h", 3)],
                                 "doc_id int, text string, n int, hash string, _row int")
    assert [(r.doc_id, r.keep, r.n, r.kept) for r in copies.groups(docs).orderBy("doc_id").collect()] == [
        (1, 1, 2, True), (2, 1, 2, False)]
    assert [r.doc_id for r in copies.first_of_copies(docs).collect()] == [1]
