import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import corpus, ordering, repack, vocab


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.text is not None]


def clean(text):
    return text.replace("\u2028", "").replace("\u2029", "")


def most_common(docs):
    counter = Counter()
    for _, text in texts_of(docs):
        counter.update(clean(text))
    return counter.most_common()


def test_rank_equals_most_common(docs):
    got = vocab.ranked_tokens(docs).orderBy("rank").collect()
    assert [(r.token, r.n) for r in got] == most_common(docs)
    assert [r["rank"] for r in got] == list(range(len(got)))


def test_large_keys_take_the_two_pass_way(docs):
    far = docs.withColumn("doc_id", F.col("doc_id") + 2**40)
    got = vocab.ranked_tokens(far).orderBy("rank").collect()
    assert [(r.token, r.n) for r in got] == most_common(docs)


def test_rank_with_many_equal_counts(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randint(0, 3000)}" for _ in range(6000)] + ["hot"] * 3000
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i * 30:(i + 1) * 30])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = vocab.ranked_tokens(df, F.split("text", " ")).orderBy("rank").collect()
    assert [(r.token, r.n) for r in got] == Counter(words).most_common()


def stop_at(docs, max_distinct, max_docs):
    seen, kept = set(), []
    for i, (doc, text) in enumerate(
            [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()], start=1):
        seen.update(clean(text or ""))
        kept.append(doc)
        if (max_docs is not None and i >= max_docs) or len(seen) >= max_distinct:
            break
    return kept


def test_reading_stops_at_the_cap(docs):
    for cap, rows in [(5, None), (12, None), (13, 3), (20, None), (10_000, None), (10_000, 4)]:
        got = [r.doc_id for r in vocab.cap_documents(docs, cap, rows).orderBy("doc_id").collect()]
        assert got == stop_at(docs, cap, rows), (cap, rows)


def test_ids_are_consecutive_and_specials_come_first(docs):
    ranked = vocab.ranked_tokens(docs)
    rows = vocab.assign_ids(["<unk>", "t", "<unk>", "<s>"], ranked, 10).orderBy("id").collect()
    expected = ["<unk>", "t", "<s>", *[c for c, _ in most_common(docs) if c != "t"]][:10]
    assert [r.token for r in rows] == expected and [r.id for r in rows] == list(range(10))


def test_unknown_tokens_and_ids(spark, docs):
    table = spark.createDataFrame([("<unk>", 0), ("a", 1)], "token string, id bigint")
    tokens = spark.createDataFrame([("a",), ("q",)], "token string")
    assert {(r.token, r.id) for r in vocab.tokens_to_ids(tokens, table).collect()} == {("a", 1), ("q", 0)}
    ids = spark.createDataFrame([(1,), (7,)], "id bigint")
    assert {(r.id, r.token) for r in vocab.ids_to_tokens(ids, table).collect()} == {(1, "a"), (7, "<unk>")}
    assert {(r.id, r.token) for r in vocab.ids_to_tokens(ids, table, None).collect()} == {(1, "a"), (7, None)}
    assert {(r.token, r.known) for r in vocab.membership(tokens, table).collect()} == {("a", "a"), ("q", "<unk>")}


def test_byte_codes_equal_utf8(spark):
    ranks = [0, 95, 96, 2015, 2016, 55263, 55264, 63455, 63456, 1112031 - 32, *range(0, 1_112_000, 997)]
    df = spark.createDataFrame([(r,) for r in ranks], "r bigint").select("r", repack.byte_code(F.col("r")).alias("c"))
    for row in df.collect():
        cp = row.r + 32
        cp += 2048 if cp >= 55296 else 0
        assert bytes(row.c) == chr(cp).encode(), row.r
    gold = {0: "20", 95: "7F", 96: "C280", 2015: "DFBF", 2016: "E0A080", 63455: "EFBFBF", 63456: "F0908080"}
    for row in df.where(F.col("r").isin(*gold)).collect():
        assert bytes(row.c).hex().upper() == gold[row.r]
    last = spark.range(1).select(repack.byte_code(F.lit(repack.CODES - 1)).alias("a"),
                                 repack.byte_code(F.lit(repack.CODES)).alias("b")).first()
    assert bytes(last.a).hex().upper() == "F48FBFBF" and last.b is None


def test_unknown_mark_has_the_last_code(spark):
    ranked = spark.createDataFrame([("a", 0), ("b", 1)], "token string, rank bigint")
    remap = repack.assign_byte_codes(ranked)
    assert {r.token: bytes(r.code) for r in remap.collect()} == {"a": b" ", "b": b"!", "<unk>": b'"'}
    tokens = spark.createDataFrame([("a",), ("z",)], "token string")
    assert {r.token: bytes(r.code) for r in repack.apply_remap(tokens, remap).collect()} == {"a": b" ", "z": b'"'}
    older = repack.apply_remap(tokens, remap, None).collect()
    assert {r.token: bytes(r.code) for r in older} == {"a": b" ", "z": b"<unk>"}


def test_index_in_hot_groups(spark):
    rows = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    bucket = ordering.bucket_of(F.col("id"), ordering.key_bounds(rows, "id"))
    got = ordering.ordered_index(rows, "i", [F.col("id")], bucket, ["g"]).collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.id):
        assert r.i == groups.setdefault(r.g, 0)
        groups[r.g] += 1
    assert len(got) == 5000


def test_nulls_form_a_group(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id bigint, g string")
    bucket = ordering.bucket_of(F.col("id"), ordering.key_bounds(rows, "id"))
    got = {r.id: r.i for r in ordering.ordered_index(rows, "i", [F.col("id")], bucket, ["g"]).collect()}
    assert got == {i: i // 2 for i in range(40)}


def test_nth_key_far_down(spark, monkeypatch):
    monkeypatch.setattr(corpus, "_SORTED_AT_ONCE", 50)
    rows = spark.range(0, 9000, 3).withColumnRenamed("id", "k")
    for n in (1, 50, 51, 777, 2999, 3000):
        assert corpus.nth_key(rows, n, "k") == (n - 1) * 3
    assert corpus.nth_key(rows, 3001, "k") is None
    assert corpus.max_examples(rows, 1234, "k").count() == 1234


def test_nth_key_of_other_types_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(corpus, "_SORTED_AT_ONCE", 20)
    kinds = {
        "string": F.concat(F.lit("é"), F.hex("id")), "timestamp": F.timestamp_seconds(F.col("id") * 977),
        "double": F.col("id") / 7, "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
    }
    for kind, column in kinds.items():
        rows = spark.range(600).select(column.cast(kind).alias("k"))
        keys = [r.k for r in rows.orderBy("k").collect()]
        assert [corpus.nth_key(rows, n, "k") for n in (1, 299, 600, 601, 0)] == [keys[0], keys[298], keys[599], None, None]
    # A third of the rows has one key; some have none.
    hot = spark.range(900).select(F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"))
    keys = [r.k for r in hot.where("k is not null").orderBy("k").collect()]
    for n in (1, 200, 400, len(keys)):
        assert corpus.nth_key(hot, n, "k") == keys[n - 1]
    assert corpus.nth_key(hot, len(keys) + 1, "k") is None


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "date"])
def test_first_places_of_repeated_keys(spark, kind):
    """Keys beyond any packing, below zero, repeated, and of other types."""
    numbers = {"bigint": [2**40 + 1, 2**40 + 1, 2**40 + 2, -5, 2**62, -(2**62)], "int": [7, 7, 8, -5, 2**31 - 1, -(2**31)]}
    keys = numbers.get(kind, [3, 3, 4, 2, 9, 1])
    texts = ["ab", "cab", "bd", "xyb", "cq", "zz"]
    docs = spark.createDataFrame(list(zip(keys, texts)), "k bigint, text string")
    column = F.concat(F.lit("key "), "k") if kind == "string" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int")) if kind == "date" else F.col("k").cast(kind)
    docs = docs.withColumn("k", column)
    want = {}
    for r in docs.collect():
        for pos, c in enumerate(r.text):
            n, place = want.get(c, (0, (r.k, pos)))
            want[c] = (n + 1, min(place, (r.k, pos)))
    got = vocab.counts_with_first(docs, key="k").collect()
    assert {r.token: (r.n, (r.first_doc, r.first_pos)) for r in got} == want and len(got) == len(want)
    ranked = vocab.ranked_tokens(docs, key="k").orderBy("rank").collect()
    assert [r.token for r in ranked] == sorted(want, key=lambda c: (-want[c][0], want[c][1]))


def test_first_passing_widens(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    late = lambda df: df.where(F.col("doc_id") >= 900)
    got = [r.doc_id for r in corpus.first_passing(rows, 5, late).collect()]
    assert got == [900, 901, 902, 903, 904]
    assert corpus.first_passing(rows, 5000, late).count() == 4100


def test_no_examples_are_none(spark, docs):
    from glyphmill.operators import corpus

    assert corpus.max_examples(docs, 0).count() == 0
    assert corpus.max_examples(docs, None).count() == docs.count()


def test_small_keys_are_counted_without_decimals(spark):
    """A key and a position were a decimal for every token; both ways give the same places."""
    rows = [(2**31 - 1, "ba"), (-(2**31), "cb"), (5, "a"), (-3, "xa")]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    large = spark.createDataFrame([*rows, (2**62, "")], "doc_id bigint, text string")
    assert vocab._fits_long(small, "doc_id") and not vocab._fits_long(large, "doc_id")
    assert vocab._fits_long(small.limit(0), "doc_id")
    found = [sorted(map(tuple, vocab.counts_with_first(d).collect())) for d in (small, large)]
    assert found[0] == found[1] == [("a", 3, -3, 1), ("b", 2, -(2**31), 1), ("c", 1, -(2**31), 0), ("x", 1, -3, 0)]
