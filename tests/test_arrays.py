import math

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import arrays as A
from glyphmill.operators import metrics, tasks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def array(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_pad_mask_and_cut(spark):
    ids = array(5, 6, 7)
    assert value(spark, A.pad_truncate(ids, 5, 0)) == [5, 6, 7, 0, 0]
    assert value(spark, A.pad_truncate(ids, 2, 0)) == [5, 6]
    assert value(spark, A.attention_mask(ids, 5)) == [1, 1, 1, 0, 0]
    assert value(spark, A.attention_mask(ids, 2)) == [1, 1]
    assert value(spark, A.cut_count(ids, 2)) == 1
    padded, mask = A.pad_truncate(ids, 5, 0), A.attention_mask(ids, 5)
    assert value(spark, A.labels_copy(padded, mask)) == [5, 6, 7, -100, -100]


def test_specials(spark):
    assert value(spark, A.wrap_specials(array(5), 1, 2)) == [1, 5, 2]
    assert value(spark, A.prepend_start(array(5), array(6), 1)) == [1, 5, 1, 6]
    assert value(spark, A.prepend_start(array(5), array(6))) == [5, 6]


def test_numbers(spark):
    assert value(spark, A.argmax(array(0.1, 0.7, 0.7))) == 1
    xs = [1.0, 2.0, 700.0]
    total = sum(math.exp(x - 700) for x in xs)
    assert value(spark, A.softmax(array(*xs))) == pytest.approx([math.exp(x - 700) / total for x in xs])
    logs = [math.log(max(x, 1e-10)) for x in (0.5, 0.0, 0.5)]
    mean = sum(logs) / 3
    assert value(spark, A.centered_log(array(0.5, 0.0, 0.5))) == pytest.approx([x - mean for x in logs])
    assert value(spark, A.token_nll(array(0.0, 0.0), F.lit(1))) == pytest.approx(math.log(2))


def test_bits_per_byte_of_the_four_token_example(spark):
    """Tokens of 3, 3, 3 and 1 bytes under fixed logits: 0.7 bits per byte."""
    logits = array(0.8664, 0.1732, -0.5199, -0.5199)
    rows = spark.createDataFrame([(0, 0, 3), (1, 0, 3), (2, 1, 3), (3, 2, 1)], "pos int, id int, n_bytes int")
    rows = rows.withColumn("nll", A.token_nll(logits, F.col("id"))).withColumn("seq", F.lit(0))
    stats = metrics.sequence_stats(rows, ["seq"]).withColumn("batch", F.lit(0))
    assert metrics.bits_per_byte(stats).first().bits_per_byte == pytest.approx(0.7, abs=5e-5)


def test_padding_can_be_left_out(spark):
    rows = spark.createDataFrame(
        [(0, 1.0, 2, False), (0, 3.0, 2, False), (0, 9.0, 0, True)], "seq int, nll double, n_bytes int, pad boolean"
    )
    kept = metrics.sequence_stats(rows, ["seq"], pad="pad").first()
    assert (kept.nats, kept.tokens, kept.n_bytes) == (4.0, 2, 4)
    every = metrics.sequence_stats(rows, ["seq"]).first()
    assert (every.nats, every.tokens, every.n_bytes) == (13.0, 3, 4)


def cut_one_by_one(a, b, room):
    a, b = list(a), list(b)
    while len(a) + len(b) > room:
        (a if len(a) > len(b) else b).pop()
    return a, b


def test_pairs_are_cut_from_the_longer_side(spark):
    sizes = [(x, y) for x in range(0, 14) for y in range(0, 14)]
    rows = spark.createDataFrame([(list(range(x)), list(range(y))) for x, y in sizes], "a array<int>, b array<int>")
    for room in (5, 8, 13):
        a, b = tasks.cut_pair(F.col("a"), F.col("b"), room)
        for row in rows.select("a", "b", a.alias("x"), b.alias("y")).collect():
            assert (row.x, row.y) == cut_one_by_one(row.a, row.b, room)


def test_masking_in_slices(spark, monkeypatch):
    """The changes are those of the draws, whatever rows share a slice; null lists stay null."""
    import pyarrow as pa

    monkeypatch.setattr(tasks, "_IDS_AT_ONCE", 50)
    rows = [(i, None if i == 3 else [(i * k) % 260 for k in range(i * 7 % 90)]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>").coalesce(1)
    drawn = df.withColumn("draws", tasks.position_draws(F.col("ids"), F.col("doc_id"), 7))
    chosen, masked, replaced = tasks.draw_limits(0.15)
    got = tasks.mask_tokens(drawn, "ids", "doc_id", 260, 3, [0, 1, 2, 3], seed=7).orderBy("doc_id").collect()
    assert [r.doc_id for r in got if r.labels is None or r.masked_ids is None] == [3]
    for r in got:
        for x, d, m, y in zip(*(v or [] for v in (r.ids, r.draws, r.masked_ids, r.labels)), strict=True):
            assert y == (x if x > 3 and d < chosen else -100)
            new = 3 if d < masked else (d - masked) * 260 // (replaced - masked)
            assert m == (x if x <= 3 or d >= replaced else new)
    lists, seeds = pa.array([[5, None, 9]], pa.list_(pa.int32())), pa.array([[1, 2, 3]])
    part = tasks._masked(lists, seeds, (0, 0, 0), 260, 3, tasks.np.array([0]))
    assert part.to_pylist() == [{"masked_ids": [5, None, 9], "labels": [-100] * 3}]
