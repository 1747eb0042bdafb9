import random

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import corpus, runs

SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


def one(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_strip_equals_python(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(SPACES + "ab\u200b") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    assert one(spark, texts, T.py_strip(F.col("t"))) == [t.strip() for t in texts]
    assert one(spark, texts, T.has_ink(F.col("t"))) == [bool(t.strip()) for t in texts]


def test_last_mark_equals_rfind(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab。😀") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    got = one(spark, texts, T.last_mark_index(F.col("t"), "。", 20))
    assert got == [t.rfind("。", 0, 20) for t in texts]
    assert one(spark, ["ab。cd。ef"], T.last_mark_index(F.col("t"))) == [5]


def test_trim_drops_early_marks(spark):
    rows = [(1, "ab。cd。ef"), (2, "x" * 120 + "。" + "y" * 300 + "。"), (3, "z" * 300)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert [(r.doc_id, r.text) for r in corpus.trim_to_mark(df).collect()] == [(2, "x" * 120 + "。")]


def test_characters_and_bytes(spark):
    texts = ["", "aé日😀", "\x00b", "ÿ"]
    assert one(spark, texts, T.char_tokens(F.col("t"))) == [list(t) for t in texts]
    assert one(spark, texts, T.code_points(F.col("t"))) == [[ord(c) for c in t] for t in texts]
    assert one(spark, texts, T.byte_tokens(F.col("t"))) == [list(t.encode()) for t in texts]
    assert one(spark, texts, T.bytes_to_text(T.byte_tokens(F.col("t")))) == texts
    assert one(spark, texts, T.latin1_text(F.col("t"))) == [t.encode().decode("latin-1") for t in texts]


def test_separators_are_removed(spark):
    texts = ["a\u2028b\u2029", "c"]
    assert one(spark, texts, T.drop_separators(F.col("t"))) == ["ab", "c"]


def test_circled_tone(spark):
    texts = ["ni3", "2024", "hao", "", "5", "1"]
    assert one(spark, texts, T.circle_tone(F.col("t"))) == ["ni③", "202④", "hao", "", "5", "①"]


def test_renames_go_in_order(spark):
    names = ["experiments/subword-bpe", "experiments/repacked-subword", "byte"]
    got = one(spark, names, T.rename_by_rules(F.col("t"), runs.RENAMES))
    assert got == ["character-bpe", "repacked-character-bpe", "byte"]


def test_first_rule_wins(spark):
    names = ["h.0.ln_1.attn", "h.0.attn.c_proj", "h.0.attn", "wte", "bias"]
    got = one(spark, names, T.classify_by_rules(F.col("t"), runs.PARAMETER_CLASSES))
    assert got == ["Layer Normalization", "Feed-Forward Network", "Self-Attention", "Word Embeddings", "Other"]
