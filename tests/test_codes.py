import pytest
from pyspark.sql import functions as F

from glyphmill.operators import codes
from glyphmill.session import scratch_path
from glyphmill.sources import readers, writers

READINGS = [("你", "nǐ", "ni3", "ㄋㄧˇ"), ("好", "hǎo", "hao3", "ㄏㄠˇ"), ("我", "wǒ", "wo3", "ㄨㄛˇ"),
            ("是", "shì", "shi4", "ㄕˋ"), ("小", "xiǎo", "xiao3", "ㄒㄧㄠˇ"), ("白", "bái", "bai2", "ㄅㄞˊ")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(READINGS, "ch string, marked string, numbered string, bopomofo string")


@pytest.fixture
def text(spark):
    return spark.createDataFrame([("你好，我是小白",)], "t string")


@pytest.mark.parametrize("method, expected", [
    ("pinyin_tone_above", "nǐ#hǎo#，#wǒ#shì#xiǎo#bái"),
    ("pinyin_tone_after", "ni③#hao③#，#wo③#shi④#xiao③#bai②"),
    ("zhuyin", "ㄋㄧˇ#ㄏㄠˇ#，#ㄨㄛˇ#ㄕˋ#ㄒㄧㄠˇ#ㄅㄞˊ"),
    ("", "你好，我是小白"),
])
def test_readings(text, table, method, expected):
    assert text.select(codes.convert_text(F.col("t"), method, table)).first()[0] == expected


def test_other_text_stays_in_runs(spark, table):
    df = spark.createDataFrame([("abc 2024你x1",)], "t string")
    assert df.select(codes.convert_text(F.col("t"), "pinyin_tone_after", table)).first()[0] == "abc 202④#ni③#x①"


def test_longest_phrase_wins(spark, table):
    phrases = spark.createDataFrame([("你好", "X#Y"), ("你好我", "A#B#C")], "phrase string, marked string")
    df = spark.createDataFrame([("你好你好我a你",)], "t string")
    got = df.select(codes.readings_joined(F.col("t"), table, "marked", phrases=phrases)).first()[0]
    assert got == "X#Y#A#B#C#a#nǐ"


def test_phrases_hold_one_text_at_a_time():
    """Items of a whole batch of texts were handed on as lists of strings, and runs were put together
    one character at a time."""
    import tracemalloc

    write = codes._phrase_writer({"你好": ["X", "Y"], "b你": ["no"]}, {"你": "nǐ4"}, codes._circled)
    assert write("a3你好你b你 4") == "a③#X#Y#nǐ4#b#nǐ4# ④"
    text = "你好你" * 20_000 + "x" * 60_000
    tracemalloc.start()
    for _ in range(20):
        assert len(write(text)) == 20_000 * 8 + 60_000
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_phrases_over_several_slices_of_a_batch(spark, table):
    phrases = spark.createDataFrame([("你好", "X#Y")], "phrase string, marked string")
    texts = [(i, None if i % 50 == 7 else "你好" * (i % 3) + str(i)) for i in range(500)]
    df = spark.createDataFrame(texts, "i int, t string").coalesce(1)
    got = df.select("i", codes.readings_joined(F.col("t"), table, "marked", phrases=phrases).alias("r")).collect()
    assert [r.r for r in got] == [None if t is None else "X#Y#" * (i % 3) + str(i) for i, t in texts]


def test_dictionary_method_keeps_unknown_characters(spark):
    table = spark.createDataFrame([("a", "x")], "ch string, code string")
    df = spark.createDataFrame([("ab",)], "t string")
    assert df.select(codes.convert_text(F.col("t"), "wubi", table)).first()[0] == "x#b"


def test_unknown_method_raises(table):
    with pytest.raises(ValueError):
        codes.convert_text(F.lit("x"), "morse", table)


def dictionary(spark):
    lines = ["# head", "a\tz", "...", "# note", "", "工\ta\t12\taaaa", "工\tb", "木\tsS\t9", "只", "月 e x"]
    path = scratch_path(spark, "dictionary")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path, lines


def test_first_entry_wins_and_headers_do_not_count(spark):
    path, _ = dictionary(spark)
    got = {r.ch: r.code for r in readers.read_code_dict(spark, path).collect()}
    assert got == {"工": "a", "木": "sS", "月": "e"}


def test_lines_are_converted_in_place(spark):
    path, lines = dictionary(spark)
    rows = readers.read_lines(spark, path)
    out = codes.convert_dict_lines(
        rows, codes.FIVE_STROKE_COMPONENTS, codes.FIVE_STROKE_FIELDS, readers.LINE_ORDER)
    target = scratch_path(spark, "converted")
    writers.write_code_dict(out, target)
    got = [r.value for r in readers.read_lines(spark, target).orderBy(*readers.LINE_ORDER).collect()]
    assert got == lines[:5] + ["工\t工\t12\t工工工工", "工\t子", "木\t木[S]\t9", "只", "月 e x"]
    assert {r.value for r in out.where("malformed").collect()} == {"只", "月 e x"}


def test_both_component_maps(spark):
    df = spark.createDataFrame([("az'?",)], "t string")
    five = codes.keys_to_components(F.col("t"), codes.FIVE_STROKE_COMPONENTS)
    shape = codes.keys_to_components(F.col("t"), codes.SHAPE_CODE_COMPONENTS)
    assert tuple(df.select(five, shape).first()) == ("工Ⓩ[']" + "[?]", "日重'[?]")
    assert len(codes.FIVE_STROKE_COMPONENTS) == 26 and len(codes.SHAPE_CODE_COMPONENTS) == 27


def test_any_code_may_stand_in_a_table(spark):
    from glyphmill.operators import codes

    table = spark.createDataFrame([("a", "x\x1fy"), ("b", ""), ("c", "#")], "ch string, code string")
    text = spark.createDataFrame([("abcd",)], "text string")
    assert text.select(codes.codes_joined(F.col("text"), table)).first()[0] == "x\x1fy####d"
