"""Writing characters in other codes.

The documents hold no Han text. These queries derive it: each Latin letter is
replaced by the component its key stands for, which gives Han texts of the same
size, and the readings of those components are the dictionary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import codes, vocab
from glyphmill.session import scratch_path
from glyphmill.sources import readers, writers

from .registry import SQL_CHARS, query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN = "".join(codes.SHAPE_CODE_COMPONENTS[c] for c in LETTERS)
# Readings of the components: with tone mark, with tone number, in the phonetic alphabet.
READINGS = [
    ("日", "rì", "ri4", "ㄖˋ"), ("月", "yuè", "yue4", "ㄩㄝˋ"), ("金", "jīn", "jin1", "ㄐㄧㄣ"),
    ("木", "mù", "mu4", "ㄇㄨˋ"), ("水", "shuǐ", "shui3", "ㄕㄨㄟˇ"), ("火", "huǒ", "huo3", "ㄏㄨㄛˇ"),
    ("土", "tǔ", "tu3", "ㄊㄨˇ"), ("竹", "zhú", "zhu2", "ㄓㄨˊ"), ("戈", "gē", "ge1", "ㄍㄜ"),
    ("十", "shí", "shi2", "ㄕˊ"), ("大", "dà", "da4", "ㄉㄚˋ"), ("中", "zhōng", "zhong1", "ㄓㄨㄥ"),
    ("一", "yī", "yi1", "ㄧ"), ("弓", "gōng", "gong1", "ㄍㄨㄥ"), ("人", "rén", "ren2", "ㄖㄣˊ"),
    ("心", "xīn", "xin1", "ㄒㄧㄣ"), ("手", "shǒu", "shou3", "ㄕㄡˇ"), ("口", "kǒu", "kou3", "ㄎㄡˇ"),
    ("尸", "shī", "shi1", "ㄕ"), ("廿", "niàn", "nian4", "ㄋㄧㄢˋ"), ("山", "shān", "shan1", "ㄕㄢ"),
    ("女", "nǚ", "nv3", "ㄋㄩˇ"), ("田", "tián", "tian2", "ㄊㄧㄢˊ"), ("難", "nán", "nan2", "ㄋㄢˊ"),
    ("卜", "bǔ", "bu3", "ㄅㄨˇ"),
]
# Phrases whose reading differs from that of their characters.
PHRASES = [("廿竹水", "niàn#zhū#shuí"), ("廿竹", "niàn#zhù"), ("水弓", "shuì#gòng"), ("人弓", "rèn#gǒng")]


def readings(t):
    return t.spark.createDataFrame(
        READINGS, "ch string, marked string, numbered string, bopomofo string"
    )


def han_texts(t):
    return t.documents.select("doc_id", F.translate("text", LETTERS, HAN).alias("text"))


SQL_READINGS = "readings AS (SELECT * FROM (VALUES {}) v(ch, marked, numbered, bopomofo))".format(
    ", ".join("('{}', '{}', '{}', '{}')".format(*row) for row in READINGS)
)
SQL_HAN = f"han AS (SELECT doc_id, translate(text, '{LETTERS}', '{HAN}') AS text FROM documents)"


def sql_readings(reading: str, pattern: str = r"\p{Han}|[^\p{Han}]+") -> str:
    """(doc_id, i, item): items with the reading put in, in order."""
    return f"""
{SQL_READINGS}, {SQL_HAN}, items AS (
  SELECT doc_id, i, coalesce(r.{reading}, item) AS item
  FROM (SELECT doc_id, generate_subscripts(its, 1) AS i, unnest(its) AS item
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS its FROM han))
  LEFT JOIN readings r ON r.ch = item
)"""


SQL_CIRCLED = """CASE WHEN regexp_matches({0}, '[1234]$') AND right({0}, 1) IN ('1','2','3','4')
  THEN left({0}, length({0}) - 1) || translate(right({0}, 1), '1234', '①②③④') ELSE {0} END"""


@query("pinyin_marked", f"""
WITH {sql_readings('marked')}
SELECT doc_id, string_agg(item, '#' ORDER BY i) AS codes FROM items GROUP BY doc_id
""")
def pinyin_marked(t):
    return han_texts(t).select(
        "doc_id", codes.readings_joined(F.col("text"), readings(t), "marked").alias("codes")
    )


@query("pinyin_numbered", f"""
WITH {sql_readings('numbered')}
SELECT doc_id, string_agg({SQL_CIRCLED.format('item')}, '#' ORDER BY i) AS codes FROM items GROUP BY doc_id
""")
def pinyin_numbered(t):
    return han_texts(t).select(
        "doc_id",
        codes.readings_joined(F.col("text"), readings(t), "numbered", circled=True).alias("codes"),
    )


@query("zhuyin", f"""
WITH {sql_readings('bopomofo')}
SELECT doc_id, string_agg(item, '#' ORDER BY i) AS codes FROM items GROUP BY doc_id
""")
def zhuyin(t):
    return han_texts(t).select(
        "doc_id", codes.readings_joined(F.col("text"), readings(t), "bopomofo").alias("codes")
    )


@query("pinyin_with_phrases", f"""
WITH {sql_readings('marked', '|'.join(p for p, _ in PHRASES) + r'|[\p{Han}]|[^\p{Han}]+')},
phrases AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{r}')" for p, r in PHRASES)}) v(phrase, reading))
SELECT doc_id, string_agg(coalesce(p.reading, item), '#' ORDER BY i) AS codes
FROM items LEFT JOIN phrases p ON p.phrase = item GROUP BY doc_id
""")
def pinyin_with_phrases(t):
    """The longest phrase at a place wins over single readings."""
    phrases = t.spark.createDataFrame(PHRASES, "phrase string, marked string")
    return han_texts(t).select(
        "doc_id",
        codes.readings_joined(F.col("text"), readings(t), "marked", phrases=phrases).alias("codes"),
    )


@query("circle_tone", f"""
SELECT word, {SQL_CIRCLED.format('word')} AS circled, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n]+')) AS word FROM documents) GROUP BY word
""")
def circle_tone(t):
    words = t.documents.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("word")
    )
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", T.circle_tone(F.col("word")).alias("circled"), "n")


# A dictionary made from the documents: each character's code point in hexadecimal,
# its digits written as the letters a to p.
SQL_DICT = f"""{SQL_CHARS},
entries AS (
  SELECT DISTINCT c AS ch, translate(hex(unicode(c)), '0123456789ABCDEF', 'abcdefghijklmnop') AS code
  FROM chars WHERE c NOT IN (' ', chr(10), '#')
)"""


def entries(t):
    code = F.translate(F.hex(F.ascii("token")), "0123456789ABCDEF", "abcdefghijklmnop")
    return vocab.char_counts(t.documents).where(~F.col("token").isin(" ", "\n", "#")).select(
        F.col("token").alias("ch"), code.alias("code")
    )


def dictionary_folder(t) -> str:
    """The dictionary as a file: header, comments, empty and malformed lines, and a
    second, different entry for every character."""
    rows = entries(t).select("ch", "code", F.ascii("ch").alias("cp"))
    head = t.spark.createDataFrame(
        [(i, 0, line) for i, line in enumerate(
            ["# dictionary", "---", "name: codes", "q\tzz\t1\tzzz", "...", "# codes", "", "alone"])],
        "part int, cp int, value string",
    )
    first = rows.select(F.lit(10).alias("part"), "cp", F.concat_ws(
        "\t", "ch", "code", F.lit("7"), F.concat("code", "code")).alias("value"))
    second = rows.select(F.lit(20).alias("part"), "cp", F.concat_ws(
        "\t", "ch", F.reverse("code"), F.col("cp")).alias("value"))
    third = rows.select(F.lit(30).alias("part"), "cp", F.concat_ws("\t", "ch", "code").alias("value"))
    path = scratch_path(t.spark, "dictionary")
    lines = head.unionByName(first).unionByName(second).unionByName(third)
    lines.orderBy("part", "cp").select("value").write.text(path)
    return path


@query("read_code_dict", f"WITH {SQL_DICT} SELECT ch, code FROM entries")
def read_code_dict(t):
    return readers.read_code_dict(t.spark, dictionary_folder(t))


def sql_components(components: dict[str, str], code: str) -> str:
    cases = " ".join(
        "WHEN k = {} THEN '{}'".format("chr(39)" if k == "'" else f"'{k}'", v.replace("'", "''"))
        for k, v in components.items()
    )
    return (
        f"array_to_string(list_transform(string_split({code}, ''), "
        f"lambda k: CASE {cases} ELSE '[' || k || ']' END), '')"
    )


FIVE, SHAPE = codes.FIVE_STROKE_COMPONENTS, codes.SHAPE_CODE_COMPONENTS
SQL_HEAD = """(VALUES ('# dictionary'), ('---'), ('name: codes'),
  ('q' || chr(9) || 'zz' || chr(9) || '1' || chr(9) || 'zzz'), ('...'), ('# codes'), (''))"""


@query("convert_five_stroke_dict", f"""
WITH {SQL_DICT}
SELECT value, false AS malformed FROM {SQL_HEAD} v(value)
UNION ALL SELECT 'alone', true
UNION ALL SELECT concat_ws(chr(9), ch, {sql_components(FIVE, 'code')}, '7', {sql_components(FIVE, 'code || code')}), false FROM entries
UNION ALL SELECT concat_ws(chr(9), ch, {sql_components(FIVE, 'reverse(code)')}, unicode(ch)::VARCHAR), false FROM entries
UNION ALL SELECT concat_ws(chr(9), ch, {sql_components(FIVE, 'code')}), false FROM entries
""")
def convert_five_stroke_dict(t):
    lines = readers.read_lines(t.spark, dictionary_folder(t))
    converted = codes.convert_dict_lines(lines, FIVE, codes.FIVE_STROKE_FIELDS, readers.LINE_ORDER)
    return converted.select("value", "malformed")


@query("convert_shape_code_dict", f"""
WITH {SQL_DICT}
SELECT value FROM {SQL_HEAD} v(value)
UNION ALL SELECT 'alone'
UNION ALL SELECT concat_ws(chr(9), ch, code, '7', code || code) FROM entries
UNION ALL SELECT concat_ws(chr(9), ch, {sql_components(SHAPE, 'reverse(code)')},
                           {sql_components(SHAPE, 'unicode(ch)::VARCHAR')}) FROM entries
UNION ALL SELECT concat_ws(chr(9), ch, {sql_components(SHAPE, 'code')}) FROM entries
""")
def convert_shape_code_dict(t):
    """Converted, written in order, and read back."""
    lines = readers.read_lines(t.spark, dictionary_folder(t))
    converted = codes.convert_dict_lines(lines, SHAPE, codes.SHAPE_CODE_FIELDS, readers.LINE_ORDER)
    path = scratch_path(t.spark, "converted")
    writers.write_code_dict(converted, path)
    return readers.read_lines(t.spark, path).select("value")


@query("keys_to_components", f"""
SELECT word, {sql_components(SHAPE, 'word')} AS components, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n]+')) AS word FROM documents) GROUP BY word
""")
def keys_to_components(t):
    words = t.documents.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("word")
    )
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", codes.keys_to_components(F.col("word"), SHAPE).alias("components"), "n")


@query("first_wins", """
SELECT event_type AS ch, arg_min(user_id, event_id) AS code FROM events GROUP BY event_type
""")
def first_wins(t):
    """The first entry per key: five keys hold all the rows."""
    return codes.first_wins(t.events, "event_type", "user_id", "event_id").select(
        F.col("event_type").alias("ch"), F.col("user_id").alias("code")
    )


@query("lookup_codes", f"""
WITH {SQL_DICT}, counted AS (SELECT c AS ch, count(*) AS n FROM chars GROUP BY c)
SELECT ch, n, coalesce(code, ch) AS code FROM counted LEFT JOIN entries USING (ch)
""")
def lookup_codes(t):
    chars = vocab.char_counts(t.documents).withColumnRenamed("token", "ch")
    return codes.lookup_codes(chars, entries(t))


@query("codes_joined", f"""
WITH {SQL_DICT}
SELECT doc_id, string_agg(coalesce(code, c), '#' ORDER BY i) AS codes
FROM chars LEFT JOIN entries ON ch = c GROUP BY doc_id
""")
def codes_joined(t):
    return t.documents.select("doc_id", codes.codes_joined(F.col("text"), entries(t)).alias("codes"))


@query("input_method", f"""
WITH {sql_readings('numbered')}, {SQL_DICT}
SELECT 'pinyin_tone_after' AS method, doc_id, string_agg({SQL_CIRCLED.format('item')}, '#' ORDER BY i) AS codes
FROM items GROUP BY doc_id
UNION ALL
SELECT 'wubi', doc_id, string_agg(coalesce(code, c), '#' ORDER BY i)
FROM chars LEFT JOIN entries ON ch = c GROUP BY doc_id
UNION ALL
SELECT '', doc_id, text FROM documents
""")
def input_method(t):
    """Three methods chosen by name."""
    cases = [
        ("pinyin_tone_after", han_texts(t), readings(t)),
        ("wubi", t.documents, entries(t)),
        ("", t.documents, None),
    ]
    frames = [
        docs.select(F.lit(method).alias("method"), "doc_id",
                    codes.convert_text(F.col("text"), method, table).alias("codes"))
        for method, docs, table in cases
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
